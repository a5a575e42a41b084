"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with a hidden label (content or not).  A parent
and its child share a potential, a node and its features another one; messages
pass from the leaves to the root and back, and give each node's marginal
exactly.  Text stands in the output if the marginal of the block that holds it
reaches one half.  All potentials are counted on labelled pages, which
training_pages() writes from page layouts with known content.

Whole pages are read, in time that grows with their length whatever they hold:
a tag whose quotes don't close ends at its first ">".  Scripts, styles, titles, text areas and frames are skipped
as raw text, and the text in drop-down lists, drawings, templates, noscript and
formula annotations, which browsers don't show as text, is left out; unclosed
and misnested tags are tolerated.  Null, empty and tagless input has a defined
result (empty text; text without tags is one block).  Rows without page_id or
url get a result; repeated rows get one each; extra columns are left out; an
empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.common import own_columns, small_batches, table

_MARK = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_OPAQUE = re.compile(r"<(?:(!--)|(!\[CDATA\[))()()()")  # all that can begin after the last ">"
_STOP = re.compile(r"[>\"']")
_NUMERIC = re.compile(r"&#(?:0*([0-9]*)|[xX]0*([0-9a-fA-F]*));?")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = frozenset("script style textarea iframe title".split())
#: Elements whose text is left out; a block in those of the second set shows that the end tag is missing.
_HIDDEN = frozenset("noscript template svg select annotation annotation-xml".split())
_BROKEN = frozenset("svg select".split())
_END_TAG = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW | _HIDDEN}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption button".split()
)
#: An opening tag of the second kind closes open ones of the first, up to a container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl menu body html div article section main aside nav header footer form blockquote".split())
_HOLDS_P = _SCOPE | {"td", "th", "li", "button"}
_HINTS = [
    ("comment", re.compile(r"comment|disqus|respon[ds]e?|replies|reply|discussion|review", re.I)),
    ("advert", re.compile(r"(?:^|[^a-z])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|outbrain|taboola|affiliate)(?:$|[^a-z])", re.I)),
    ("notice", re.compile(r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri|paywall|toast|signup|login", re.I)),
    ("menu", re.compile(r"nav|menu|breadcrumb|pagination|pager|toc|tabs|toolbar|skip", re.I)),
    ("side", re.compile(r"side|widget|related|recommend|popular|trending|share|social|tags|author-?box|more-", re.I)),
    ("foot", re.compile(r"foot|copyright|legal|colophon|credits", re.I)),
    ("head", re.compile(r"head(?!line)|masthead|logo|top-?bar", re.I)),
    ("content", re.compile(r"article|content|post|entry|main|story|body|text|headline|page", re.I)),
]


class Node:
    __slots__ = ("children", "commas", "controls", "hint", "links", "parent", "parts", "tag", "text")

    def __init__(self, tag: str, hint: str, parent: int):
        self.tag, self.hint, self.parent = tag, hint, parent
        self.children: list[int] = []
        self.text = self.links = self.commas = self.controls = 0
        self.parts = 0


def hint_of(attributes: str) -> str:
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value = m[1] or m[2] or m[3] or ""
            for name, pattern in _HINTS:
                if pattern.search(value):
                    return name
    return "none"


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, however long, give U+FFFD."""

    def shortened(m: re.Match) -> str:
        digits = m[1] if m[1] is not None else m[2]
        return m[0] if len(m[0]) < 12 else "\ufffd" if len(digits) > 7 else f"&#{'' if m[1] is not None else 'x'}{digits or 0};"

    return html.unescape(_NUMERIC.sub(shortened, text) if "&#" in text else text)


class _Tags:
    """Finds a page's markup from a place on.  Places of quotes that lead to an unclosed one are kept, so that each is followed once."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self._dead: set[int] = set()

    def _tag_end(self, at: int) -> int:
        page, seen, here = self.page, [], at
        while m := _STOP.search(page, here):
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            closing = -1 if m.start() in self._dead else page.find(m[0], m.end())
            if closing < 0:
                break
            here = closing + 1
        self._dead.update(seen)
        return page.find(">", at)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, is an end tag, name, attributes) of the next markup; the name of comments and declarations is empty."""
        page = self.page
        while m := (_MARK if at <= self.last else _OPAQUE).search(page, at):
            begin, after = m.start(), m.end()
            if m[1] or m[2]:
                closing = "-->" if m[1] else "]]>"
                end = page.find(closing, after)
                return begin, (len(page) if end < 0 else end + 3), False, "", ""
            end = -1 if after > self.last else page.find(">", after) if m[3] else self._tag_end(after)
            if end >= 0:
                return begin, end + 1, bool(m[4]), (m[5] or "").lower(), page[after:end] if m[5] else ""
            at = begin + 1
        return None


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in document order (parents first; 0 is the root), and (node, text) blocks in page order."""
    nodes, blocks = [Node("root", "none", -1)], []
    stack: list[tuple[str, int]] = [("root", 0)]  # open elements with the node that holds their text
    places: dict[str, list[int]] = {}  # of a tag's open elements on the stack
    scopes, holders = [0], [0]  # places of open elements of _SCOPE and _HOLDS_P
    buffer: list[str] = []
    link = 0
    hidden: list[str] = []  # the open element of _HIDDEN with those of its kind in it, and foreign objects
    foreign = 0  # of them foreign objects
    last: dict[str, int] = {}
    page, at = page or "", 0
    tags = _Tags(page)

    def ends_after(tag: str, at: int) -> bool:
        if tag not in last:
            last[tag] = max((m.start() for m in _END_TAG[tag].finditer(page, 0, tags.last + 1)), default=-1)
        return last[tag] >= at

    def flush() -> None:
        if buffer:
            text = " ".join(unescaped("".join(buffer)).split())
            if text:
                blocks.append((stack[-1][1], text))
            buffer.clear()

    def add_text(raw: str) -> None:
        if raw and not hidden:
            buffer.append(raw)
            node, n = nodes[stack[-1][1]], len(raw.strip())
            if n:
                node.text += n
                node.commas += raw.count(",") + raw.count(".")
                if link:
                    node.links += n

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        if tag in _HOLDS_P:
            holders.append(len(stack))
        stack.append((tag, node))

    def close(depth: int) -> None:
        nonlocal link
        if any(stack[i][0] in _BLOCK for i in range(depth, len(stack))):
            flush()
        while len(stack) > depth:
            tag, _ = stack.pop()
            places[tag].pop()
            link -= tag == "a"
        for kept in (scopes, holders):
            while kept[-1] >= depth:
                kept.pop()

    def place(tag: str) -> int:
        """Of the innermost open element of the tag; 0 without one."""
        return places[tag][-1] if places.get(tag) else 0

    while found := tags.next(at):
        begin, end, ends, tag, attributes = found
        add_text(page[at:begin])
        at = end
        if not tag:
            continue
        closed = attributes.rstrip().endswith("/")
        if tag in _RAW and not ends and not (closed and hidden):
            stop = _END_TAG[tag].search(page, at) if ends_after(tag, at) else None
            if stop:
                at = page.find(">", stop.end()) + 1
            elif tag in ("script", "style"):  # the rest is code, as in browsers
                at = len(page)
            if tag == "textarea" and not hidden:
                nodes[stack[-1][1]].controls += 1
            continue
        if hidden:
            if ends and (tag == hidden[0] or tag == "foreignobject" and foreign):
                while True:
                    foreign -= hidden[-1] == "foreignobject"
                    if hidden.pop() == tag:
                        break
                continue
            again = tag == hidden[0] == "select" and not ends
            if not again:
                broken = hidden[0] in _BROKEN and not foreign and tag in _BLOCK and not (ends and not place(tag))
                if not broken:
                    if not ends and not closed and tag in (hidden[0], "foreignobject"):
                        hidden.append(tag)
                        foreign += tag == "foreignobject"
                    continue
            hidden.clear()
            foreign = 0
        if ends:
            if place(tag):
                close(place(tag))
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _HIDDEN:
            if tag == "select":
                nodes[stack[-1][1]].controls += 1
            if not (closed and tag == "svg") and ends_after(tag, at):
                hidden.append(tag)
            continue
        if tag in ("input", "button"):
            nodes[stack[-1][1]].controls += 1
        if tag in _VOID:
            if tag in ("br", "hr"):
                buffer.append(" ")
                if tag == "hr":
                    flush()
            continue
        if tag in _BLOCK and place("p") > holders[-1]:  # a block ends an open paragraph
            close(place("p"))
        if tag in _CLOSES and (inner := max(map(place, _CLOSES[tag]))) > scopes[-1]:
            close(inner)
        if closed and tag not in _BLOCK:
            continue
        if tag in _BLOCK:
            flush()
            parent = stack[-1][1]
            nodes.append(Node(tag, hint_of(attributes), parent))
            nodes[parent].children.append(len(nodes) - 1)
            push(tag, len(nodes) - 1)
        else:
            link += tag == "a"
            push(tag, stack[-1][1])
    add_text(page[at:])
    flush()
    for node, _ in blocks:
        nodes[node].parts += 1
    return nodes, blocks


def features(nodes: list[Node]) -> list[tuple[str, ...]]:
    """Per node: tag, hint, and buckets of its own and its subtree's text, links, controls and punctuation."""
    n = len(nodes)
    text, links, controls, commas = ([getattr(x, a) for x in nodes] for a in ("text", "links", "controls", "commas"))
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        text[p] += text[i]
        links[p] += links[i]
        controls[p] += controls[i]
        commas[p] += commas[i]
    out = []
    for i, x in enumerate(nodes):
        density = links[i] / text[i] if text[i] else 0.0
        out.append((
            f"tag={x.tag}",
            f"hint={x.hint}",
            f"links={0 if not links[i] else 1 + (density > 0.25) + (density > 0.6)}",
            f"size={min(6, int(math.log2(text[i] + 1) / 1.5))}",
            f"form={min(controls[i], 2)}",
            f"stops={min(3, commas[i])}",
        ))
    return out


def edge_kind(node: Node) -> str:
    return "landmark" if node.tag in ("nav", "aside", "footer", "header", "form", "button", "article", "main", "section", "body", "head") else "hint" if node.hint != "none" else "plain"


def marginals(nodes: list[Node], model: dict) -> list[float]:
    """P(content) per node by sum-product: messages upward, then downward."""
    unary, pair, start = model["unary"], model["pair"], model["start"]
    n = len(nodes)
    local = []
    for feats in features(nodes):
        a = b = 0.0
        for f in feats:
            x = unary.get(f)
            if x:
                a += x[0]
                b += x[1]
        top = max(a, b)
        local.append((math.exp(a - top), math.exp(b - top)))
    up = [(1.0, 1.0)] * n  # message of a node to its parent
    belief = list(local)
    for i in range(n - 1, 0, -1):
        t = pair[edge_kind(nodes[i])]
        x0, x1 = belief[i]
        m0, m1 = t[0][0] * x0 + t[0][1] * x1, t[1][0] * x0 + t[1][1] * x1
        s = m0 + m1
        up[i] = (m0 / s, m1 / s)
        p = nodes[i].parent
        y0, y1 = belief[p][0] * up[i][0], belief[p][1] * up[i][1]
        s = y0 + y1
        belief[p] = (y0 / s, y1 / s)
    belief[0] = (belief[0][0] * start[0], belief[0][1] * start[1])
    for i in range(1, n):
        p0, p1 = belief[nodes[i].parent]
        p0, p1 = p0 / up[i][0], p1 / up[i][1]  # what the parent knows without this child
        t = pair[edge_kind(nodes[i])]
        y0, y1 = belief[i][0] * (p0 * t[0][0] + p1 * t[1][0]), belief[i][1] * (p0 * t[0][1] + p1 * t[1][1])
        s = y0 + y1
        belief[i] = (y0 / s, y1 / s)
    return [y / (x + y) for x, y in belief]


def training_pages(count: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """(page, content blocks) from layouts with known content."""
    rng = random.Random(seed)
    syllables = "an be con da el fi go hu in ka lo mi nu or pa ri so ta un ve wa".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: line(4, 18).capitalize() + (", " + line(2, 8) if rng.random() < 0.5 else "") + "."
    links = lambda k: "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(k))
    out = []
    for _ in range(count):
        content: list[str] = []

        def block(tag: str, text: str, content: list[str] = content) -> str:
            content.append(text)
            return f"<{tag}>{text}</{tag}>"

        parts = []
        title = line(2, 9).capitalize()
        if rng.random() < 0.8:
            head = block("h1", title)
            parts.append(f"<header>{head}</header>" if rng.random() < 0.2 else head)
        for _ in range(rng.choice([1, 1, 2, 4, 8, 15])):
            kind = rng.random()
            text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 9])))
            if kind < 0.75:
                shown = text if rng.random() < 0.8 else text.replace(" ", f' <a href="/{word()}">x</a> ', 1)
                content.append(" ".join(re.sub(r"<[^>]*>", "", shown).split()))
                parts.append(f"<p>{shown}</p>")
            elif kind < 0.83:
                parts.append(block("h2", line(2, 7).capitalize()))
            elif kind < 0.9:
                parts.append("<ul>" + "".join(block("li", sentence()) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                parts.append("<blockquote>" + block("p", text) + "</blockquote>")
            elif kind < 0.97:
                parts.append("<pre>" + block("code", line(3, 12)) + "</pre>")
            else:
                parts.append("<table><tr>" + "".join(block("td", line(1, 4)) for _ in range(4)) + "</tr></table>")
            if rng.random() < 0.06:
                parts.append(f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo-box"])}">{sentence()}</div>')
            if rng.random() < 0.04:
                parts.append(f'<aside class="related"><h3>{line(1, 3)}</h3><ul>{links(3)}</ul></aside>')
        body = "".join(parts)
        body = rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", '<div id="content">{}</div>', '<main>{}</main>', '<div class="post"><div class="entry-content">{}</div></div>', '<article class="post">{}</article>', "<section>{}</section>"]).format(body)
        before, after = [], []
        if rng.random() < 0.5:
            before.append(f'<header class="{rng.choice(["site-header", "masthead", ""])}"><div class="logo">{line(1, 3)}</div><p>{line(2, 6)}</p></header>')
        if rng.random() < 0.8:
            before.append(rng.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul class="breadcrumb">{}</ul>', "<nav>{}</nav>"]).format(links(rng.randint(3, 9))))
        if rng.random() < 0.5:
            before.append(f'<div class="{rng.choice(["ad", "banner", "advert", "ads top"])}">{" ".join(sentence() for _ in range(rng.randint(1, 3)))}</div>')
        if rng.random() < 0.3:
            before.append(f'<div class="{rng.choice(["cookie-notice", "consent", "notice", "alert"])}"><p>{sentence()} {sentence()}</p><button>{word()}</button></div>')
        if rng.random() < 0.4:
            after.append(f'<aside class="{rng.choice(["sidebar", "", "widget"])}"><h3>{line(1, 3)}</h3><p>{sentence()}</p><ul>{links(4)}</ul></aside>')
        if rng.random() < 0.2:
            before.append(f'<div class="sidebar"><h3>{line(1, 3)}</h3><ul>{links(5)}</ul><p>{sentence()}</p></div>')
        if rng.random() < 0.4:
            each = "".join(f'<div class="comment"><span>{word()}</span><p>{" ".join(sentence() for _ in range(rng.randint(1, 4)))}</p></div>' for _ in range(rng.randint(1, 5)))
            after.append(rng.choice(['<section class="comments"><h2>x</h2>{}</section>', '<div id="comments">{}</div>', '<section id="comments">{}</section>']).format(each))
        if rng.random() < 0.3:
            after.append(f'<form><label>{line(1, 3)}</label><input type="text"><p>{sentence()}</p><button>{word()}</button></form>')
        if rng.random() < 0.85:
            after.append(rng.choice(["<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer"><p>{}</p></div>', '<div id="footer">{}</div>']).format(f"&copy; {word()} &middot; {sentence()}"))
        if rng.random() < 0.15:  # an advert or comments inside the content's frame
            body = f'<div class="wrap">{body}{after.pop(0) if after else ""}</div>'
        page = f"<html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
        out.append((page, content))
    return out


def train(pages: list[tuple[str, list[str]]]) -> dict:
    """Potentials by counting over labelled pages: a node is content if most of the text under it is."""
    unary: dict[str, list[float]] = {}
    pair = {k: [[3.0, 1.0], [1.0, 3.0]] for k in ("landmark", "hint", "plain")}
    start, total = [1.0, 1.0], [1.0, 1.0]
    for page, content in pages:
        wanted = set(content)
        nodes, blocks = parse(page)
        inside, outside = [0] * len(nodes), [0] * len(nodes)
        for i, text in blocks:
            (inside if text in wanted else outside)[i] += len(text)
        for i in range(len(nodes) - 1, 0, -1):
            inside[nodes[i].parent] += inside[i]
            outside[nodes[i].parent] += outside[i]
        label = [int(a > b) for a, b in zip(inside, outside, strict=True)]
        start[label[0]] += 1
        for i, feats in enumerate(features(nodes)):
            if i:
                pair[edge_kind(nodes[i])][label[nodes[i].parent]][label[i]] += 1
            total[label[i]] += 1
            for f in feats:
                unary.setdefault(f, [0.5, 0.5])[label[i]] += 1
    for k, rows in pair.items():
        pair[k] = [[x / sum(r) for x in r] for r in rows]
    # A node's own frequency stands in the edges, so unary factors are likelihoods.
    return {"unary": {f: (math.log(a / total[0]), math.log(b / total[1])) for f, (a, b) in unary.items()}, "pair": pair, "start": [x / sum(start) for x in start]}


def extract(page: str | None, model: dict, threshold: float = 0.5) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    if len(nodes) == 1:  # no markup at all
        return "\n\n".join(text for _, text in blocks)
    chance = marginals(nodes, model)
    return "\n\n".join(text for i, text in blocks if chance[i] >= threshold)


def extracted(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    model = model or train(training_pages())

    def texts(raw: pd.Series) -> pd.Series:
        return pd.Series([extract(x, model) for x in raw], dtype="object")

    out = own_columns(pages, "page_id", "url", "html").select("page_id", "url", F.pandas_udf(texts, "string").asNondeterministic()("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
