"""Text that stands around drawings, lists, formulas and objects, closed or not."""

import pytest

from ontoloom.llm import html_model

PARTS = ["The first paragraph of the article says, at length, what has happened.", "A second one, which follows, adds what others have said about it.", "The last one, at the end, says what may come of it."]


def text(page):
    return " ".join(t for _, t in html_model.parse(page)[1])


@pytest.mark.parametrize(
    "odd",
    ["<svg class='i'/>", "<object data='x'/>", "<object data='x'>", "<select><option>x", "<svg viewBox='0 0 1 1'>", "<noscript>", "<template>", "<iframe src='x'>", "<math/>", "<svg><title/><path/></svg>", "<svg><svg></svg>x</svg>", "<template><p>x</p></div></template>", "<select><option>x</select>", "<noscript><p>x</p></noscript>"],
)
@pytest.mark.parametrize("more", ["", "<div><svg><path d='x'/></svg><select><option>y</option></select></div>"])
def test_nothing_around_is_lost(odd, more):
    a, b, c = PARTS
    found = text(f"<body><article><div><p>{a}</p>{odd}<p>{b}</p></div><p>{c}</p></article>{more}</body>")
    assert found.removeprefix(a).replace(" x ", " ").split() == f"{b} {c}".split()


def test_formulas_and_fallback_text_stay():
    assert text("<p>so <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='application/x-tex'>x=1</annotation></semantics></math> holds</p>") == "so x=1 holds"
    assert text("<p>see <object data='a.pdf'>the paper</object> here</p>") == "see the paper here"
    assert text("<p>a</p><svg><text>label</text><foreignObject><div>in it</div></foreignObject></svg><p>b</p>") == "a b"


def test_code_stays_out():
    assert text("<p>a</p><svg><script>'</svg>'</script></svg><p>b</p><script>var c") == "a b"
