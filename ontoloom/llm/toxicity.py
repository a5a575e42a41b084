"""Toxicity by weak supervision.

Many voters say toxic or abstain: a built-in lexicon in groups, patterns
(shouting, insults addressed to "you"), and lexicon entries mined from labelled
training rows (words and word beginnings that are far more frequent in toxic
ones than chance explains).  No voter knows a row's label: labels choose the mined lexicons, and
anchor the voters' accuracies beside the posteriors, so that the two classes keep
their meaning.

The generative label model is a tree: each voter's chance to fire depends on the
class and on one other voter, so it has both accuracies and correlations.  Which
voters depend on each other is the spanning tree of largest conditional mutual
information; expectation-maximisation estimates the class balance and the tables.
A logistic classifier on the lexicon entries and patterns of the whole text is
trained on the posterior labels and gives the score.

Fitting uses at most TRAIN_ROWS labelled rows outside the held-out fold
(crc32(doc_id) mod 4 = 2), drawn by a hash; scoring covers every row.  Where
several rows share a doc_id the smallest text is the labelled one.
Null and empty texts have no words and get the score of a text without hits; rows
without doc_id are scored and not held out; repeated rows get one result each;
with no toxic labels the built-in lexicon decides; an empty table gives no rows;
extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.common import claim, materialise, own_columns, small_batches, table

TRAIN_ROWS = 20_000
#: A mined entry stands in so many toxic training rows at least, is so many times likelier in toxic than in clean ones, and its log-likelihood ratio (G) says that chance doesn't explain it.
LEAST_ROWS, LEAST_RATIO, LEAST_G = 3, 5, 15
WORD_CACHE = 400_000
LETTERS = re.compile(r"[^\W\d_]+")
LEXICON = {
    "insult": "idiot idiots moron morons stupid dumb imbecile fool clown dimwit halfwit",
    "contempt": "worthless pathetic loser losers scum scumbag vermin filth useless",
    "disgust": "disgusting trash garbage repulsive vile",
    "hate": "hate despise subhuman inferior parasite parasites",
    "threat": "kill murder destroy strangle",
    "profanity": "damn crap bastard bitch shit fuck fucking asshole",
}
_LEXICON = {w: name for name, words in LEXICON.items() for w in words.split()}
_ADDRESSED = re.compile(r"\b(?:you|your|you're|du|tu|eres)\s+(?:\w+\s+)?(?:idiot|moron|loser|scum|trash|clown|stupid|worthless|pathetic)", re.I)
BASE = [*LEXICON, "shouting", "addressed"]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def entries_of(word: str) -> list[str]:
    """Lexicon entries that a word may match: itself and its beginnings of 3 to 6 letters."""
    return [word, *(word[:n] + "*" for n in (3, 4, 5, 6) if len(word) > n)]


def words_in(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def patterns_in(text: str | None, words: set[str]) -> list[str]:
    found = {_LEXICON[w] for w in words if w in _LEXICON}
    if text:
        if text.count("!") > 3 and text.isupper():
            found.add("shouting")
        if _ADDRESSED.search(text):
            found.add("addressed")
    return sorted(found)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, toxic) of at most limit labelled rows outside the held-out fold."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # known has at most limit rows


def _entry_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch["text"]:
            counts.update({e for w in words_in(text) for e in entries_of(w)})
        yield pd.DataFrame({"entry": list(counts), "n": list(counts.values())})


def _by_entry(texts: DataFrame, name: str) -> DataFrame:
    """Texts by entry."""
    return texts.select("text").mapInPandas(_entry_counts, "entry string, n long").groupBy("entry").agg(F.sum("n").alias(name))


def strong_entries(train: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The mined entries; all that pass, which the size of the training rows bounds."""
    toxic = _by_entry(train.where("toxic = 1"), "toxic").where(F.col("toxic") >= LEAST_ROWS)
    both = toxic.join(_by_entry(train.where("toxic = 0"), "clean"), "entry", "left").fillna(0, ["clean"])
    t, c = F.col("toxic"), F.col("clean")
    ratio = (t + 0.5) / (c + 0.5) * F.lit((n_clean + 1) / (n_toxic + 1))
    share = n_toxic / max(n_toxic + n_clean, 1)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((t + c) * max(p, 1e-9)))).otherwise(0.0)
    g = 2 * (part(t, share) + part(c, 1 - share))
    return sorted(r["entry"] for r in both.where((ratio >= LEAST_RATIO) & (g >= LEAST_G)).select("entry").collect())


def _hits(entries: frozenset[str]):
    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, toxic in zip(batch["doc_id"], batch["text"], batch["toxic"], strict=True):
                words = words_in(text)
                found = {e for w in words for e in entries_of(w) if e in entries}
                out.append((doc_id, int(toxic), sorted(found), patterns_in(text, words)))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "entries", "base"])

    return hits


class LabelModel:
    """Two classes and binary voters (fire or abstain), each dependent on the class and on its parent voter in a tree.

    rows: per row the sorted numbers of the voters that fire.
    """

    def __init__(self, rows: list[np.ndarray], n_voters: int):
        self.n, self.m = len(rows), n_voters
        self.row = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)] or [[]]).astype(np.int64)
        self.voter = np.concatenate([*rows, np.zeros(0)]).astype(np.int64)
        self.parent = np.full(n_voters, -1)
        self._pairs()

    def _pairs(self) -> None:
        """Voters a < b that fire together: their numbers, and the rows where they do."""
        size = np.bincount(self.row, minlength=self.n)
        start = np.cumsum(size) - size
        many = int((size * (size - 1) // 2).sum())
        code, self.pair_row, done = np.empty(many, np.int64), np.empty(many, np.int32), 0
        for i in np.flatnonzero(size > 1):
            mine = self.voter[start[i] : start[i] + size[i]]
            x, y = np.triu_indices(len(mine), 1)
            code[done : done + len(x)] = mine[x] * self.m + mine[y]
            self.pair_row[done : done + len(x)] = i
            done += len(x)
        self.pair = np.unique(code)
        self.pair_at = np.searchsorted(self.pair, code).astype(np.int32)

    def _table(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Weighted rows where each voter fires, where each pair does, and all."""
        return (
            np.bincount(self.voter, weights=weight[self.row], minlength=self.m),
            np.bincount(self.pair_at, weights=weight[self.pair_row], minlength=len(self.pair)),
            float(weight.sum()),
        )

    def grow(self, post: np.ndarray) -> None:
        """The tree of largest conditional mutual information between voters that fire together."""
        gain = np.zeros(len(self.pair))
        a, b = self.pair // max(self.m, 1), self.pair % max(self.m, 1)
        for weight in (post, 1 - post):
            one, both, total = self._table(weight)
            total += 1.0
            for x, y in ((1, 1), (1, 0), (0, 1), (0, 0)):
                pa, pb = (one[a] if x else total - one[a]) + 0.25, (one[b] if y else total - one[b]) + 0.25
                joint = both if x and y else one[a] - both if x else one[b] - both if y else total - one[a] - one[b] + both
                joint = np.maximum(joint, 0) + 0.25 * pa * pb / total / total  # smoothing in proportion to independence
                gain += joint * np.log(np.maximum(joint * total / (pa * pb), 1e-12))
        root = list(range(self.m))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        near: list[list[int]] = [[] for _ in range(self.m)]
        for k in np.argsort(-gain, kind="stable"):
            if gain[k] <= 2.0:  # weaker than chance would make it
                break
            x, y = int(a[k]), int(b[k])
            if find(x) != find(y):
                root[find(x)] = find(y)
                near[x].append(y)
                near[y].append(x)
        self.parent[:] = -1
        seen: set[int] = set()
        for top in range(self.m):
            if top in seen:
                continue
            seen.add(top)
            todo = [top]
            while todo:
                x = todo.pop()
                for y in near[x]:
                    if y not in seen:
                        seen.add(y)
                        self.parent[y] = x
                        todo.append(y)
        self._states()

    def _states(self) -> None:
        """(row, voter) that fire with a parent that fires, without, and that don't fire while their parent does."""
        fired = np.sort(self.row * self.m + self.voter)

        def fires(row: np.ndarray, voter: np.ndarray) -> np.ndarray:
            code = row * self.m + voter
            at = np.minimum(np.searchsorted(fired, code), max(len(fired) - 1, 0))
            return fired[at] == code if len(fired) else np.zeros(0, bool)

        parent = self.parent[self.voter]
        up = (parent >= 0) & fires(self.row, np.maximum(parent, 0))
        self.with_parent = (self.row[up], self.voter[up])
        self.alone = (self.row[~up], self.voter[~up])
        children = np.argsort(self.parent, kind="stable")
        first, last = (np.searchsorted(self.parent[children], self.voter, side=s) for s in ("left", "right"))
        n = last - first
        row = np.repeat(self.row, n)
        child = children[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        calm = ~fires(row, child)
        self.quiet = (row[calm], child[calm])

    def _tables(self, weight: np.ndarray) -> np.ndarray:
        """Per voter its chance to fire where its parent doesn't and where it does."""
        count = lambda state: np.bincount(state[1], weights=weight[state[0]], minlength=self.m)
        both, alone, quiet = count(self.with_parent), count(self.alone), count(self.quiet)
        calm = weight.sum() - both - quiet  # weight of rows whose parent doesn't fire
        return np.stack([(alone + 0.1) / (calm + 1.0), (both + 0.1) / (both + quiet + 0.5)])

    def fit(self, anchor: np.ndarray, rounds: int = 60) -> np.ndarray:
        """Posterior P(toxic) per row; the tables are counted on the posteriors and, as much, on the anchor (0 to 1 per row), which is also the start."""
        if not self.n:
            return np.zeros(0)
        post = anchor
        for i in range(rounds):
            mixed = (post + anchor) / 2
            if i in (0, 5):
                self.grow(mixed)
            t, c = self._tables(mixed), self._tables(1 - mixed)
            odds = np.log((mixed.sum() + 1) / (self.n - mixed.sum() + 1)) + (np.log1p(-t[0]) - np.log1p(-c[0])).sum()
            odds = np.full(self.n, odds)
            calm = np.log1p(-t[0]) - np.log1p(-c[0])
            for (row, voter), change in (
                (self.with_parent, np.log(t[1]) - np.log(c[1]) - calm),
                (self.alone, np.log(t[0]) - np.log(c[0]) - calm),
                (self.quiet, np.log1p(-t[1]) - np.log1p(-c[1]) - calm),
            ):
                odds += np.bincount(row, weights=change[voter], minlength=self.n)
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            done, post = np.abs(new - post).max() < 1e-4, new
            if done and i > 8:
                break
        return post


def logistic(rows: list[np.ndarray], target: np.ndarray, n_features: int, l2: float = 0.5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier on binary features, by accelerated gradient steps."""
    w, b = np.zeros(n_features), 0.0
    if not len(rows):
        return w, -3.0
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]).astype(np.int64)
    which = np.concatenate(rows).astype(np.int64)
    n = len(rows)
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    b = float(np.log((target.sum() + 1) / (n - target.sum() + 1)))
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(at, weights=w[which], minlength=n), -30, 30)))
        d = p - target
        g, gb = (np.bincount(which, weights=d[at], minlength=n_features) + l2 * w), d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 * (1 - 0.9 * i / rounds)
        w = w - step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        b = b - step * (mb / (1 - 0.9**i)) / (np.sqrt(vb / (1 - 0.99**i)) + 1e-8)
    return w, float(b)


def distinct_voters(fired: list[np.ndarray], n: int) -> tuple[np.ndarray, int]:
    """A number for each of n entries, the same for those that stand in the same rows (a word and its beginnings mostly do): they are one voter."""
    rows: list[list[int]] = [[] for _ in range(n)]
    for i, f in enumerate(fired):
        for v in f.tolist():
            rows[v].append(i)
    known: dict[tuple[int, ...], int] = {}
    number = np.array([known.setdefault(tuple(r), len(known)) for r in rows], dtype=np.int64)
    return number, len(known)


def fit_rows(rows: list[tuple[int, list[str], list[str]]], strong: list[str]) -> dict:
    """The model from training rows (toxic, entries, base patterns): label model, then classifier."""
    names = [*BASE, *strong]
    number = {x: i for i, x in enumerate(names)}
    fired = [np.array(sorted({number[x] for x in [*base, *entries]}), dtype=np.int64) for _, entries, base in rows]
    voter, n_voters = distinct_voters(fired, len(names))
    posterior = LabelModel([np.unique(voter[f]) for f in fired], n_voters).fit(np.array([float(toxic) for toxic, _, _ in rows]))
    weights, bias = logistic(fired, posterior, len(names))
    if not any(toxic for toxic, _, _ in rows):  # nothing to learn from: the lexicon alone
        weights[: len(BASE)], bias = 3.0, -3.0
    return {"bias": bias, "base": dict(zip(BASE, weights.tolist(), strict=False)), "entries": {x: float(weights[number[x]]) for x in strong}, "posterior": posterior}


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """weights by lexicon entry and by base pattern, and the bias."""
    small_batches(docs.sparkSession)
    train = materialise(training_rows(own_columns(docs, "doc_id", "text"), own_columns(labels, "doc_id", "toxic"), train_rows), "toxic-train")
    n_toxic, n_rows = train.where("toxic = 1").count(), train.count()
    strong = strong_entries(train, n_toxic, n_rows - n_toxic)
    rows = train.mapInPandas(_hits(frozenset(strong)), "doc_id long, toxic int, entries array<string>, base array<string>").collect()  # at most train_rows
    return fit_rows([(r["toxic"], r["entries"], r["base"]) for r in sorted(rows, key=lambda r: r["doc_id"])], strong)


class _WordWeights(dict):
    """Sum of a word's entry weights by entry; words without any map to None."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self._entries = entries

    def __missing__(self, word: str):
        if len(self) >= WORD_CACHE:
            self.clear()
        found = [e for e in entries_of(word) if e in self._entries]
        self[word] = value = found or None
        return value


def score_text(text: str | None, model: dict, lookup: _WordWeights) -> float:
    words = words_in(text)
    found = set().union(*filter(None, map(lookup.__getitem__, words)))
    odds = model["bias"] + sum(model["base"][p] for p in patterns_in(text, words)) + sum(map(model["entries"].__getitem__, sorted(found)))
    return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def _score(model: dict):
    model = {k: model[k] for k in ("bias", "base", "entries")}
    lookup: list[_WordWeights] = []

    def score(texts: pd.Series) -> pd.Series:
        claim("toxicity", lookup.clear)
        if not lookup:
            lookup.append(_WordWeights(model["entries"]))
        return pd.Series([score_text(t, model, lookup[0]) for t in texts], dtype="float64")

    return F.pandas_udf(score, "double").asNondeterministic()


def scored(docs: DataFrame, model: dict) -> DataFrame:
    small_batches(docs.sparkSession)
    return own_columns(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _score(model)("text").alias("score"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
