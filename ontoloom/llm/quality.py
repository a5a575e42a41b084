"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies.

Every rule looks at the whole text and votes good (1), bad (-1) or abstains (0).
The votes of all documents are counted by vote pattern (at most 3 ** len(RULES)
patterns, whatever the corpus); expectation-maximisation over those counts
estimates the class prior and, per rule, how often it votes each way on good
and on bad documents.  The posterior probability of "good" is then a sum of
per-vote log-odds, computed in the plan.

Null or empty texts have no words: all counts are 0, the base check fails and
they aren't kept.  Repeated rows get one result each; an empty table gives an
empty result; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.common import WORD, materialise, own_columns, small_batches

WINDOW = 8
#: Function words of the languages the corpus is written in; a page of prose has many of them.
FUNCTION_WORDS = frozenset(
    "the of and to a in is that it for was on are as with be by at this from or an have not which "
    "de la le les et des en un une du est que qui dans pour au sur pas il elle par avec "
    "der die das und ist von zu den mit nicht auf ein eine für dem im sich des auch als "
    "el los las y que se del una por con no para es su al lo como más o".split()
)
RULES = ("word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "exclaims", "function_words", "sentence_ends", "length", "separators")
FEATURES = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long," + ",".join(f"v_{r}:int" for r in RULES) + ">"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of 8 words which the text holds at least twice.

    Windows get exact ids by doubling: ids of pairs, of fours, of eights.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    for step in (1, 2, 4):
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        distinct, ids = np.unique(pair, return_inverse=True)
        if len(distinct) == len(ids):
            return 0
    twice = np.bincount(ids)[ids] > 1
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[: len(twice)] += twice
    cover[WINDOW : WINDOW + len(twice)] -= twice
    return int(np.count_nonzero(np.cumsum(cover[:n])))


def _vote(good: bool, bad: bool) -> int:
    return -1 if bad else int(good)


def measure(text: str | None) -> tuple[int, ...]:
    """The base counts and the votes for one text."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (-1,) + (0,) * (len(RULES) - 1)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    exclaims = text.count("!") / n
    function = sum(w in FUNCTION_WORDS for w in words) / n
    ended = sum(x.rstrip()[-1:] in '.!?…"”»' for x in lines) / len(lines)
    separators = (text.count("|") + text.count("\t") + text.count("_")) / n
    mean = chars / n
    return (
        n, chars, symbols, dup_lines, repeated,
        _vote(3 <= mean <= 9, mean < 2 or mean > 13),
        _vote(symbols <= 0.02 * n, symbols > 0.15 * n),
        _vote(len(lines) > 2 and dup_lines <= 0.05 * len(lines), dup_lines > 0.3 * len(lines)),
        _vote(repeated <= 0.05 * n, repeated > 0.25 * n),
        _vote(upper <= 0.05, upper > 0.3),
        _vote(exclaims <= 0.05, exclaims > 0.3),
        _vote(function >= 0.15, n >= 20 and function < 0.05),
        _vote(ended >= 0.8, len(lines) > 1 and ended < 0.3),
        _vote(n >= 50, n < 10),
        _vote(separators <= 0.01, separators > 0.2),
    )


def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=[*COUNTS, *(f"v_{r}" for r in RULES)])


def measures(spark, text: Column) -> Column:
    """Struct of the base counts and votes; marked so that a filter on it doesn't compute it twice."""
    small_batches(spark)
    return F.pandas_udf(_measure, FEATURES).asNondeterministic()(text)


def vote_counts(votes: DataFrame) -> DataFrame:
    """Documents by vote pattern, for columns v_<rule>."""
    return votes.groupBy(*[f"v_{r}" for r in RULES]).agg(F.count(F.lit(1)).alias("n"))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, smooth: float = 1.0) -> dict:
    """EM for two classes and rules that are independent given the class.

    Starts from the share of good votes; the class with more good votes is "good".
    Returns the prior's log-odds and per rule and vote the log-odds it adds.
    """
    zero = {"prior": 0.0, "weight": [{v: 0.0 for v in (-1, 0, 1)} for _ in RULES]}
    if not patterns:
        return zero
    votes = np.array([p for p, _ in patterns], dtype=np.int64)
    n = np.array([c for _, c in patterns], dtype=float)
    cast = np.maximum(1, (votes != 0).sum(1))
    good = np.clip(0.5 + 0.48 * votes.sum(1) / cast, 0.01, 0.99)
    # A bad vote is rare and specific, so one of them already casts doubt at the start.
    good = np.where((votes < 0).any(1), np.minimum(good, 0.5), good)
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        g, b = n * good, n * (1 - good)
        prior = math.log((g.sum() + smooth) / (b.sum() + smooth))
        table_g = np.einsum("p,prv->rv", g, hot) + smooth
        table_b = np.einsum("p,prv->rv", b, hot) + smooth
        weight = np.log(table_g / table_g.sum(1, keepdims=True)) - np.log(table_b / table_b.sum(1, keepdims=True))
        odds = prior + np.einsum("prv,rv->p", hot, weight)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - good).max() < 1e-6
        good = new
        if done:
            break
    return {"prior": float(prior), "weight": [dict(zip((-1, 0, 1), map(float, w), strict=True)) for w in weight]}


def log_odds(model: dict, at: str = "") -> Column:
    total = F.lit(model["prior"])
    for rule, weight in zip(RULES, model["weight"], strict=True):
        vote = F.col(f"{at}v_{rule}")
        total = total + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(weight[0])
    return total


def posterior(model: dict, at: str = "") -> Column:
    return 1 / (1 + F.exp(-log_odds(model, at)))


def base_failed(at: str = "") -> Column:
    n, repeated = F.col(f"{at}n_words"), F.col(f"{at}n_repeat_words")
    return (n < 20) | (100 * repeated > 30 * n)


def fitted(votes: DataFrame) -> dict:
    return fit([(tuple(r[:-1]), r[-1]) for r in vote_counts(votes).collect()])  # at most 3 ** len(RULES) rows


def assess(docs: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Per document: base counts, votes, base_failed, quality (posterior probability of good) and kept."""
    docs = own_columns(docs, "doc_id", "text")
    found = docs.select("doc_id", measures(docs.sparkSession, F.col("text")).alias("found")).select("doc_id", "found.*")
    found = materialise(found, "quality")
    model = fitted(found)
    return (
        found.withColumn("base_failed", base_failed())
        .withColumn("quality", posterior(model))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def keep_good(docs: DataFrame, threshold: float = 0.2) -> DataFrame:
    """The rows of docs that pass, all columns unchanged; texts are measured once, and kept with their votes until the model is fitted."""
    names = docs.columns
    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), measures(docs.sparkSession, F.col("text")).alias("found"))
    seen = materialise(seen, "quality")
    model = fitted(seen.select("found.*"))
    kept = ~base_failed("found.") & (posterior(model, "found.") >= threshold)
    return seen.where(kept).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    from ontoloom.llm.common import table

    found = assess(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "quality")
