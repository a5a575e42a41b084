"""A training-corpus pipeline over `documents`; counted as part of ontoloom.llm.

Stages: quality rules (rejected documents go), line dedup (boilerplate lines
go, with documents that hold nothing else), near-duplicate removal (one
document of each group stays), benchmark decontamination (documents that hold
an item go), best-fit packing (the last stage returns the packed pieces).
"""

from __future__ import annotations

from ontoloom.llm import decontaminate, line_dedup, minhash, packing, quality, tokens
from ontoloom.llm.common import materialise, table


def quality_rules(spark, docs, sf_dir):
    return quality.keep_good(docs)


def dedup_lines(spark, docs, sf_dir):
    return line_dedup.without_boilerplate(docs)


def near_dedup(spark, docs, sf_dir):
    return minhash.keep_one(docs, shingle=5, percent=80)


def decontamination(spark, docs, sf_dir):
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark, docs, sf_dir):
    return packing.pack(docs, tokens.default_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Expectation-maximisation, MinHash and packing can't be put into SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
