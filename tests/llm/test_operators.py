"""Operators against brute-force versions and odd input: nulls, empty and long texts, ties, repeats, extra columns, empty tables."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ontoloom.llm import decontaminate, html_model, licences, line_dedup, minhash, packing, quality, registry, sharding, token_file, tokens, toxicity
from ontoloom.llm.common import new_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, rep long, set_key string, shard string, part string, ids string"


def odd_docs(spark, more=()):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = " ".join(rng.choices(words, k=80))
    texts = [None, "", " \n\t ", "one", "One", base, base, base.replace("w1 ", "w2 ", 1), "x " * 4000, "a b c\n" * 50, "Licensed under CC BY-NC 4.0.", *more]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(60)]
    rows = [(i, t, None, f"s{i % 13}", 0, "b", 1, "k", "s", "p", "i") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA), texts


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(texts, k, percent=80):
    sets = {i: minhash.shingle_set(minhash.words_of(t), k) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_brute_force(spark, k):
    docs, texts = odd_docs(spark)
    more = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id >= 100")
    rows = list(enumerate(texts)) + [(r.doc_id, r.text) for r in more.select("doc_id", "text").collect()]
    both = docs.select("doc_id", "text").union(more.select("doc_id", "text"))
    want, sizes = brute_components(rows, k)
    found = minhash.near_duplicates(both, k).collect()
    assert len(found) == both.count()
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.n_shingles for r in found} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert minhash.near_duplicates(empty(spark), k).count() == 0


def test_keep_one_keeps_columns(spark):
    docs, texts = odd_docs(spark)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    want, _ = brute_components(list(enumerate(texts)), 5)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_quality_counts_brute_force(spark):
    docs, texts = odd_docs(spark, more=["a b c d e f g h i a b c d e f g h j"])
    for r in quality.assess(docs).collect():
        text = texts[r.doc_id] or ""
        words = quality.WORD.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality.assess(empty(spark)).count() == 0


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    found = quality.assess(spark.read.parquet(f"{d}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id").select("kept", "label").collect()
    assert sum(r.kept == (r.label == 1) for r in found) > 0.95 * len(found)


def test_line_dedup_against_sql(spark):
    docs, _ = odd_docs(spark, more=[f"shared line\nown {i}\n" for i in range(30)] + ["shared line"] * 3)
    docs = docs.dropDuplicates(["doc_id"]).where("text is not null")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    want = {r[0]: r[1:] for r in con.execute(line_dedup.OP3_SQL).fetchall()}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want
    assert sum(x[2] for x in got.values()) == 32
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    assert line_dedup.dedup_lines(docs.sparkSession.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first().text is None


def test_line_dedup_near_threshold_is_exact(spark):
    rows = [(i, f"line {k}", f"site{i % k}") for k in range(5, 17) for i in range(1000 * k, 1000 * k + 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r.text for r in line_dedup.dedup_lines(docs).where("n_removed = 0").groupBy("text").count().where("count = 40").collect()}
    assert gone == {f"line {k}" for k in range(5, 10)}


def test_decontamination_slots(spark):
    item = "A train leaves Paris at 7 miles per hour and meets Anna after 12 hours of steady travel near the old bridge. How far did it go?"
    same = item.replace("Paris", "London").replace("7", "9").replace("Anna", "Bert").replace("12", "30")
    clash = item.replace("Paris", "London").replace("Anna", "London")
    docs = spark.createDataFrame([(1, f"Intro. {same} More."), (2, f"Intro. {clash} More."), (3, None), (4, item), (5, ""), (6, "unrelated words only here"), (4, item)], "doc_id long, text string")
    items = spark.createDataFrame([(0, item), (1, None), (2, "tiny words of five here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 0): True, (4, 0): False}
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.without_leaks(docs, items).columns == docs.columns


def test_licences(spark):
    bsd = ". ".join(licences.SENTENCES[i][0] for i in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"))
    docs, _ = odd_docs(spark, more=[bsd, "Released under the MIT License. text", bsd.rpartition(". ")[0]])
    got = {(r.doc_id, r.licence) for r in licences.scan(docs).collect()}
    assert got == {(10, "CC-BY-NC-4.0"), (11, "BSD-3-Clause"), (12, "MIT"), (13, "BSD-2-Clause")}
    assert licences.scan(empty(spark)).count() == 0
    assert all(any(k in s for k in licences.KEYWORDS) for all_of in licences.SENTENCES.values() for s in all_of)


def test_shards(spark):
    docs, texts = odd_docs(spark)
    rows = sharding.shard(docs).toPandas()
    assert len(rows) == len(texts) + 1
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    for r in rows.itertuples(index=False):
        raw = (texts[r.doc_id] or "").encode()
        assert r.text_crc32 == zlib.crc32(raw)
    per = rows.groupby("shard")["size"].sum()
    assert per.max() - per.min() <= 2 * rows["size"].max() + 1
    assert sharding.shard(empty(spark)).count() == 0


def test_packing_and_token_file(spark):
    docs, texts = odd_docs(spark, more=["  lead", "trail  ", "a\n\nb", "tab\tx  y", "wednesday", "<|endoftext|>", "\x00x", "é ́ İ. Σς"])
    path = tokens.default_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, x in enumerate(texts)}
    got = packing.pack(docs, path).toPandas().sort_values(["sequence_id", "offset"])
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert got["length"].sum() == sum(map(len, ids.values())) + len(ids[5])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 1024
    assert packing.pack(empty(spark), path).count() == 0
    path = tokens.default_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = new_path(spark, "test-orc")
    token_file.write(docs, out, path)
    start = 0
    for r in token_file.index(spark, out).orderBy("doc_id", "start").collect():
        want = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert [len(r.ids) for r in token_file.read(spark, out, [0]).collect()] == [1]


def test_fullest_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        room, counts = rng.randint(1, 40), {rng.randint(1, 15): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        chosen = packing.fullest(counts, room)
        assert sum(k * v for k, v in chosen.items()) == max(sums)
        assert all(v <= counts[k] for k, v in chosen.items())


def test_html():
    model = html_model.train(html_model.training_pages())
    for page, content in html_model.training_pages(60, seed=99):
        assert [x for x in html_model.extract(page, model).split("\n\n") if x] == content
    assert html_model.extract(None, model) == html_model.extract("", model) == ""
    assert html_model.extract("plain &amp;  text", model) == "plain & text"
    html_model.extract("<div>" * 3000 + "x" * 10000, model)
    html_model.extract("<p <b a='", model)


def test_marginals_brute_force():
    """Sum-product against the sum over all labellings."""
    from itertools import product
    from math import exp

    model = html_model.train(html_model.training_pages(60))
    nodes, _ = html_model.parse("<nav><ul><li><a href=x>a</a></li></ul></nav><article><h1>T</h1><p>Some text, here.</p></article><footer>f</footer>")
    feats = html_model.features(nodes)
    total, on = 0.0, [0.0] * len(nodes)
    for labels in product((0, 1), repeat=len(nodes)):
        p = model["start"][labels[0]]
        for i, x in enumerate(nodes):
            p *= exp(sum(model["unary"].get(f, (0, 0))[labels[i]] for f in feats[i]))
            if i:
                p *= model["pair"][html_model.edge_kind(x)][labels[x.parent]][labels[i]]
        total += p
        for i, y in enumerate(labels):
            on[i] += p * y
    assert np.allclose([x / total for x in on], html_model.marginals(nodes, model))


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    hit = sum(r.score >= 0.3 and r.toxic == 1 for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows)  # labels of this table are noisy
    assert hit >= 0.9 * sum(r.score >= 0.3 for r in rows)
    odd, texts = odd_docs(spark)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == len(texts) + 1 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_text("you idiot", none, toxicity._WordWeights({})) > toxicity.score_text("", none, toxicity._WordWeights({}))


def test_sql_of_registry(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    for name, sql in registry.SQL.items():
        df = registry.QUERIES[name](spark, DATA)
        names = sorted(df.columns)
        want = con.execute(f"select {', '.join(names)} from ({sql})").fetchall()
        assert Counter(map(tuple, df.select(*names).collect())) == Counter(want), name


def test_pipeline_brute_force(spark):
    """The pipeline's documents against its rules applied one by one."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    verdict = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in verdict}
    spread = {}
    for i in sorted(rows):
        for n, line in enumerate(rows[i].text.split("\n")):
            if line.strip(" "):
                first, sites = spread.setdefault(line.strip(" "), ((i, n), set()))
                sites.add(rows[i].source)
    texts = {}
    for i, r in rows.items():
        lines = r.text.split("\n")
        kept = [x for n, x in enumerate(lines) if not (x.strip(" ") in spread and len(spread[x.strip(" ")][1]) >= 10 and spread[x.strip(" ")][0] != (i, n))]
        if len(kept) == len(lines) or "".join(kept).strip():
            texts[i] = "\n".join(kept)
    roots, _ = brute_components(sorted(texts.items()), 5)
    left = {i for i in texts if roots[i] == i}
    norm = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {i for i in left if not any(x in norm(texts[i]) for x in items)}
    got = corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == left
