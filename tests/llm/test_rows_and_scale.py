"""Odd tables, rows that share an id, parts that are set small so that their borders are met, and growth."""

import random
import time
import zlib

import pyarrow.orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ontoloom.llm import decontaminate, html_model, line_dedup, minhash, packing, quality, sharding, token_file, tokens, toxicity
from ontoloom.llm.common import cleanup, new_path

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lines_of_rows_that_share_a_doc_id(spark):
    shared = [(i, f"menu\nown {i}", None, f"s{i}", 0) for i in range(100, 112)]
    rows = [(5, "menu\nkeep me", None, "a", 0), (5, "keep me\nmenu\nand me", None, "b", 0), (None, "menu\nx", None, "c", 0), *shared, shared[0]]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert ("keep me\nand me", 3, 1) in {tuple(r)[1:] for r in got if r.doc_id == 5}
    assert ("menu\nkeep me", 2, 0) in {tuple(r)[1:] for r in got if r.doc_id == 5}
    assert [r.text for r in got if r.doc_id is None] == ["menu\nx"]
    assert all(r.text == f"own {r.doc_id}" for r in got if r.doc_id and r.doc_id >= 100) and len(got) == len(rows)


def test_line_dedup_ignores_white_space_at_ends(spark):
    ends = ["{}", "\t{}", "{}\r", " {}\f", "\v{} ", "{}"]
    rows = [(i, f"own words {i}\n" + ends[i % 6].format("boiler line"), f"site{i}") for i in range(18)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].n_removed == 0 and all(got[i].text == f"own words {i}" for i in range(1, 18))


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["_gone", "n_removed", "n_lines", "_d", "_t", "h1", "pos", "first", "c0", "found", "row"]
    docs = spark.createDataFrame([(i, "menu\nown", f"s{i}", 4, *["v"] * len(names)) for i in range(12)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    kept = line_dedup.without_boilerplate(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars, r._gone, r.n_removed) for r in kept.collect()} == {(0, "menu\nown", 4, "v", "v")}
    assert line_dedup.dedup_lines(docs).where("n_removed = 2").count() == 11
    for keep in (quality.keep_good, minhash.keep_one, lambda d: decontaminate.without_leaks(d, spark.createDataFrame([(1, "menu own")], "item_id long, text string"))):
        assert keep(docs).columns == docs.columns


@pytest.mark.parametrize("at", [[], [0], [1, 2], [0, 3], [0, 1, 2, 3]])
def test_cut(spark, at):
    lines = ["a", "", " c", "d"]
    df = spark.createDataFrame([("\n".join(lines), at)], "text string, at array<int>")
    assert df.select(line_dedup._cut(F.col("text"), F.col("at"))).first()[0] == "\n".join(x for i, x in enumerate(lines) if i not in at)


def test_shards_with_small_ranges(spark, monkeypatch):
    """Hot texts, null ids and repeats over many subdivisions: gapless slots, near equal bytes, the order of keys."""
    monkeypatch.setattr(sharding, "RANGES", 4)
    monkeypatch.setattr(sharding, "SAMPLE", 5)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 7)
    rng = random.Random(2)
    texts = ["hot"] * 150 + ["warm text"] * 40 + [None] * 20 + ["word " * rng.randint(1, 60) + str(i) for i in range(250)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, "hot")] * 15
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs).toPandas()
    assert len(got) == len(rows)
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 8 for _, t in rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    per = got.groupby("shard")["size"].sum()
    assert len(per) == sharding.SHARDS and per.max() - per.min() <= 2 * got["size"].max() + 1
    cut = sharding.subdivided(sharding.keyed(docs).withColumn("range", F.lit(0)))
    parts = sorted(((r.range, *r.sub), (r.k, r.d)) for r in cut.collect())
    assert [k for _, k in parts] == sorted(k for _, k in parts)
    sizes = cut.groupBy("range", "sub").count().toPandas()["count"]
    assert sizes.max() <= 40


def test_packing_ranks_over_shelves_and_its_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHELF_ROWS", 5)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None), (10**9, "x " * 9000)], "doc_id long, text string"))
    got = packing.pack(docs, tokens.default_path("byte_bpe_50k.json")).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    used = got.groupby("sequence_id")["length"].sum()
    assert used.max() <= 1024 and len(used) <= -(-got["length"].sum() // 1024) * 1.02 + 1


def test_token_file_start_follows_the_files(spark):
    """Rows that share a doc_id: starts are those of the files' own order."""
    rows = [(7, "two words"), (7, "a"), (7, "some more words stand in this one"), (3, "first"), (None, "no id"), (9, None), (7, "a")]
    out, path = new_path(spark, "test-orc"), tokens.default_path("word_bpe_49k.json")
    token_file.write(spark.createDataFrame(rows, "doc_id long, text string"), out, path, parts=3)
    library = Tokenizer.from_file(path)
    stored = sorted(token_file.read(spark, out).collect(), key=lambda r: (r.part, r.row))
    assert sorted(list(r.ids) for r in stored) == sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows)
    assert [r.doc_id for r in stored] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    start, want = 0, []
    for r in stored:
        raw = b"".join(i.to_bytes(4, "little") for i in r.ids)
        want.append((r.doc_id, start, len(r.ids), zlib.crc32(raw)))
        start += len(r.ids)
    assert rows_of(token_file.index(spark, out)) == sorted(want, key=repr)


def test_token_file_prunes_stripes(spark):
    out, path = new_path(spark, "test-orc"), tokens.default_path("word_bpe_49k.json")
    docs = spark.range(0, 60_000, 7).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    stripe = token_file.ORC["orc.stripe.size"]
    token_file.ORC["orc.stripe.size"] = "20000"
    try:
        token_file.write(docs, out, path, parts=1)
    finally:
        token_file.ORC["orc.stripe.size"] = stripe
    files = [r[0] for r in spark.read.format("binaryFile").load(out).select("path").collect() if r[0].endswith(".orc")]
    file = pyarrow.orc.ORCFile(files[0].removeprefix("file:"))
    assert len(files) == 1 and file.nstripes > 1 and file.compression == "ZSTD"
    plan = token_file.read(spark, out, [14])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [14])]" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,14)]" in plan
    assert [len(r.ids) for r in token_file.read(spark, out, [14]).collect()] and token_file.read(spark, out, [15]).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    path = new_path(spark, "test-orc")
    token_file.write(docs, path, tokens.default_path("word_bpe_49k.json"))
    assert token_file.index(spark, path).count() == 0
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(docs, model).count() == 0
    assert html_model.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    for name, stage in __import__("corpus_pipeline").STAGES:
        assert stage(spark, docs, DATA).count() == 0, name


def test_pipeline_stages_take_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeats, rows that share a doc_id: all but the last stage keep the columns."""
    prose = "It was a long day, and the people of the town were on their way to the market by the river. " * 3
    rows = [(1, prose, "en", "s", 5), (1, prose, "en", "s", 5), (1, "another text. " + prose, None, None, None), (None, prose, None, None, None), (2, None, None, "s", 0), (3, "", "", "", 0), (4, "x " * 30_000, "en", "s", 0), (5, " \n\t", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    *stages, last = __import__("corpus_pipeline").STAGES
    for name, stage in stages:
        out = stage(spark, docs, DATA)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.count() <= len(rows)
    assert last[1](spark, docs, DATA).select("doc_id").distinct().count() == 6


def test_near_duplicates_in_small_cells(spark, monkeypatch):
    """A chain of near copies, repeated rows and ids with two texts, with parts of four members, against all pairs."""
    monkeypatch.setattr(minhash, "CELL", 4)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    rows, now = [], list(base)
    for i in range(60):
        now = list(now)
        for _ in range(rng.choice([1, 2, 6])):
            now[rng.randrange(len(now))] = rng.choice(words)
        rows.append((i, " ".join(now)))
    rows += [(100 + i, " ".join(rng.choices(words, k=80))) for i in range(40)]
    rows += [rows[3], rows[3], rows[7], (5, " ".join(rng.choices(words, k=50)))]
    sets = [(i, minhash.shingle_set(minhash.words_of(t), 2)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[n + 1 :]:
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in root}


def test_near_duplicate_recall_at_the_threshold(spark):
    """Pairs whose exact similarity is 0.80 to 0.85, each with words of its own."""
    rng = random.Random(4)
    rows, pairs = [], 0
    for n in range(300):
        words = [f"a{n}x{i}" for i in range(rng.randint(60, 200))]
        other = list(words)
        for i in rng.sample(range(len(words)), max(1, round(len(words) * 0.05))):
            other[i] = f"b{n}x{i}"
        x, y = (minhash.shingle_set([w.encode() for w in t], 2) for t in (words, other))
        if 80 <= 100 * len(x & y) / len(x | y) < 85:
            pairs += 1
            rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    found = got.where("not kept").count()
    assert pairs > 100 and found >= 0.99 * pairs


def test_decontamination_over_block_borders(spark, monkeypatch):
    """Results don't depend on how texts are cut into blocks; ids with two texts and null ids are searched each."""
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    text = items.orderBy("item_id").first().text
    odd = [(1, "before " * 17 + text), (1, "no item"), (None, text.replace(" the ", " a ", 1)), (2, " ".join(["filler"] * 900) + " " + text), (2, "  "), (3, None)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    whole = rows_of(decontaminate.contaminated(docs, items))
    assert {r[0] for r in whole} >= {1, 2, None}
    kept = decontaminate.without_leaks(docs, items)
    assert kept.where("doc_id = 1 and text = 'no item'").count() == 1 and kept.where("doc_id is null").count() == 0
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    assert rows_of(decontaminate.contaminated(docs, items)) == whole


def test_decontamination_brute_force(spark):
    """Every document that holds an item's words in a row is found, whatever stands around; documents without a window in common are not."""
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t or "").split())
    texts = {r.doc_id: f" {plain(r.text)} " for r in docs.collect()}
    wanted = {r.item_id: plain(r.text) for r in items.collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got >= {(d, i) for d, t in texts.items() for i, x in wanted.items() if f" {x} " in t}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, x.split()) for i, x in wanted.items())}
    for d, i in got:
        w = texts[d].split()
        assert not grams[i] or grams[i] & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_extracted_pages(spark):
    """The query over a whole table, and odd rows, against the extraction of single pages."""
    model = html_model.train(html_model.training_pages())
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = sorted((r.page_id, r.url, t, len(t)) for r in pages.collect() for t in [html_model.extract(r.html, model)])
    assert sorted(map(tuple, html_model.op8_html_extraction(spark, DATA).collect())) == want
    odd = spark.createDataFrame([(1, "u", None, "z"), (2, None, "", "z"), (None, "u", "<p>" + "a b, c. " * 20_000 + "</p>", "z"), (3, "u", "plain", "z"), (3, "u", "plain", "z")], "page_id long, url string, html string, text string")
    got = html_model.extracted(odd, model).collect()
    assert sorted((r.page_id or 0, r.url, r.n_chars) for r in got if r.page_id != 2) == [(0, "u", 159_999), (1, "u", 0), (3, "u", 5), (3, "u", 5)]


ADVERSE = {
    "quotes": lambda n: "<p a='\"> " * n,
    "unclosed": lambda n: "<p x=\"a'>b" * n,
    "no end": lambda n: "<a" * n,
    "declarations": lambda n: "<!x" * n,
    "stray ends": lambda n: "<b>" * n + "</i>" * n,
    "deep": lambda n: "<div>" * n + "</p>" * n,
    "half ends": lambda n: "<svg>" * n + "</svg " * n,
    "headings": lambda n: "<h1>" * n + "<p>" * n,
    "classes": lambda n: "<p " + "class='" * n + ">",
}


@pytest.mark.parametrize("name", sorted(ADVERSE))
def test_parser_time_is_linear(name):
    start = time.process_time()
    html_model.parse(ADVERSE[name](60_000))
    assert time.process_time() - start < 12


def test_quotes_that_do_not_close_hide_no_text():
    found = [t for _, t in html_model.parse("<p title=\"x>one</p><p>two &#00065;&#x0000041; &#" + "9" * 5000 + ";</p>")[1]]
    assert " ".join(found).endswith("two AA �") and "one" in " ".join(found)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(None, "you idiot", 1), (1, "b", 1), (1, "a", 1), (1, "a", 1), (2, None, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, 1), (2, None)], "doc_id long, toxic int")
    assert [(r.doc_id, r.text, r.toxic) for r in toxicity.training_rows(docs.select("doc_id", "text"), labels, 10).collect()] in ([(1, "a", 1)], [])
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 5 and all(r.held_out in (True, False) and 0 <= r.score <= 1 for r in got)


def test_mined_entries_brute_force(spark):
    """Every entry that passes is mined, however rare it is beside the others."""
    rng = random.Random(6)
    common = [f"common{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = [(i, " ".join(rng.choices(common, k=60)) + (" rareslur" if i % 40 == 0 else "") + (" oftenslur" if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(400)]
    mined = toxicity.strong_entries(spark.createDataFrame(texts, "doc_id long, text string, toxic int"), 50, 350)
    assert {"rareslur", "oftenslur", "rare*", "often*"} <= set(mined) and not any(e.startswith("common") for e in mined)


def test_label_model_against_all_states():
    """The posterior of the tree model is Bayes' rule over its tables; it beats a majority vote where voters repeat each other."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 3000
    y = rng.random(n) < 0.2
    good = [rng.random(n) < np.where(y, 0.7, 0.05) for _ in range(3)]
    copied = rng.random(n) < np.where(y, 0.4, 0.3)
    votes = np.stack([*good, *[np.where(rng.random(n) < 0.97, copied, ~copied) for _ in range(4)]], axis=1)
    noisy = np.where(rng.random(n) < 0.15, ~y, y)
    post = toxicity.LabelModel([np.flatnonzero(v) for v in votes], votes.shape[1]).fit(noisy.astype(float))
    majority = votes.sum(1) * 2 > votes.shape[1]
    assert ((post > 0.5) == y).mean() > max((majority == y).mean(), (noisy == y).mean()) + 0.02


def test_posterior_labels_beat_a_majority_vote(spark):
    """On held-out labelled rows, the classifier of the posterior labels against the voters' majority."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("text", "toxic").collect()
    lookup = toxicity._WordWeights(model["entries"])
    right = votes_right = 0
    for r in rows:
        words = toxicity.words_in(r.text)
        fired = len({e for w in words for e in toxicity.entries_of(w) if e in model["entries"]}) + len(toxicity.patterns_in(r.text, words))
        votes_right += (fired >= 2) == bool(r.toxic)
        right += (toxicity.score_text(r.text, model, lookup) >= 0.5) == bool(r.toxic)
    assert right >= votes_right


def test_cleanup_deletes_what_was_made(spark):
    path = new_path(spark, "made")
    spark.range(3).write.parquet(path)
    cleanup(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
