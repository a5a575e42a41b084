"""Source divergence, token counts and Merkle manifest against plain versions and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ontoloom.llm import divergence, merkle, registry, token_counts, tokens
from ontoloom.llm.common import new_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, digest string, g long, p long, pos string, way string, term string, value string"
EXTRA = ("x", "y", 1, 2, "p", "w", "t", "v")


def docs(spark, rows):
    """rows of (doc_id, text, lang, source); other columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in rows], SCHEMA)


def odd_rows():
    rng = random.Random(5)
    words = ["the", "The", "über", "naïve", "a1b", "x_y", "漢字", "wort", "of"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "s3", None, ""])) for i in range(150)]
    rows += [(None, None, None, None), (None, "No id HERE", "en", "s1"), (7, "", "fr", "only"), (8, " \t\n", "fr", "empty"), (9, "Long " * 30_000, "en", "s2"), (-3, "minus Ü", "de", "s1")]
    return rows + rows[:3] + [rows[9]] * 2


def brute_audit(rows, least=10, top=10):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in term.findall(text or "")]
        counts[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        of, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pair = [(o, sum(f(of[s][t], of[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(of[s][t], q[t])) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", terms, top)):
                best = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(best)]
    return Counter(out)


def test_divergence_brute_force(spark):
    rows = odd_rows()
    found = divergence.audit(docs(spark, rows).repartition(3))
    assert found.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert Counter(map(tuple, found.collect())) == brute_audit(rows)


def test_divergence_small_parts(spark, monkeypatch):
    """Runs that end anywhere, pairs in small pieces and no broadcast give the same."""
    rows = odd_rows()
    want = brute_audit(rows, least=3, top=2)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "BATCH_ROWS", 4)
    assert Counter(map(tuple, divergence.audit(docs(spark, rows), least=3, top=2).collect())) == want
    runs = [("en", t, s, 1, 1, n) for t in "ab" for s in "xyz" for n in (1, 2)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "source", "document", "df", "n"), r, strict=True))]) for r in runs]
    assert [tuple(r.values()) for b in divergence._scanned(iter(batches)) for r in b.to_pylist()] == [("en", t, s, 2, 3) for t in "ab" for s in "xyz"]
    monkeypatch.setattr(divergence, "HELD_PAIRS", 1)
    shared = pa.RecordBatch.from_pylist([{"lang": "en", "term": t, "g": g, "p": 10 + g * 7, "p0": 3} for t in "ab" for g in range(4)])
    got = Counter()
    for b in divergence._paired(iter([shared])):
        for r in b.to_pylist():
            got[r["a"], r["b"]] += r["value"]
    f = lambda x, y: (x - y) ** 2 // (x + y)
    assert got == {(a, b): 2 * (f(10 + a * 7, 10 + b * 7) - f(10 + a * 7, 3) - f(3, 10 + b * 7)) for a in range(4) for b in range(a + 1, 4)}


def test_divergence_large_counts(spark):
    """Counts whose product with 10^9 passes 64 bits."""
    df = spark.createDataFrame([(40_000_000_000, 90_000_000_000, 3)], "n long, total long, v long")
    got = df.select(divergence._p(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (40_000_000_000 + 2) // (90_000_000_000 + 6)


def test_empty_tables(spark):
    none = docs(spark, [])
    path = tokens.default_path("byte_bpe_50k.json")
    assert divergence.audit(none).collect() == []
    assert token_counts.count_tokens(none, path, new_path(spark, "cache")).collect() == []
    made = merkle.build(none, new_path(spark, "manifest"))
    assert made.root is None and made.proofs().collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_are_the_library_s(spark, name):
    path = tokens.default_path(name)
    rows = odd_rows() + [(500, "<|endoftext|> and <|startoftext|> within", "en", "s"), (501, "  two  spaces\n\nlines ", "en", "s"), (502, "</s> <s> <unk>", "en", "s")]
    if name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    else:
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = token_counts.count_tokens(docs(spark, rows), path, new_path(spark, "cache"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == Counter((i, len((t or "").encode()), n := count(t or ""), n > 1024) for i, t, _, _ in rows)


def test_token_cache_grows_by_distinct_misses(spark, monkeypatch):
    path, cache = tokens.default_path("byte_bpe_50k.json"), new_path(spark, "cache")
    monkeypatch.setattr(token_counts, "BROADCAST_MISSES", 0)
    key = token_counts.tokenizer_key(path)
    held = lambda: spark.read.parquet(f"{cache}/tokenizer={key}").count()
    texts = ["one text", "another text", None, ""]
    rows = [(i, texts[i % 4], "en", "s") for i in range(40)]
    first = token_counts.count_tokens(docs(spark, rows), path, cache).collect()
    assert len(first) == 40 and held() == 3
    assert Counter(token_counts.count_tokens(docs(spark, rows), path, cache).collect()) == Counter(first) and held() == 3
    more = token_counts.count_tokens(docs(spark, [*rows, (99, "a third text", "en", "s")]), path, cache).collect()
    assert len(more) == 41 and held() == 4
    # What is stored is taken as it is: a count that no encoding gives comes back.
    spark.createDataFrame([(bytearray(hashlib.sha256(b"planted").digest()), 77)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(f"{cache}/tokenizer={key}")
    assert token_counts.count_tokens(docs(spark, [(1, "planted", "en", "s")]), path, cache).collect() == [(1, 7, 77, False)]
    assert token_counts.tokenizer_key(tokens.default_path("word_bpe_49k.json")) != key


def test_token_cache_normal_form(spark):
    path, cache = tokens.default_path("word_bpe_49k.json"), new_path(spark, "cache")
    rows = [(1, "One TWO", "en", "s"), (2, "one two", "en", "s")]
    got = token_counts.count_tokens(docs(spark, rows), path, cache, normal=F.lower).collect()
    assert sorted(r["n_tokens"] for r in got) == [2, 2]
    assert spark.read.parquet(f"{cache}/tokenizer={token_counts.tokenizer_key(path)}").count() == 1


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, lower=False):
    i, text, lang, source = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _h("".join(map(part, (i, source, lang, len(row[1] or ""), text))))


def brute_manifest(rows):
    def climb(nodes):
        """Root, and per leaf its way as (place, run)."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
            for way, p in zip(ways, at, strict=True):
                way.append((p % 8, runs[p // 8]))
            nodes, at = [_h("".join(r)) for r in runs], [p // 8 for p in at]
        return nodes[0], ways

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, ways = {}, {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        subs[g], ways[g] = climb([_leaf(r) for r in groups[g]])
    root, above = climb([subs[g] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        for row, way in zip(groups[g], ways[g], strict=True):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            now = _leaf(row, bad)
            for p, run in way + up:
                now = _h("".join([*run[:p], now, *run[p + 1 :]]))
            proof = _h("".join("".join([*run[:p], *run[p + 1 :]]) for p, run in way + up))
            out.append((row[0], _leaf(row), subs[g], root, proof, now, now == root))
    return Counter(out)


def _manifest(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "table", lambda *_: docs(spark, rows).repartition(5))
    return Counter(map(tuple, merkle.op13_merkle_manifest(spark, "").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


def test_manifest_brute_force(spark, tmp_path, monkeypatch):
    rows = odd_rows()
    assert _manifest(spark, rows, tmp_path, monkeypatch) == brute_manifest(rows)


@pytest.mark.parametrize("rows", [[(1, "Alone", "en", "s")], [(1, "Same", None, "s")] * 9, [(i, "T", f"l{i:03}", "s") for i in range(70)]])
def test_manifest_shapes(spark, tmp_path, monkeypatch, rows):
    """One leaf, repeated rows with a run of one, more languages than a run holds; joins without broadcast."""
    monkeypatch.setattr(merkle, "BROADCAST_IDS", 0)
    assert _manifest(spark, rows, tmp_path, monkeypatch) == brute_manifest(rows)


def test_manifest_finds_what_changed(spark):
    """The library's own interface: a later version is checked row by row against the stored proofs."""
    rows = [(i, f"Text {i}", "en", "s") for i in range(30)]
    store = new_path(spark, "manifest")
    made = merkle.build(docs(spark, rows), store)
    later = docs(spark, [(i, t if i != 11 else "changed", lang, s) for i, t, lang, s in rows])
    now = merkle.leaves(later).select("doc_id", "leaf")
    checked = made.proofs().join(now, "doc_id").select("doc_id", (merkle.folded(F.col("leaf"), F.col("way")) == made.root).alias("ok"))
    assert [r["doc_id"] for r in checked.where("not ok").collect()] == [11]
    assert spark.read.parquet(f"{store}/level=0").count() == 30 and spark.read.parquet(f"{store}/level=2").count() == 1


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_merkle_manifest"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    cur = con.execute(registry.SQL[name])
    names = [c[0] for c in cur.description]
    df = registry.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(cur.fetchall())
