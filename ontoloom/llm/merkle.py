"""A Merkle manifest of a dataset: an external-memory store of nodes, proofs by coordinate, folding of proofs.

A row's leaf is the SHA-256 (lower-case hex) of its columns, each written as `-`
where null and else as its UTF-8 byte count, `:` and the value.  Leaves are
sorted by (lang, doc_id, leaf) into runs, one a partition; a leaf's coordinate
in its language is its place in its run plus the leaves of the runs before it,
so no task and no driver sees a whole language.  Every level is one Parquet
folder (`level=k`) of rows (grp, pos, n, digest, run): coordinate, how many
nodes the level has in that language, digest, and the digests of the up to 8
nodes below.  A level reads the one before it once, by narrow rows.  The roots of
languages are the leaves of a tree of the same kind on top.

Proofs come from merging levels by coordinate from the top down: a node's way up
is its run with its place in it, and then its parent's way.  Ways are made for
runs of leaves, not for leaves, so a level moves an eighth of the rows of the
one below; the last merge gives each leaf its way.

Null languages are one group, before all others; rows without doc_id come first
in theirs.  Repeated rows are leaves each.  An empty table has no root and gives
no rows.  Extra columns are left out.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm.common import BROADCAST_IDS, discard, materialise, new_path, own_columns, table

#: Columns of a row that its leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes below a node.
FAN = 8
#: A way up: a node's place in its run and the run, from its own level to the root.
WAY = "array<struct<at:int,run:array<string>>>"


def framed(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """The leaf of a row of documents, with other values for the columns named."""
    return digest(F.concat(*[framed(changed.get(c, F.col(c))) for c in COLUMNS]))


def leaves(docs: DataFrame, **also: Column) -> DataFrame:
    """(doc_id, grp, leaf) and the columns of `also`; grp orders as lang does, null first."""
    docs = own_columns(docs, *COLUMNS)
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select("doc_id", grp.alias("grp"), leaf().alias("leaf"), *[v.alias(k) for k, v in also.items()])


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their coordinate `pos` in their grp by `order`, and n, the number of the grp's rows.

    Sorted runs are written once; the runs' lengths, one row a run and grp, give where each begins.
    """
    by = [F.col("grp"), *order]
    run = rows.repartitionByRange(*by, F.monotonically_increasing_id()).sortWithinPartitions(*by)
    run = materialise(run.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "leaf-runs")
    size = run.groupBy("_part", "grp").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_k"))
    mine = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_k").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(size.select("_part", "grp", (before - F.col("_first")).alias("_shift"), F.sum("_k").over(mine).alias("n")), "run-starts")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_IDS else starts
    return run.join(starts, ["_part", "grp"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def _write(nodes: DataFrame, store: str, level: int) -> DataFrame:
    path = f"{store}/level={level}"
    nodes.write.option("compression", "zstd").parquet(path)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(path)


def _above(nodes: DataFrame) -> DataFrame:
    """The next level of the groups that have several nodes."""
    runs = nodes.where("n > 1").groupBy("grp", F.expr(f"pos div {FAN}").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
    runs = runs.agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run"))  # FAN nodes at most
    runs = runs.select("grp", "pos", "n", F.transform("run", lambda x: x["digest"]).alias("run"))
    return runs.select("grp", "pos", "n", digest(F.array_join("run", "")).alias("digest"), "run")


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def grow(base: DataFrame, store: str) -> list[DataFrame]:
    """Levels 0 and up of the trees over base (grp, pos, n, digest, other columns), each written under store and read again."""
    levels = [_write(base, store, 0)]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    for k in range(1, height(most) + 1):
        levels.append(_write(_above(levels[-1]), store, k))
    return levels


def ways(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """(grp, pos, n, digest, run, way, and top's columns) of level 1, where way lists (at, run) from a node's own place up to the root.

    top: (grp, way, ...) of the single node that a grp ends with.
    """
    extra = [c for c in top.columns if c not in ("grp", "way")]
    above = None
    for k in range(len(levels) - 1, 0, -1):
        ends = levels[k].where("n = 1").join(top, "grp")
        if above is None:
            now = ends
        else:
            below = levels[k].where("n > 1").withColumn("_up", F.expr(f"pos div {FAN}"))
            parent = above.select("grp", F.col("pos").alias("_up"), F.col("run").alias("_run"), F.col("way").alias("_way"), *extra)
            step = F.array(F.struct((F.col("pos") % FAN).cast("int").alias("at"), F.col("_run").alias("run")))
            now = below.join(parent, ["grp", "_up"]).select("grp", "pos", "n", "digest", "run", F.concat(step, "_way").alias("way"), *extra)
            now = ends.select(*now.columns).union(now)
        last, above = above, materialise(now, "ways")
        if last is not None:
            discard(last)
    return above


def siblings(way: Column) -> Column:
    """The digests beside a node, level by level, from left to right, as one text."""
    return F.array_join(F.flatten(F.transform(way, lambda s: F.concat(F.slice(s["run"], F.lit(1), s["at"]), F.slice(s["run"], s["at"] + 2, F.lit(FAN))))), "")


def folded(start: Column, way: Column) -> Column:
    """The root that a leaf gives with its way up."""
    step = lambda now, s: digest(F.concat(F.array_join(F.slice(s["run"], F.lit(1), s["at"]), ""), now, F.array_join(F.slice(s["run"], s["at"] + 2, F.lit(FAN)), "")))
    return F.aggregate(way, start, step)


@dataclass
class Manifest:
    """levels: of the languages' trees; top: (grp, subroot, way) of each language's root in the tree over them; root: None for no rows."""

    levels: list[DataFrame]
    top: DataFrame
    root: str | None

    def proofs(self) -> DataFrame:
        """Level 0 with subroot and way, merged by coordinate with the ways of the runs above."""
        base = self.levels[0]
        alone = base.where("n = 1").join(self.top, "grp")
        if len(self.levels) == 1:
            return alone
        up = ways(self.levels, self.top).select("grp", F.col("pos").alias("_up"), F.col("run").alias("_run"), F.col("way").alias("_way"), "subroot")
        own = F.array(F.struct((F.col("pos") % FAN).cast("int").alias("at"), F.col("_run").alias("run")))
        many = base.where("n > 1").withColumn("_up", F.expr(f"pos div {FAN}")).join(up, ["grp", "_up"])
        return many.select(*base.columns, "subroot", F.concat(own, "_way").alias("way")).union(alone.select(*base.columns, "subroot", "way"))


def build(docs: DataFrame, store: str, **also: Column) -> Manifest:
    """Write the tree over docs under store; `also` names columns that level 0 carries besides doc_id."""
    cut = materialise(leaves(docs, **also), "leaves")
    base = placed(cut, F.col("doc_id").asc_nulls_first(), F.col("leaf"))
    levels = grow(base.select("grp", "pos", "n", F.col("leaf").alias("digest"), "doc_id", *also), store)
    ends = [level.where("n = 1").select("grp", "digest") for level in levels]
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.union(more)
    subroots = materialise(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("lang_grp"), "digest"), "subroots")  # one row a language
    over = grow(placed(subroots, F.col("lang_grp")).select("grp", "pos", "n", "digest", "lang_grp"), f"{store}/top")
    last = over[-1].where("n = 1").select("digest").first()
    end = over[-1].where("n = 1").select("grp", F.col("digest").alias("subroot"), F.array().cast(WAY).alias("way"))
    proven = Manifest(over, end, None).proofs()
    top = materialise(proven.select(F.col("lang_grp").alias("grp"), F.col("digest").alias("subroot"), "way"), "top-ways")
    return Manifest(levels, top, last[0] if last else None)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    made = build(docs, new_path(spark, "manifest"), shown=F.when(tampered, leaf(text=lowered)).otherwise(leaf()))
    out = made.proofs().select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(made.root).alias("root"), digest(siblings(F.col("way"))).alias("proof_sha256"), folded(F.col("shown"), F.col("way")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL climbs: as many as any driver table needs (8 ** 7 rows a language).
_SQL_LEVELS = 7
_H = lambda way, at, now: f"sha256(array_to_string({way}[1:{at}], '') || {now} || array_to_string({way}[{at} + 2:], ''))"


def _sql() -> str:
    frame = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    line = lambda text: "sha256(" + " || ".join(frame(text if c == "text" else c) for c in COLUMNS) + ")"
    # CRC-32 of the decimal doc_id, bit by bit.
    crc = "list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch) + 4294967296, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x - 4294967296) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [f"d AS (SELECT *, coalesce('=' || lang, '') AS grp, {line('text')} AS leaf, coalesce(xor({crc}, 4294967295) % 3 = 0, false) AS bad FROM documents)"]
    parts.append(f"t0 AS (SELECT doc_id, grp, leaf, leaf AS digest, CASE WHEN bad THEN {line(lowered)} ELSE leaf END AS shown, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d)")

    def climb(name: str) -> None:
        for k in range(_SQL_LEVELS):
            parts.append(f"{name}r{k} AS (SELECT grp, pos // 8 AS pos, (n + 7) // 8 AS n, list(digest ORDER BY pos) AS run FROM {name}{k} WHERE n > 1 GROUP BY grp, pos // 8, n)")
            parts.append(f"{name}{k + 1} AS (SELECT grp, pos, n, sha256(array_to_string(run, '')) AS digest FROM {name}r{k} UNION ALL SELECT grp, pos, n, digest FROM {name}{k} WHERE n = 1)")

    climb("t")
    parts.append(f"u0 AS (SELECT '' AS grp, grp AS of_grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t{_SQL_LEVELS})")
    climb("u")
    steps, joins, way, now = [], [], [], "shown"
    for name, at in (("t", "x"), ("u", "y")):
        for k in range(_SQL_LEVELS):
            joins.append(f"LEFT JOIN {name}r{k} AS {name}{k}j ON {name}{k}j.grp = {at}.grp AND {name}{k}j.pos = {at}.pos // {8 ** (k + 1)}")
            way.append((f"{name}{k}j.run", f"{at}.pos // {8 ** k} % 8"))
    sibs = " || ".join(f"coalesce(array_to_string({run}[1:{at}], '') || array_to_string({run}[{at} + 2:], ''), '')" for run, at in way)
    parts.append(f"w AS (SELECT x.doc_id, x.leaf, x.shown AS f0, y.digest AS subroot, sha256({sibs}) AS proof_sha256, {', '.join(f'{run} AS r{i}, {at} AS a{i}' for i, (run, at) in enumerate(way))} FROM t0 AS x JOIN u0 AS y ON y.of_grp = x.grp {' '.join(joins)})")
    for i in range(len(way)):
        steps.append(f"w{i + 1} AS (SELECT *, CASE WHEN r{i} IS NULL THEN f{i} ELSE {_H(f'r{i}', f'a{i}', f'f{i}')} END AS f{i + 1} FROM {'w' if not i else f'w{i}'})")
    last = len(way)
    return "WITH " + ", ".join(parts + steps) + f" SELECT doc_id, leaf, subroot, (SELECT digest FROM u{_SQL_LEVELS}) AS root, proof_sha256, f{last} AS folded_root, f{last} = (SELECT digest FROM u{_SQL_LEVELS}) AS verified FROM w{last}"


OP13_SQL = _sql()
