"""Readers, writers and the stream on small hand-made files."""

from pyspark.sql import functions as F

from ontoloom.functions import parsing as P
from ontoloom.operators import labelled as L
from ontoloom.sources import annotations, stanzas
from ontoloom.streaming import ingest

ONTOLOGY = """format-version: 1.2
subsetdef: few "A few"

[Term]
id: X:1
name: top

[Term]
id: X:2
name: middle ! not a name
def: "A \\"middle\\" thing." [Y:9]
is_a: X:1 {source="z"} ! top
subset: few
alt_id: X:20
synonym: "mid" EXACT [Y:1, Y:2]
synonym: "m" []

[Term]
id: X:3
intersection_of: X:2
intersection_of: part_of X:1
relationship: part_of X:2
is_obsolete: true

[Typedef]
id: part_of
is_transitive: true
"""


def _line(**given):
    return "\t".join(given.get(x, "") for x in annotations.GAF)


def test_stanzas(spark, tmp_path):
    path = tmp_path / "x.obo"
    path.write_text(ONTOLOGY)
    tags = stanzas.read_tags(spark, str(path)).cache()
    found = {r["id"]: r for r in stanzas.entities(tags).collect()}
    assert set(found) == {"X:1", "X:2", "X:3", "part_of"}
    assert found["X:2"]["label"] == "middle" and found["X:2"]["alt_ids"] == ["X:20"] and found["X:2"]["subsets"] == ["few"]
    assert found["X:3"]["is_obsolete"] and not found["X:1"]["is_obsolete"]
    assert {tuple(r) for r in stanzas.edges(tags).collect()} == {("X:2", "X:1", "is_a"), ("X:3", "X:2", "is_a"), ("X:3", "X:1", "part_of"), ("X:3", "X:2", "part_of")}
    assert {(r["label"], r["scope"], tuple(r["xrefs"])) for r in stanzas.synonyms(tags).collect()} == {("mid", "EXACT", ("Y:1", "Y:2")), ("m", "RELATED", ())}
    closed = L.labelled_closure(stanzas.edges(tags), L.compositions(stanzas.properties(tags)))
    assert ("X:3", "X:1", "is_a", 2) in {tuple(r) for r in closed.collect()}
    out = str(tmp_path / "out")
    stanzas.write(stanzas.entities(tags), stanzas.edges(tags), out)
    again = stanzas.read_tags(spark, out)
    assert {tuple(r) for r in stanzas.edges(again).collect()} == {tuple(r) for r in stanzas.edges(tags).collect()}


def test_taxonomy(spark, tmp_path):
    path = tmp_path / "t.dat"
    path.write_text("ID : 1\nPARENT ID : 0\nRANK : no rank\nSCIENTIFIC NAME : root\nSYNONYM : all\n//\nID : 2\nPARENT ID : 1\nRANK : genus\nSCIENTIFIC NAME : Same\n//\nID : 3\nPARENT ID : 1\nRANK : family\nSCIENTIFIC NAME : Same\n//\n")
    got = {r["id"]: r for r in stanzas.read_taxonomy(spark, str(path)).collect()}
    assert got["1"]["rank"] is None and got["1"]["synonyms"] == ["all"] and got["2"]["label"] == "Same [2]" and got["3"]["parent"] == "1"


def test_annotation_rows(spark, tmp_path):
    path = tmp_path / "a.gaf"
    good = _line(db="D", object_id="1", qualifier="NOT|contributes_to", cls="X:1", reference="R:1|R:2", evidence="IPI", with_from="D:2", aspect="F", taxon="taxon:1|taxon:2", date="20200131", extension="part_of(X:2),a(b)|c(d)")
    path.write_text("!gaf-version: 2.0\n" + good + "\nshort\trow\n\n" + _line(db="D", object_id="2", date="bad").rsplit("\t", 2)[0] + "\n" + good + "\tmore\n")
    rows = annotations.read_rows(spark, str(path))
    assert sorted(r["status"] for r in rows.collect()) == ["long", "ok", "ok", "short"]
    got = {r["bioentity"]: r for r in annotations.typed(rows.where("status <> 'long'")).collect()}
    one = got["D:1"]
    assert one["flags"] == 3 and one["relation"] == "contributes_to" and str(one["date"]) == "2020-01-31" and one["interacting_taxon"] == "taxon:2"
    assert [[tuple(x) for x in g] for g in one["ext"]] == [[("part_of", "X:2"), ("a", "b")], [("c", "d")]]
    assert got["D:2"]["date"] is None and got["D:2"]["flags"] == 0 and got["D:2"]["ext"] == []
    out = str(tmp_path / "out")
    annotations.write_rows(rows.where("status = 'ok'"), out)
    assert annotations.read_rows(spark, out).where("status = 'ok'").count() == 2
    assert annotations.entities(rows).count() == 2


def test_parsing_of_nulls(spark):
    r = spark.createDataFrame([(None,), ("",)], "q string").select(P.qualifier_flags(F.col("q")).alias("f"), P.extensions(F.col("q")).alias("e"), P.relation(F.col("q"), F.col("q")).alias("r")).collect()
    assert [(x["f"], x["e"], x["r"]) for x in r] == [(0, [], None)] * 2


def test_other_tables(spark, tmp_path):
    (tmp_path / "g.gmt").write_text("S1\tlabel\ta\tb\nS2\tx\n")
    assert {tuple(r) for r in annotations.read_gene_sets(spark, str(tmp_path / "g.gmt")).collect()} == {("S1", "label", "a"), ("S1", "label", "b")}
    (tmp_path / "p.gpad").write_text("!c\n" + "\t".join(["D", "1", "enables", "X:1", "R", "E", "", "", "20200101", "me", "", ""]) + "\n" + "\t".join(["D", "9", "enables", "X:1", "R", "E", "", "", "20200101", "me", "", ""]) + "\n")
    (tmp_path / "p.gpi").write_text("\t".join(["D", "1", "sym", "name", "", "gene", "taxon:1", "", "", ""]) + "\n")
    gpad, gpi = annotations.read_gpad(spark, str(tmp_path / "p.gpad")), annotations.read_gpi(spark, str(tmp_path / "p.gpi"))
    assert annotations.joined(gpad, gpi).count() == 2 and annotations.joined(gpad, gpi, keep_unknown=False).first()["symbol"] == "sym"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gaf").write_text("!x\n" + _line(db="D", object_id="1", evidence="IPI") + "\nshort\n")
    found = ingest.violations(ingest.rows(spark, str(tmp_path / "in")), {"ipi_needs_with": (F.col("evidence") == "IPI") & (F.col("with_from") == "")})
    ingest.write(found, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["rule"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["ipi_needs_with", "short_row"]
