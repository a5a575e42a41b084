"""Annotation, association and entity files: headers, repairs, faults."""

from ontoloom.sources import annotation_files as AF

ROW = "DB\tid1\tsym\tNOT|contributes to\tGO:1\tPMID:1|PMID:2\tIEA\tDB:2,DB:3\tF\tname\tsyn a|syn b\tgene\ttaxon:1|taxon:2\t20200101\tme".split("\t")


def test_versions_and_repairs(spark, tmp_path):
    line = "\t".join
    (tmp_path / "old.gaf").write_text("!gaf-version: 1.0\n" + line(ROW) + "\n\n" + line([*ROW, "x"]) + "\n" + line(ROW[:9]) + "\n")
    (tmp_path / "new.gaf").write_text("!comment\n !gaf-version: 2.1\n" + line(ROW) + "\n" + line([*ROW, "part_of(A:1)"]) + "\n" + line([*ROW, "", "iso", "more"]) + "\n" + line([*ROW, "p(A:1)", "iso"]) + "\n")
    rows = AF.read_gaf(spark, str(tmp_path))
    got = sorted((r["version"], r["n_columns"], r["status"], r["extension"], r["isoform"]) for r in rows.collect())
    assert got == [(1.0, 9, "short", None, None), (1.0, 15, "ok", None, None), (1.0, 16, "long", None, None), (2.1, 15, "repaired", "", ""), (2.1, 16, "repaired", "part_of(A:1)", ""), (2.1, 17, "ok", "p(A:1)", "iso"), (2.1, 18, "long", "", "iso")]
    ann = AF.annotations(rows.where("n_columns = 17")).first()
    assert (ann["bioentity"], ann["flags"], ann["relation"], ann["refs"], ann["with_from"], ann["taxon"], ann["interacting_taxon"], str(ann["date"])) == ("DB:id1", 3, "contributes_to", ["PMID:1", "PMID:2"], ["DB:2", "DB:3"], "taxon:1", "taxon:2", "2020-01-01")


def test_column_checks(spark, tmp_path):
    def changed(i, v):
        return "\t".join(v if k == i else x for k, x in enumerate([*ROW[:3], "NOT|contributes_to", *ROW[4:], "part_of(A:1)", ""]))

    faults = {
        changed(2, ""): {"symbol_missing"},
        changed(4, "GO:1|GO:2"): {"cls_repeated"},
        changed(5, "PMID:1|PM ID"): {"reference_blank_inside"},
        changed(10, "a b|c d"): set(),
        changed(12, "taxon:1|taxon:2|taxon:3"): {"taxon_over_two"},
        changed(12, "9606"): {"taxon_format"},
        changed(13, "2020-01-01"): {"date_format"},
        changed(13, "20180101"): {"electronic_older_than_a_year"},
        changed(0, "XX"): {"unknown_database"},
        changed(15, "part_of(noprefix)"): {"extension_without_id_space"},
    }
    (tmp_path / "f.gaf").write_text("!gaf-version: 2.0\n" + "\n".join(faults) + "\n")
    rows = AF.read_gaf(spark, str(tmp_path))
    found = AF.column_checks(rows, "2020-06-01", spark.createDataFrame([("DB",)], "node string"))
    got = {line: set() for line in faults}
    for r in found.collect():
        got[r["annotation_id"]].add(r["rule"])
    assert got == faults
    levels = AF.violations([found, found.limit(0)], {"date_format": "warning"})
    assert {r["severity"] for r in levels.where("rule = 'date_format'").collect()} == {"warning"} and levels.where("severity = 'error'").count() == 8


def test_associations_round_trip(spark, tmp_path):
    (tmp_path / "a.gaf").write_text("!gaf-version: 2.0\n" + "\t".join([*ROW, "part_of(A:1)", ""]) + "\n")
    rows = AF.read_gaf(spark, f"{tmp_path}/a.gaf")
    gpad, gpi = AF.to_associations(rows, spark.createDataFrame([("IEA", "ECO:0000501")], "evidence string, eco string"))
    AF.write_gpad(gpad, f"{tmp_path}/gpad")
    AF.write_gpi(gpi, f"{tmp_path}/gpi")
    AF.write_gpi(gpi, f"{tmp_path}/gpi_old", "DB")
    AF.write_gaf(rows, f"{tmp_path}/gaf", ("made here",))
    back = AF.read_gpad(spark, f"{tmp_path}/gpad").collect()
    assert len(back) == 1 and (back[0]["qualifier"], back[0]["eco"], back[0]["interacting_taxon"], back[0]["version"]) == ("NOT|contributes_to", "ECO:0000501", "taxon:2", 1.1)
    for place, version in (("gpi", 1.2), ("gpi_old", 1.1)):
        one = AF.read_gpi(spark, f"{tmp_path}/{place}").collect()
        assert [(r["db"], r["object_id"], r["symbol"], r["taxon"], r["version"]) for r in one] == [("DB", "id1", "sym", "taxon:1", version)]
    assert AF.read_gaf(spark, f"{tmp_path}/gaf").select("line").collect() == rows.select("line").collect()


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.gaf").write_text("!gaf-version: 2.0\n\n")
    rows = AF.read_gaf(spark, str(tmp_path))
    assert rows.collect() == [] and AF.column_checks(rows, "2020-01-01").collect() == [] and AF.annotations(rows).collect() == []
