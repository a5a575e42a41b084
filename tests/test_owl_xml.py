"""Documents in OWL/XML and RDF/XML, catalogs and imports, on small files."""

import pytest

from ontoloom.sources import owl_xml as X

TOP = """<?xml version="1.0"?>
<Ontology xmlns="http://www.w3.org/2002/07/owl#"
     xml:base="http://x/top"
     ontologyIRI="http://x/top">
<Prefix name="o" IRI="http://o/"/>
<Import>http://x/mid</Import>
<Declaration><Class IRI="#A"/></Declaration>
<SubClassOf>
  <Annotation><AnnotationProperty IRI="#c"/><Literal>why</Literal></Annotation>
  <Class IRI="#A"/>
  <ObjectSomeValuesFrom><ObjectProperty IRI="#p"/>
    <ObjectIntersectionOf><Class IRI="#C"/><Class abbreviatedIRI="o:B"/></ObjectIntersectionOf>
  </ObjectSomeValuesFrom>
</SubClassOf>
<SubClassOf><ObjectMinCardinality cardinality="2"><ObjectProperty IRI="#p"/></ObjectMinCardinality><Class IRI="#A&amp;B"/></SubClassOf>
<EquivalentClasses><Class IRI="#A"/><ObjectComplementOf><Class IRI="#C"/></ObjectComplementOf></EquivalentClasses>
<DisjointClasses><Class IRI="#A"/><Class IRI="#C"/></DisjointClasses>
<AnnotationAssertion><AnnotationProperty abbreviatedIRI="rdfs:label"/><IRI>#A</IRI><Literal>a &lt;thing&gt;</Literal></AnnotationAssertion>
<SubClassOf><Class IRI="#A"/><ObjectSomeValuesFrom/></SubClassOf>
</Ontology>
"""
MID = """<?xml version="1.0"?>
<!DOCTYPE rdf:RDF [ <!ENTITY m "http://x/mid#" > ]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:obo="http://obo/" xml:base="http://x/mid">
<owl:Ontology rdf:about="http://x/mid"><owl:imports rdf:resource="http://x/top"/><owl:imports rdf:resource="http://x/low"/></owl:Ontology>
<owl:Class rdf:about="&m;K"><rdfs:label xml:lang="en">kay</rdfs:label><obo:note>n</obo:note><rdfs:subClassOf rdf:resource="#L"/>
<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#q"/><owl:someValuesFrom><owl:Class><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="#M"/><owl:Restriction><owl:onProperty rdf:resource="#q"/><owl:qualifiedCardinality>3</owl:qualifiedCardinality><owl:onClass rdf:resource="#N"/></owl:Restriction></owl:unionOf></owl:Class></owl:someValuesFrom></owl:Restriction></rdfs:subClassOf>
<owl:disjointWith rdf:resource="#M"/></owl:Class>
<owl:Class rdf:about="#Z"/>
</rdf:RDF>
"""


@pytest.fixture
def files(tmp_path):
    for name, text in (("top.owx", TOP), ("mid.owl", MID)):
        (tmp_path / name).write_text(text)
    (tmp_path / "low").mkdir()
    (tmp_path / "catalog-v001.xml").write_text('<catalog xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog"><uri id="1" name="http://x/mid" uri="mid.owl"/><uri name="http://x/top" uri="top.owx"/></catalog>')
    return tmp_path


def test_load_with_imports(spark, files):
    catalog = X.read_catalog(spark, f"{files}/catalog-v001.xml")
    assert catalog == {"http://x/mid": f"{files}/mid.owl", "http://x/top": f"{files}/top.owx"}
    with pytest.raises(ValueError, match="http://x/low"):
        X.load(spark, f"{files}/top.owx", catalog)
    got = X.load(spark, f"{files}/top.owx", catalog, skip_missing=True)
    assert [d.iri for d in got.documents] == ["http://x/top", "http://x/mid"]  # the cycle ends
    t, m = "http://x/top#", "http://x/mid#"
    some = f"ObjectSomeValuesFrom({t}p ObjectIntersectionOf(http://o/B {t}C))"
    least = f"ObjectMinCardinality(2 {t}p {X.OWL}Thing)"
    union = f"ObjectUnionOf(ObjectExactCardinality(3 {m}q {m}N) {m}M)"
    assert {tuple(r) for r in got.subclasses().collect()} == {
        (f"{t}A", some, "http://x/top"), (least, f"{t}A&B", "http://x/top"), (f"{t}A", f"ObjectComplementOf({t}C)", "http://x/top"), (f"ObjectComplementOf({t}C)", f"{t}A", "http://x/top"),
        (f"{m}K", f"{m}L", "http://x/mid"), (f"{m}K", f"ObjectSomeValuesFrom({m}q {union})", "http://x/mid"),
    }
    rows = {tuple(r) for r in got.expressions.collect()}
    assert (some, "some", f"{t}p", f"ObjectIntersectionOf(http://o/B {t}C)", None) in rows and (least, "min", f"{t}p", X.OWL + "Thing", 2) in rows and len(rows) == 9
    assert {tuple(r["args"]) for r in got.axioms.where("kind = 'DisjointClasses'").collect()} == {(f"{t}A", f"{t}C"), (f"{m}K", f"{m}M")}
    labels = {tuple(r) for r in got.labels().collect()}
    assert (X.RDFS + "label", f"{t}A", "a <thing>") in labels and (f"{m}K", X.RDFS + "label", "kay") in labels and (f"{m}K", "http://obo/note", "n") in labels
    assert {tuple(r["args"]) for r in got.axioms.where("kind = 'Declaration'").collect()} == {(f"{t}A",), (f"{m}K",), (f"{m}Z",)}
    broken = [r["xml"] for r in X.broken_records(spark, f"{files}/top.owx").collect()]
    assert len(broken) == 1 and "ObjectSomeValuesFrom />" in broken[0]


@pytest.mark.parametrize("rdf", [False, True])
def test_round_trip(spark, tmp_path, rdf):
    ax = spark.createDataFrame([("http://a/A & \"B\"", "e1"), ("http://a/B", "http://a/<C>"), ("http://a/B", "e4"), (None, "e1")], "sub string, sup string")
    rows = [("e1", "and", None, "http://a/B", None), ("e1", "and", None, "e2", None), ("e2", "some", "http://a/p", "e3", None), ("e3", "not", None, "http://a/D", None), ("e4", "max", "http://a/p", "http://a/D", 4)]
    ex = spark.createDataFrame(rows, "id string, kind string, property string, filler string, n int")
    place = f"{tmp_path}/doc"
    (X.write_rdf_xml if rdf else X.write_owl_xml)(ax.repartition(3), ex, place, "http://a", ["http://b"])
    got = X.load(spark, place, skip_missing=True)
    assert got.documents[0].imports == ["http://b"] and got.documents[0].rdf == rdf
    assert {tuple(r)[:2] for r in got.subclasses().collect()} == {
        ("http://a/A & \"B\"", "ObjectIntersectionOf(ObjectSomeValuesFrom(http://a/p ObjectComplementOf(http://a/D)) http://a/B)"),
        ("http://a/B", "http://a/<C>"), ("http://a/B", "ObjectMaxCardinality(4 http://a/p http://a/D)"),
    }
