"""Ontology documents in OWL/XML and RDF/XML: readers, writers, catalogs of places, imports.

OWL/XML is read in records, one an axiom, so files are split over tasks like
text.  RDF/XML, whose class elements nest, is read class by class, a task a file,
as a stream.  Both give rows of axioms and the expressions in them; an expression's id is its functional-style text, as in
`ontoloom.sources.graphs.read_functional`.  axioms is (kind, args): SubClassOf,
EquivalentClasses, DisjointClasses, Declaration, AnnotationAssertion.
expressions is (id, kind, property, filler, n), one row an operand.

Imports are followed round by round over documents, each once, whatever cycles
they form.  Headers (imports, prefixes, entities) and catalogs are read by the
driver: they grow with documents, not with axioms.

Writers give each part of a folder its own head and end, so every part is a whole
document of the same ontology.  Records that aren't well-formed give no axioms and
are listed by broken_records(); of an RDF/XML file the rest is left out from there on.  Empty documents have no axioms.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.plans.session import settle, ship_package

#: Names of the languages.
OWL, RDF, RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
XML = "{http://www.w3.org/XML/1998/namespace}"
KINDS = {"ObjectSomeValuesFrom": "some", "ObjectAllValuesFrom": "only", "ObjectIntersectionOf": "and", "ObjectUnionOf": "or", "ObjectComplementOf": "not", "ObjectMinCardinality": "min", "ObjectMaxCardinality": "max", "ObjectExactCardinality": "exact", "ObjectHasValue": "value"}
FUNCTIONAL = {v: k for k, v in KINDS.items()}
RECORDS = ("SubClassOf", "EquivalentClasses", "DisjointClasses", "Declaration", "AnnotationAssertion")
RESTRICTIONS = {"someValuesFrom": "some", "allValuesFrom": "only", "hasValue": "value"}
CARDINALITIES = {"minQualifiedCardinality": "min", "maxQualifiedCardinality": "max", "qualifiedCardinality": "exact", "minCardinality": "min", "maxCardinality": "max", "cardinality": "exact"}
BOOLEANS = {"intersectionOf": "and", "unionOf": "or"}
EXPRESSION = "struct<id:string,kind:string,property:string,filler:string,n:int>"
_ROW = pa.struct([("id", pa.string()), ("kind", pa.string()), ("property", pa.string()), ("filler", pa.string()), ("n", pa.int32())])
_TEXT = "org.apache.hadoop.mapreduce.lib.input.TextInputFormat"
_FORMAT = "org.apache.spark.sql.execution.datasources.xml.XmlInputFormat"


@dataclass
class Document:
    """What a document's head says; `names` maps prefixes and `entities` marks to addresses."""

    place: str
    iri: str | None
    rdf: bool
    base: str
    imports: list[str]
    names: dict[str, str]
    entities: dict[str, str]


@dataclass
class Ontology:
    """axioms (document, kind, args) and expressions of a document and all that it imports."""

    documents: list[Document]
    axioms: DataFrame
    expressions: DataFrame

    def subclasses(self) -> DataFrame:
        """(sub, sup, document), of equivalent classes both ways."""
        one = self.axioms.where("kind = 'SubClassOf'").select(F.col("args")[0].alias("sub"), F.col("args")[1].alias("sup"), "document")
        ends = F.transform("args", lambda b: F.struct(F.col("args")[0].alias("a"), b.alias("b")))
        same = self.axioms.where("kind = 'EquivalentClasses'").select("document", F.explode(ends).alias("e")).where("e.a <> e.b")
        return one.union(same.select("e.a", "e.b", "document")).union(same.select("e.b", "e.a", "document")).distinct()

    def labels(self) -> DataFrame:
        """(subject, property, value) of annotations."""
        return self.axioms.where("kind = 'AnnotationAssertion'").select(F.col("args")[0].alias("subject"), F.col("args")[1].alias("property"), F.col("args")[2].alias("value")).distinct()


def _attributes(tag: str, entities: dict[str, str]) -> dict[str, str]:
    found = {k: v for k, _, v in re.findall(r"([\w:.-]+)\s*=\s*(['\"])(.*?)\2", tag, re.S)}
    return {k: re.sub(r"&(\w+);", lambda m: entities.get(m[1], m[0]), v) for k, v in found.items()}


def head(spark: SparkSession, place: str) -> Document:
    """Reads the tags that say what a document is, from anywhere in it."""
    tags = spark.read.option("lineSep", ">").text(place).select(F.trim("value").alias("v"))
    wanted = r"(?s)(<Ontology\s|<rdf:RDF\s|<owl:Ontology\s|<owl:imports\s|<Prefix\s|<!ENTITY\s|</Import$)"
    found = [r["v"] for r in tags.where(F.col("v").rlike(wanted)).collect()]
    entities = dict(m[0::2] for t in found for m in re.findall(r"<!ENTITY\s+(\w+)\s+(['\"])(.*?)\2", t))
    doc = Document(place, None, False, "", [], {"owl": OWL, "rdf": RDF, "rdfs": RDFS}, entities)
    for t in found:
        a = _attributes(t, entities)
        if "<Prefix" in t and "name" in a:
            doc.names[a["name"]] = a.get("IRI", "")
        elif t.endswith("</Import"):
            doc.imports.append(t[: -len("</Import")].strip())
        elif "<owl:imports" in t and "rdf:resource" in a:
            doc.imports.append(a["rdf:resource"])
        elif "<rdf:RDF" in t:
            doc.rdf, doc.base = True, a.get("xml:base", doc.base)
        elif "<owl:Ontology" in t:
            doc.iri = doc.iri or a.get("rdf:about")
        elif "<Ontology" in t:
            doc.iri, doc.base = a.get("ontologyIRI"), a.get("xml:base", a.get("ontologyIRI", doc.base))
    doc.base, doc.imports = doc.base or doc.iri or "", sorted(set(doc.imports))
    return doc


def records(spark: SparkSession, place: str, tag: str) -> DataFrame:
    """(xml): the outermost elements of a name, one a row."""
    conf = {"xmlinput.start": f"<{tag}>", "xmlinput.end": f"</{tag}>", "xmlinput.encoding": "UTF-8"}
    found = spark.sparkContext.newAPIHadoopFile(place, _FORMAT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", conf=conf)
    return spark.createDataFrame(found.map(lambda kv: (kv[1],)), "xml string")


def _element(xml: str, entities: dict[str, str]) -> ET.Element:
    xml = re.sub(r"&(\w+);", lambda m: entities.get(m[1], m[0]), xml)
    return ET.fromstring(f'<r xmlns="{OWL}">{xml}</r>')[0]


def _text(kind: str, prop: str | None, operands: list[str], n: int | None) -> str:
    return f"{FUNCTIONAL[kind]}({' '.join([*([str(n)] if n is not None else []), *([prop] if prop else []), *operands])})"


def _kept(rows: list[dict], kind: str, prop: str | None, operands: list[str], n: int | None = None) -> str:
    operands = sorted(set(operands)) if kind in ("and", "or") else operands
    name = _text(kind, prop, operands, n)
    rows += [{"id": name, "kind": kind, "property": prop, "filler": f, "n": n} for f in operands]
    return name


def _owl_record(e: ET.Element, doc: Document, rows: list[dict]) -> list[tuple[str, list[str]]]:
    """Axioms of an OWL/XML element; their expressions are added to rows."""

    def name(x: ET.Element) -> str:
        short = x.get("abbreviatedIRI")
        if short is not None:
            prefix, _, rest = short.partition(":")
            return doc.names.get(prefix, prefix + ":") + rest
        return urljoin(doc.base, x.get("IRI", "")) if x.get("IRI") is not None else (x.text or "").strip()

    def node(x: ET.Element) -> str:
        tag = x.tag.rpartition("}")[2]
        if tag == "ObjectInverseOf":
            return f"ObjectInverseOf({node(x[0])})"
        if tag not in KINDS:
            if tag == "IRI":
                return urljoin(doc.base, (x.text or "").strip())
            return name(x) if tag not in ("Literal", "AnonymousIndividual") else (x.text or x.get("nodeID") or "").strip()
        parts = [node(c) for c in x]
        if KINDS[tag] in ("and", "or", "not"):
            return _kept(rows, KINDS[tag], None, parts)
        n = x.get("cardinality")
        return _kept(rows, KINDS[tag], parts[0], parts[1:] or [OWL + "Thing"], int(n) if n is not None else None)

    tag = e.tag.rpartition("}")[2]
    return [(tag, [node(c) for c in e if not c.tag.endswith("}Annotation")])]


def _rdf_record(e: ET.Element, doc: Document, rows: list[dict]) -> list[tuple[str, list[str]]]:
    """Axioms of an RDF/XML class element."""
    at = lambda x, key: x.get(f"{{{RDF}}}{key}")

    def address(x: ET.Element, key: str) -> str | None:
        return None if at(x, key) is None else urljoin(doc.base, at(x, key))

    def value(x: ET.Element) -> str | None:
        return address(x, "resource") or (node(x[0]) if len(x) else None)

    def node(x: ET.Element) -> str | None:
        if at(x, "about") is not None:
            return address(x, "about")
        parts = {c.tag.rpartition("}")[2]: c for c in x}
        if "onProperty" in parts:
            prop = value(parts["onProperty"])
            for tag, kind in RESTRICTIONS.items():
                if tag in parts:
                    return _kept(rows, kind, prop, [value(parts[tag]) or (parts[tag].text or "").strip()])
            for tag, kind in CARDINALITIES.items():
                if tag in parts:
                    of = value(parts["onClass"]) if "onClass" in parts else OWL + "Thing"
                    return _kept(rows, kind, prop, [of], int(parts[tag].text))
        for tag, kind in BOOLEANS.items():
            if tag in parts:
                return _kept(rows, kind, None, [node(c) for c in parts[tag]])
        if "complementOf" in parts:
            return _kept(rows, "not", None, [value(parts["complementOf"])])
        return None

    me = address(e, "about")
    if me is None:
        return []
    out = [("Declaration", [me])]
    kinds = {"subClassOf": "SubClassOf", "equivalentClass": "EquivalentClasses", "disjointWith": "DisjointClasses"}
    for c in e:
        tag = c.tag.rpartition("}")[2]
        if tag in kinds:
            other = value(c)
            out += [(kinds[tag], [me, other])] if other else []
        elif tag in BOOLEANS or tag == "complementOf":
            out.append(("EquivalentClasses", [me, _kept(rows, BOOLEANS.get(tag, "not"), None, [node(x) for x in c] or [address(c, "resource")])]))
        else:
            space, _, local = c.tag.rpartition("}")
            out.append(("AnnotationAssertion", [me, space.removeprefix("{") + local, address(c, "resource") or (c.text or "").strip()]))
    return out


_UNREADABLE = (ET.ParseError, IndexError, ValueError, TypeError, KeyError)


def _read(e: ET.Element, doc: Document, take) -> list[tuple]:
    """(kind, args, found, broken) of an element; the first axiom carries the expressions of all."""
    rows: list[dict] = []
    try:
        made = take(e, doc, rows)
    except _UNREADABLE:
        return [(None, [], [], ET.tostring(e, encoding="unicode"))]
    return [(kind, ends, rows if not i else [], None) for i, (kind, ends) in enumerate(made)]


def _owl_rows(doc: Document):
    def owl_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for xml in batch.column("xml").to_pylist():
                try:
                    out += _read(_element(xml, doc.entities), doc, _owl_record)
                except ET.ParseError:
                    out.append((None, [], [], xml))
            kinds, args, found, broken = zip(*out, strict=True) if out else ((),) * 4
            columns = [pa.array(kinds, pa.string()), pa.array(args, pa.list_(pa.string())), pa.array(found, pa.list_(_ROW)), pa.array(broken, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "args", "found", "broken"])

    return owl_rows


def _rdf_rows(doc: Document):
    def rdf_rows(lines: Iterator[tuple[int, str]]) -> Iterator[tuple]:
        """The lines of one file; a class element is forgotten once its axioms are out."""
        parser, open_ = ET.XMLPullParser(["start", "end"]), []
        for _, line in lines:
            try:
                parser.feed(line + "\n")
                for event, e in parser.read_events():
                    if event == "start":
                        open_.append(e)
                        continue
                    open_.pop()
                    if len(open_) == 1:
                        if e.tag == f"{{{OWL}}}Class":
                            for kind, ends, found, broken in _read(e, doc, _rdf_record):
                                yield kind, ends, [tuple(f[c] for c in ("id", "kind", "property", "filler", "n")) for f in found], broken
                        open_[0].clear()
            except ET.ParseError:
                yield None, [], [], line
                return

    return rdf_rows


def rows_of(spark: SparkSession, doc: Document) -> DataFrame:
    """(kind, args, found, broken) of a document's records."""
    ship_package(spark)
    schema = f"kind string, args array<string>, found array<{EXPRESSION}>, broken string"
    if doc.rdf:
        whole = {"mapreduce.input.fileinputformat.split.minsize": str(1 << 60)}
        lines = spark.sparkContext.newAPIHadoopFile(doc.place, _TEXT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", conf=whole)
        return spark.createDataFrame(lines.mapPartitions(_rdf_rows(doc)), schema)
    every = [records(spark, doc.place, t) for t in RECORDS]
    xml = every[0]
    for more in every[1:]:
        xml = xml.union(more)
    return xml.mapInArrow(_owl_rows(doc), schema)


def broken_records(spark: SparkSession, place: str) -> DataFrame:
    """(xml): records that hold no readable axiom."""
    return rows_of(spark, head(spark, place)).where("broken is not null").select(F.col("broken").alias("xml"))


def read_catalog(spark: SparkSession, place: str) -> dict[str, str]:
    """Ontology addresses and the places where their documents lie, of a catalog file; relative places are beside it."""
    folder = place.rsplit("/", 1)[0] + "/"
    found = {}
    for r in records(spark, place, "uri").collect():  # one a document
        a = _attributes(r["xml"], {})
        if "name" in a and "uri" in a:
            found[a["name"]] = a["uri"] if re.match(r"^[\w+.-]+:|^/", a["uri"]) else folder + a["uri"]
    return found


def documents(spark: SparkSession, place: str, catalog: dict[str, str] | None = None, skip_missing: bool = False) -> list[Document]:
    """The document and all that it imports, by rounds over documents not yet met."""
    catalog, met, front = catalog or {}, {}, [place]
    while front:
        new = [head(spark, p) for p in front]
        met |= {d.place: d for d in new}
        wanted = {i for d in new for i in d.imports}
        missing = sorted(i for i in wanted if i not in catalog)
        if missing and not skip_missing:
            raise ValueError(f"no place is known for imports {missing}")
        front = sorted({catalog[i] for i in wanted if i in catalog} - met.keys())
    return list(met.values())


def load(spark: SparkSession, place: str, catalog: dict[str, str] | None = None, skip_missing: bool = False) -> Ontology:
    """The ontology of a document with its imports; catalog maps ontology addresses to places."""
    met = documents(spark, place, catalog, skip_missing)
    rows = None
    for doc in met:
        mine = rows_of(spark, doc).where("kind is not null").select(F.lit(doc.iri).alias("document"), "kind", "args", "found")
        rows = mine if rows is None else rows.union(mine)
    rows = settle(rows, "ontology")
    expressions = rows.select(F.explode("found").alias("e")).select("e.*").distinct()
    return Ontology(met, rows.select("document", "kind", "args").distinct(), expressions)


# Writers.


def _safe(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _owl_class(x: Column) -> Column:
    return F.concat(F.lit('<Class IRI="'), _safe(x), F.lit('"/>'))


def _rdf_class(x: Column) -> Column:
    return F.concat(F.lit('<rdf:Description rdf:about="'), _safe(x), F.lit('"/>'))


def _wrapped(tag: str, *inside: Column, attributes: str | Column = "") -> Column:
    attributes = F.lit(attributes) if isinstance(attributes, str) else attributes
    return F.concat(F.lit(f"<{tag}"), attributes, F.lit(">"), *inside, F.lit(f"</{tag}>"))


def _owl_shape(kind: Column, prop: Column, operands: Column, n: Column) -> Column:
    role = F.concat(F.lit('<ObjectProperty IRI="'), _safe(prop), F.lit('"/>'))
    out = F.lit(None).cast("string")
    for k, tag in FUNCTIONAL.items():
        number = F.concat(F.lit(' cardinality="'), n.cast("string"), F.lit('"'))
        made = _wrapped(tag, operands) if k in ("and", "or", "not") else _wrapped(tag, role, operands, attributes=number if k in ("min", "max", "exact") else "")
        out = F.when(kind == k, made).otherwise(out)
    return out


def _rdf_shape(kind: Column, prop: Column, operands: Column, n: Column) -> Column:
    role = F.concat(F.lit('<owl:onProperty rdf:resource="'), _safe(prop), F.lit('"/>'))
    out = F.when(kind == "not", _wrapped("owl:Class", _wrapped("owl:complementOf", operands)))
    for tag, k in BOOLEANS.items():
        out = F.when(kind == k, _wrapped("owl:Class", _wrapped(f"owl:{tag}", operands, attributes=' rdf:parseType="Collection"'))).otherwise(out)
    for tag, k in RESTRICTIONS.items():
        out = F.when(kind == k, _wrapped("owl:Restriction", role, _wrapped(f"owl:{tag}", operands))).otherwise(out)
    for tag, k in list(CARDINALITIES.items())[:3]:
        out = F.when(kind == k, _wrapped("owl:Restriction", role, _wrapped(f"owl:{tag}", n.cast("string")), _wrapped("owl:onClass", operands))).otherwise(out)
    return out


def rendered(expressions: DataFrame, rdf: bool = False) -> DataFrame:
    """(id, xml) of expressions, from the innermost outwards, a round a level; expressions that hold themselves have none."""
    named, shape = (_rdf_class, _rdf_shape) if rdf else (_owl_class, _owl_shape)
    rows = settle(expressions.select("id", "kind", "property", "filler", "n").distinct(), "expressions")
    ids = rows.select(F.col("id").alias("filler")).distinct().withColumn("_inner", F.lit(True))
    rows = settle(rows.join(ids, "filler", "left").select("id", "kind", "property", "n", "filler", F.when(F.col("_inner").isNull(), named(F.col("filler"))).alias("xml")), "operands")
    done = None
    while True:
        now = rows if done is None else rows.join(done.select(F.col("id").alias("filler"), F.col("xml").alias("_x")), "filler", "left").select("id", "kind", "property", "n", "filler", F.coalesce("xml", "_x").alias("xml"))
        whole = now.groupBy("id", "kind", "property", "n").agg(F.array_sort(F.collect_list(F.struct("filler", "xml"))).alias("o"), F.count(F.lit(1)).alias("_all"), F.count("xml").alias("_have")).where("_all = _have")
        made = whole.select("id", shape(F.col("kind"), F.col("property"), F.array_join(F.transform("o", lambda o: o["xml"]), ""), F.col("n")).alias("xml"))
        before = done.count() if done is not None else 0
        done = settle(made, "rendered")
        if done.count() == before:
            return done


def _shaped(axioms: DataFrame, expressions: DataFrame, rdf: bool) -> DataFrame:
    """axioms (sub, sup) with the XML of both ends."""
    xml, named = rendered(expressions, rdf), _rdf_class if rdf else _owl_class
    out = axioms.select("sub", "sup").where("sub is not null and sup is not null").distinct()
    for end in ("sub", "sup"):
        cell = xml.select(F.col("id").alias(end), F.col("xml").alias(f"_{end}"))
        out = out.join(cell, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", named(F.col(end))))
    return out


def _framed(first: str, last: str):
    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])
        yield one(first)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])
        yield one(last)

    return framed


def _write(lines: DataFrame, place: str, first: str, last: str) -> None:
    ship_package(lines.sparkSession)
    lines.mapInArrow(_framed(first, last), "value string").write.text(place)


def write_owl_xml(axioms: DataFrame, expressions: DataFrame, place: str, iri: str, imports: list[str] = ()) -> None:
    """SubClassOf axioms of (sub, sup) as OWL/XML."""
    first = f'<?xml version="1.0"?>\n<Ontology xmlns="{OWL}" ontologyIRI="{iri}">\n' + "".join(f"<Import>{i}</Import>\n" for i in imports).rstrip("\n")
    shaped = _shaped(axioms, expressions, False)
    _write(shaped.select(_wrapped("SubClassOf", F.col("_sub"), F.col("_sup")).alias("value")), place, first.rstrip("\n"), "</Ontology>")


def write_rdf_xml(axioms: DataFrame, expressions: DataFrame, place: str, iri: str, imports: list[str] = ()) -> None:
    """Axioms (sub, sup) with named sub as RDF/XML, a class element an axiom; others are left out."""
    named = axioms.join(expressions.select(F.col("id").alias("sub")).distinct(), "sub", "left_anti")
    first = f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF}" xmlns:owl="{OWL}" xmlns:rdfs="{RDFS}" xml:base="{iri}">\n<owl:Ontology rdf:about="{iri}">' + "".join(f'<owl:imports rdf:resource="{i}"/>' for i in imports) + "</owl:Ontology>"
    line = _wrapped("owl:Class", _wrapped("rdfs:subClassOf", F.col("_sup")), attributes=F.concat(F.lit(' rdf:about="'), _safe(F.col("sub")), F.lit('"')))
    _write(_shaped(named, expressions, True).select(line.alias("value")), place, first, "</rdf:RDF>")


def write_catalog(spark: SparkSession, places: dict[str, str], path: str) -> None:
    """A catalog file (in a folder of its own) of ontology addresses and places."""
    lines = ['<?xml version="1.0"?>', '<catalog prefer="public" xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog">', *[f'<uri name="{k}" uri="{v}"/>' for k, v in places.items()], "</catalog>"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
