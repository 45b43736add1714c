"""RDF/XML ontologies as axiom rows, read with Spark's XML source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names of RDF/XML and OWL, with the kind of axiom they give.
_NAMED = "`_rdf:ID` STRING, `_rdf:about` STRING"
_REF = "STRUCT<`_rdf:resource`: STRING>"
_CLASS_REF = "STRUCT<`_rdf:about`: STRING, `_rdf:ID`: STRING>"
_FILLER = f"STRUCT<`_rdf:resource`: STRING, `owl:Class`: {_CLASS_REF}>"
_RESTRICTION = f"STRUCT<`owl:onProperty`: {_REF}, `owl:someValuesFrom`: {_FILLER}>"
_PARTS = f"STRUCT<`owl:Class`: ARRAY<{_CLASS_REF}>, `owl:Restriction`: ARRAY<{_RESTRICTION}>>"
CLASS_SCHEMA = (
    f"{_NAMED}, `rdfs:subClassOf` ARRAY<STRUCT<`_rdf:resource`: STRING, `owl:Class`: {_CLASS_REF}, "
    f"`owl:Restriction`: {_RESTRICTION}>>, `owl:intersectionOf` {_PARTS}, "
    f"`owl:equivalentClass` STRUCT<`owl:Class`: STRUCT<`owl:intersectionOf`: {_PARTS}>>"
)
PROPERTY_SCHEMA = (
    f"{_NAMED}, `rdfs:subPropertyOf` ARRAY<{_REF}>, `rdfs:domain` ARRAY<{_REF}>, "
    f"`rdfs:range` ARRAY<{_REF}>, `owl:inverseOf` ARRAY<{_REF}>, `rdf:type` ARRAY<{_REF}>"
)
CLASS_TAG = "owl:Class"
PROPERTY_TAGS = ("owl:ObjectProperty", "owl:DatatypeProperty", "owl:TransitiveProperty")
PROPERTY_AXIOMS = {
    "rdfs:subPropertyOf": "subprop",
    "rdfs:domain": "domain",
    "rdfs:range": "range",
    "owl:inverseOf": "inverse",
}
TRANSITIVE_IRI = "http://www.w3.org/2002/07/owl#TransitiveProperty"


def _q(name: str) -> str:
    return f"`{name}`"


def _axiom(kind: str | Column, a: Column, b: Column | None = None, c: Column | None = None, d: Column | None = None) -> list[Column]:
    nothing = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [
        kind.alias("kind"), a.alias("a"),
        *[(nothing if x is None else x).alias(n) for n, x in (("b", b), ("c", c), ("d", d))],
    ]


def _elements(spark: SparkSession, path: str | list[str], tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    me = F.coalesce(F.concat(F.lit("#"), _q("_rdf:ID")), F.col(_q("_rdf:about")))
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), me.alias("me")).filter("me is not null")


def _bases(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, _base): the xml:base of every file."""
    found = F.regexp_extract("value", r"""xml:base\s*=\s*["']([^"']*)["']""", 1)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), found.alias("_base"))
    return lines.filter("_base <> ''").groupBy("_file").agg(F.min("_base").alias("_base"))


def _class_axioms(classes: DataFrame) -> DataFrame:
    def ref(column: str) -> Column:
        about, identity = F.col(f"{column}.`_rdf:about`"), F.col(f"{column}.`_rdf:ID`")
        return F.coalesce(about, F.concat(F.lit("#"), identity))

    def some(column: str) -> tuple[Column, Column]:
        filler = f"{column}.`owl:someValuesFrom`"
        return (
            F.col(f"{column}.`owl:onProperty`.`_rdf:resource`"),
            F.coalesce(F.col(f"{filler}.`_rdf:resource`"), ref(f"{filler}.`owl:Class`")),
        )

    supers = classes.select("_file", "me", F.explode(_q("rdfs:subClassOf")).alias("up"))
    named = F.coalesce(F.col("up.`_rdf:resource`"), ref("up.`owl:Class`"))
    on, filler = some("up.`owl:Restriction`")
    subclass = supers.filter(named.isNotNull()).select("_file", *_axiom("subclass", F.col("me"), named))
    sub_some = supers.filter(on.isNotNull()).select("_file", *_axiom("sub_some", F.col("me"), None, on, filler))

    parts = F.coalesce(F.col(_q("owl:intersectionOf")), F.col("`owl:equivalentClass`.`owl:Class`.`owl:intersectionOf`"))
    defined = classes.select("_file", "me", parts.alias("parts")).filter("parts is not null")
    conjunct = F.try_element_at(F.col("parts.`owl:Class`"), F.lit(1))
    whole = defined.select("_file", "me", conjunct.alias("first"), F.explode("parts.`owl:Restriction`").alias("r"))
    on, filler = some("r")
    equiv_some = whole.select("_file", *_axiom("equiv_some", F.col("me"), ref("first"), on, filler))
    return subclass.unionByName(sub_some).unionByName(equiv_some)


def _targets(tag: str, kind: str) -> Column:
    nothing = F.array().cast("array<struct<`_rdf:resource`: string>>")
    return F.transform(
        F.coalesce(F.col(_q(tag)), nothing),
        lambda r: F.struct(F.lit(kind).alias("kind"), r.getField("_rdf:resource").alias("target")),
    )


def _property_axioms(properties: DataFrame) -> DataFrame:
    pairs = F.flatten(F.array(*[_targets(tag, kind) for tag, kind in PROPERTY_AXIOMS.items()]))
    each = properties.select("_file", "me", F.explode(pairs).alias("x"))
    return each.select("_file", *_axiom(F.col("x.kind"), F.col("me"), F.col("x.target")))


def _transitive(properties: DataFrame, tag: str) -> DataFrame:
    if tag != "owl:TransitiveProperty":
        properties = properties.filter(F.exists(_q("rdf:type"), lambda r: r.getField("_rdf:resource") == TRANSITIVE_IRI))
    return properties.select("_file", *_axiom("transitive", F.col("me")))


def read_ontology(spark: SparkSession, path: str | list[str], base: str | None = None) -> DataFrame:
    """Axioms ``kind, a, b, c, d`` of the ontology files, names resolved against ``xml:base``.

    Reads named sub-classes, existential restrictions (on their own or inside a
    definition), sub-properties, domains, ranges, inverses and transitive properties.
    """
    parts = [_class_axioms(_elements(spark, path, CLASS_TAG, CLASS_SCHEMA))]
    for tag in PROPERTY_TAGS:
        found = _elements(spark, path, tag, PROPERTY_SCHEMA)
        parts += [_property_axioms(found), _transitive(found, tag)]
    axioms = reduce(DataFrame.unionByName, parts)
    if base is None:
        axioms = axioms.join(_bases(spark, path), "_file", "left")
    else:
        axioms = axioms.withColumn("_base", F.lit(base))

    def resolved(name: str) -> Column:
        local = F.col(name).startswith("#")
        return F.when(local, F.concat(F.coalesce("_base", F.lit("")), name)).otherwise(F.col(name)).alias(name)

    return axioms.select("kind", *[resolved(n) for n in ("a", "b", "c", "d")]).distinct()
