"""Files in the formats the readers take, written from the given tables by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletide.scratch import scratch_path

CONFIGS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("config_id", "policy")]
    + [T.StructField(c, T.IntegerType()) for c in ("n_triples", "size", "evict", "evictions")]
)


def write_lines(lines: DataFrame, name: str) -> str:
    path = scratch_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def resource(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"<http://example.org/{prefix}/"), F.col(column).cast("string"), F.lit(">"))


def event_lines(events: DataFrame) -> DataFrame:
    """Two statements per event in event order: who did it, and its properties as an escaped literal."""
    event = resource("event", "event_id")
    escaped = F.replace(F.replace(F.col("props"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    done = F.concat(resource("user", "user_id"), F.lit(" <http://example.org/did> "), event, F.lit(" ."))
    props = F.concat(event, F.lit(' <http://example.org/props> "'), escaped, F.lit('" .'))
    both = F.posexplode(F.array(done, props)).alias("i", "value")
    return events.select("event_id", both).orderBy("event_id", "i").select("value")


def part_classes(part: DataFrame) -> DataFrame:
    """An RDF/XML class per part: below its brand, and defined as a product made as its type."""
    item = F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))
    brand = F.regexp_replace("p_brand", "#", "")
    return part.select(
        F.concat(
            F.lit('<owl:Class rdf:ID="'), item, F.lit('"><rdfs:subClassOf rdf:resource="#'), brand,
            F.lit('"/><owl:intersectionOf rdf:parseType="Collection"><owl:Class rdf:about="#Product"/>'
                  '<owl:Restriction><owl:onProperty rdf:resource="#madeAs"/><owl:someValuesFrom>'
                  '<owl:Class rdf:about="#'), F.col("p_type"),
            F.lit('"/></owl:someValuesFrom></owl:Restriction></owl:intersectionOf></owl:Class>'),
        ).alias("value")
    )


ROOT_OPEN = (
    '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
    'xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
)


# Elements in a document at most, or nearly so: an XML file is read by one task, however long it is.
ELEMENTS = 20_000


def documents(elements: DataFrame) -> DataFrame:
    """The elements dealt over documents of about ELEMENTS, with a root element around those of each partition, so that
    every file is a document."""
    elements = elements.repartition(max(1, -(-elements.count() // ELEMENTS)))
    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([ROOT_OPEN])], ["value"])
        # Rebuilt, since a column without nulls has another schema than the root's.
        yield from (pa.RecordBatch.from_arrays([batch.column(0)], ["value"]) for batch in batches)
        yield pa.RecordBatch.from_arrays([pa.array(["</rdf:RDF>"])], ["value"])

    return elements.mapInArrow(wrap, "value string")


def named_file(lines: DataFrame, folder: str, name: str) -> str:
    """Writes lines as one file of the given name (result files are told apart by name)."""
    spark: SparkSession = lines.sparkSession
    part_dir = f"{folder}/{name}.parts"
    lines.coalesce(1).write.text(part_dir)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source = hadoop.Path(part_dir)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    target = hadoop.Path(f"{folder}/{name}")
    fs.rename(part, target)
    return target.toString()
