"""N-Triples files as triple DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripletide.functions.ntriples import all_parts, compat_terms, is_blank, is_statement, line_parts, strict_terms
from tripletide.scratch import store


def read_ntriples(
    spark: SparkSession, path: str | list[str], mode: str = "strict", number: bool = True, on_error: str = "fail"
) -> DataFrame:
    """Triples ``seq, s, p, o, o_kind`` (strict mode adds ``o_datatype, o_lang``).

    ``seq`` is the line order over all files, by file path, counting statements
    only. For it the parsed lines are written once with their place in their file
    split, and the splits are counted; no row is shuffled. (Scanning the text twice
    could cut it into other splits the second time.) ``number=False`` leaves it out.

    In strict mode a line that is no statement, remark or blank fails the read;
    with ``on_error="rejects"`` it is left out, and ``rejected_lines`` returns it.
    """
    if on_error not in ("fail", "rejects"):
        raise ValueError("on_error must be fail or rejects")
    if mode not in ("strict", "compat"):
        raise ValueError("mode must be strict or compat")
    line = F.col("value")
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    parts = F.col("_parts")
    if mode == "strict":
        lines = lines.withColumn("_parts", line_parts(line))
    if mode == "compat":
        lines = lines.filter(F.trim(line) != "")
    elif on_error == "rejects":
        lines = lines.filter(all_parts(parts))
    else:
        bad = F.raise_error(F.concat(F.lit("not an N-Triples statement: "), F.substr(line, F.lit(1), F.lit(200))))
        lines = lines.filter(F.when(all_parts(parts), True).when(is_blank(line), False).otherwise(bad.cast("boolean")))
    terms = strict_terms(parts) if mode == "strict" else compat_terms(line)
    if not number:
        return lines.select(*terms)
    parsed = lines.select("_file", "_block", F.monotonically_increasing_id().alias("_at"), *terms)
    placed = store(parsed, "lines").df
    seq = (F.col("_at") - F.col("_first") + F.col("_start")).alias("seq")
    names = [c for c in placed.columns if not c.startswith("_")]
    return placed.join(split_starts(placed), ["_file", "_block"]).select(seq, *names)


def rejected_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line) of every line that is no statement, remark or blank by the grammar."""
    line = F.col("value")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.filter(~is_statement(line) & ~is_blank(line)).select("file", line.alias("line"))


def split_starts(placed: DataFrame) -> DataFrame:
    """(_file, _block, _first, _start): where each file split starts in the running count.

    A split is read by one task from front to back, so a row's place in its split is
    its id less the split's first id. The table has a row per split.
    """
    splits = store(
        placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")), "splits"
    )
    within = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_file = splits.df.groupBy("_file").agg(F.sum("n").alias("n"))
    files = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    file_start = per_file.select("_file", F.coalesce(F.sum("n").over(files), F.lit(0)).alias("_file_start"))
    starts = splits.df.withColumn("_in_file", F.coalesce(F.sum("n").over(within), F.lit(0))).join(file_start, "_file")
    return splits.hinted(
        starts.select("_file", "_block", "_first", (F.col("_file_start") + F.col("_in_file")).alias("_start"))
    )
