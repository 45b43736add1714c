"""How far the sources of a language differ in their use of terms, by single-pass indexing in memory.

Terms are A-Z-lower-cased runs of letters and characters beyond ASCII. Each task reads its documents once and keeps
block postings in memory (term -> occurrences and documents, per language and source). When BLOCK_ENTRIES or
BLOCK_BYTES are reached it spills a run sorted by term into the shuffle and starts anew. Runs meet in hash shards of
(language, term), where Spark's sorter merges them with a heap over its sorted pieces, and one streaming pass adds
equal postings to frequencies and drops terms of fewer than MIN_DOCS documents. A shard never has to fit into memory:
the pass holds one term's postings, one per source.

A pair of sources is the sum over all kept terms of f(p, q) = floor((p-q)^2 / (p+q)). As most terms are absent
from most sources, every pair starts from the value for two absent terms, times the terms; each
source's terms add how they differ from that (grouped by equal p), and the postings lists are streamed once more to
correct the terms that both sources hold: matrices of PAIRS entries at most, summed per task before they are shuffled.

p = 1 + floor(10^9 (count + 2) / (N + 2 V)) and f are integers throughout, so results do not depend on any order.

Cases: null text, lang and source are ''; a group without terms has rows too, against N = 0. A language
without kept terms gives pairs of value 0 and no terms. Ties go by the item's UTF-8 bytes. Repeated rows and null ids
count as documents of their own. A text is one block however long it is. Only text, lang and source are read, so other
columns cannot clash. An empty table gives no rows. The result has a row per ordered pair of sources of a language,
as asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletide.operators.joins import skew_join
from tripletide.scratch import Stored, store

MIN_DOCS = 10
TOP = 10
BLOCK_ENTRIES = 500_000
BLOCK_BYTES = 32 << 20
BATCH_ROWS = 20_000
PAIRS = 1 << 20

RUN = "lang string, term string, source string, n long, docs long"
POSTING = "lang string, term string, source string, n long, head boolean"

# Every byte that is no part of a term becomes a blank, A-Z become a-z.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _run(held: dict) -> Iterator[pa.RecordBatch]:
    """The block's postings in order of (lang, term, source); a group's own row has the empty term."""
    parts = []
    for (lang, source), (count, docs) in held.items():
        n = len(count) + 1
        columns = {
            "lang": pa.array([lang], pa.binary()).take(np.zeros(n, np.int32)),
            "term": pa.array([b"", *count], pa.binary()),
            "source": pa.array([source], pa.binary()).take(np.zeros(n, np.int32)),
            "n": pa.array(np.fromiter(chain((0,), count.values()), np.int64, n)),
            "docs": pa.array(np.fromiter(chain((0,), map(docs.__getitem__, count)), np.int64, n)),
        }
        parts.append(pa.table(columns))
    run = pa.concat_tables(parts).sort_by([(c, "ascending") for c in ("lang", "term", "source")])
    names = [run.column(c).cast(pa.string()) for c in ("lang", "term", "source")]
    yield from pa.table([*names, run.column("n"), run.column("docs")], run.column_names).to_batches(max_chunksize=BATCH_ROWS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, entries, size = {}, 0, 0
    for batch in batches:
        lang, source, text = (batch.column(c).cast(pa.binary()) for c in ("lang", "source", "text"))
        for i in range(batch.num_rows):
            terms = terms_of(text[i].as_py())
            count, docs = held.setdefault((lang[i].as_py(), source[i].as_py()), (Counter(), Counter()))
            different = set(terms)
            fresh = [term for term in different if term not in docs]
            count.update(terms)
            docs.update(different)
            entries += len(fresh)
            size += sum(map(len, fresh))
            if entries >= BLOCK_ENTRIES or size >= BLOCK_BYTES:
                yield from _run(held)
                held, entries, size = {}, 0, 0
    if held:
        yield from _run(held)


def _changes(table: pa.Table, *names: str) -> np.ndarray:
    """First row of every stretch of equal values in the named columns."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        c = table.column(name).combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _summed(table: pa.Table) -> pa.Table:
    at = _changes(table, "lang", "term", "source")
    n, docs = (np.add.reduceat(table.column(c).to_numpy(), at) for c in ("n", "docs"))
    return table.select(["lang", "term", "source"]).take(pa.array(at)).append_column("n", pa.array(n)).append_column("docs", pa.array(docs))


def _kept(table: pa.Table) -> pa.Table:
    """The postings of frequent terms, and the groups' own rows; ``head`` marks the first posting of a term."""
    at = _changes(table, "lang", "term")
    sizes = np.diff(np.append(at, table.num_rows))
    frequent = np.add.reduceat(table.column("docs").to_numpy(), at) >= MIN_DOCS
    own = pc.equal(table.column("term"), "").to_numpy()[at]
    head = np.zeros(table.num_rows, bool)
    head[at] = frequent
    return table.drop(["docs"]).append_column("head", pa.array(head)).filter(pa.array(np.repeat(frequent | own, sizes)))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums equal postings of sorted runs; what may go on in the next batch is carried over."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = _summed(rows if carry is None else pa.concat_tables([carry, rows]))
        last = int(_changes(rows, "lang", "term")[-1])
        carry = rows.slice(last).combine_chunks()
        if last:
            yield from _kept(rows.slice(0, last)).to_batches()
    if carry is not None:
        yield from _kept(carry).to_batches()


def frequencies(docs: DataFrame) -> Stored:
    """(lang, term, source, n, head): occurrences of every kept term in every group that has it, and a row
    with the empty term and n 0 for every group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    runs = read.mapInArrow(_runs, RUN)
    shards = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return store(shards.mapInArrow(_merged, POSTING), "postings")


def _p(n: str, total: str) -> Column:
    return F.expr(f"1 + (cast({n} + 2 as decimal(20,0)) * 1000000000) div cast({total} + 2 * v as decimal(20,0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _groups(postings: DataFrame) -> Stored:
    """(lang, source, at, v, z, total, whole): each group's number in its language, kept terms, p of an absent
    term, and its and the language's occurrences."""
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("head").alias("heads"))
    sums = store(sums, "groups").df
    langs = sums.groupBy("lang").agg(F.sum("total").alias("whole"), F.sum("heads").alias("v"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    known = sums.join(langs, "lang").withColumn("at", at)
    z = F.when(F.col("v") > 0, _p("0", "if(v > 0, total, 1)")).otherwise(F.lit(1))
    return store(known.select("lang", "source", "at", "v", z.cast("long").alias("z"), "total", "whole"), "groups")


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every two sources that hold a term: f of both, less what each alone was counted with."""

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    def block(p, z, at, rows, cols):
        """Corrections of source rows against source columns, per term along axis 0."""
        p1, z1, p2, z2 = p[:, rows], z[:, rows], p[:, cols], z[:, cols]
        value = f(p1, p2) - f(p1, z2) - f(z1, p2) + f(z1, z2)
        low, high = np.minimum(at[:, rows], at[:, cols]), np.maximum(at[:, rows], at[:, cols])
        return low.ravel(), high.ravel(), value.ravel()

    def summed(lang, low, high, value):
        order = np.lexsort((high, low))
        low, high, value = low[order], high[order], value[order]
        start = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        names = pa.array([lang] * len(start), pa.string())
        sums = np.add.reduceat(value, start)
        return pa.RecordBatch.from_arrays([names, pa.array(low[start]), pa.array(high[start]), pa.array(sums)], ["lang", "a", "b", "value"])

    for batch in batches:
        lists = batch.column("held")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        at, p, z = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "p", "z"))
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in dict.fromkeys(langs.tolist()):
            here = langs == lang
            for k in np.unique(sizes[here]):
                if k < 2:
                    continue
                starts = first[here & (sizes == k)]
                rows, cols = np.triu_indices(k, 1) if k * k <= PAIRS else (None, None)
                if rows is not None:
                    step = max(1, PAIRS // len(rows))
                    for i in range(0, len(starts), step):
                        spread = starts[i : i + step, None] + np.arange(k)
                        yield summed(lang, *block(p[spread], z[spread], at[spread], rows, cols))
                    continue
                for s in starts:  # a term of very many sources: one source against stretches of the rest
                    spread = np.arange(s, s + k)[None]
                    for i in range(k - 1):
                        for j in range(i + 1, k, PAIRS):
                            cols = np.arange(j, min(k, j + PAIRS))
                            yield summed(lang, *block(p[spread], z[spread], at[spread], np.full(len(cols), i), cols))


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by their
    distance, part ``term`` the TOP terms that the source uses more than its language does."""
    postings = frequencies(docs).df
    groups = _groups(postings)
    kept = postings.filter("term != ''")
    weighed = skew_join(kept, groups.hinted(), ["lang", "source"]).withColumn("p", _p("n", "total"))

    whole = kept.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = skew_join(weighed, whole, ["lang", "term"]).withColumn("q", _p("all", "whole")).filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value")
    ).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= TOP)

    # What one source's terms add against each other source, terms of equal p at once.
    other = groups.df.select("lang", F.col("at").alias("b"), F.col("z").alias("y"))
    other = groups.hinted(other)
    alike = weighed.groupBy("lang", F.col("at").alias("a"), "z", "p").agg(F.count(F.lit(1)).alias("k"))
    single = skew_join(alike, other, ["lang"]).filter("a != b").groupBy("lang", "a", "b").agg(
        F.sum(F.col("k") * (_f("p", "y") - _f("z", "y"))).alias("value")
    )
    lists = weighed.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p", "z")).alias("held")).select("lang", "held")
    both = lists.mapInArrow(_corrections, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value")
    )
    plain = skew_join(groups.df.withColumnRenamed("at", "a"), other, ["lang"]).filter("a != b").select(
        "lang", "a", "b", (F.col("v") * _f("z", "y")).alias("value")
    )

    def turned(df: DataFrame) -> DataFrame:
        return df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")

    parts = plain.unionByName(single).unionByName(turned(single)).unionByName(both).unionByName(turned(both))
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = groups.hinted(groups.df.select("lang", F.col("at").alias("a"), "source"))
    two = groups.hinted(groups.df.select("lang", F.col("at").alias("b"), F.col("source").alias("item")))
    pairs = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")
    )
    return pairs.unionByName(terms)
