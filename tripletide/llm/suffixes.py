"""Passages that repeat across documents, by a sparse suffix array.

A document's suffixes are kept at content-selected places only: of every PASSAGE - SEED + 1
successive runs of SEED words, the one of least hash. Any passage of PASSAGE words therefore
keeps at least one suffix whose first SEED words lie inside it, the same one in every document.
Suffixes whose seed occurs once end there. The others are sorted by seed and by what
follows it; neighbours of different documents are compared and their match is extended to the
right and to the left. A suffix can share passages with documents that are not its neighbours,
so where a neighbour's match leaves a window of PASSAGE words around a seed uncovered, all
windows around that seed are looked up by their hashes, once for all suffixes with equal words
around their seed. Spans of a document are merged at the end.

The sort is a range partitioning by seed, following words and document, so a passage that a
third of all documents share is spread over tasks; the first and last suffixes of the partitions are
compared in a second step. Each suffix is compared with its neighbours only.

Cases: null or shorter texts have no passage. Repetition inside one document does not count.
Rows of equal id and text are one document that repeats as a whole. A null id is an id. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripletide.llm.tables import dropped, runs, saved
from tripletide.llm.words import mix, shingle_hashes, word_hashes

PASSAGE = 50
SEED = 16
REACH = PASSAGE - SEED
_U = np.uint64
_PLACES = np.random.default_rng(11).integers(1, 1 << 63, 2 * REACH + 4, dtype=np.uint64) | _U(1)


def selected(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds kept of a text's words."""
    if len(words) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = shingle_hashes(words, SEED)
    rank = mix(seeds, 5)
    same = np.concatenate([[False], seeds[1:] == seeds[:-1]])
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(seeds))))
    # of a run of equal seeds every SEED-th place is enough
    rank[(np.arange(len(seeds)) - begin) % SEED != 0] = np.iinfo(np.uint64).max
    view = np.lib.stride_tricks.sliding_window_view(rank, REACH + 1)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return at, seeds[at]


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, "text"):
            words, first = word_hashes(part.column("text"))
            found = [selected(words[a:b]) for a, b in zip(first[:-1], first[1:])]
            n = [len(f[0]) for f in found]
            row = np.repeat(np.arange(part.num_rows), n)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(pa.array(row)), pa.array(np.concatenate([f[0] for f in found]).astype(np.int32)), pa.array(np.concatenate([f[1] for f in found]).view(np.int64))],
                ["doc", "at", "seed"],
            )


_SUFFIX = "seed long, after binary, before binary, doc long, at int, words int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """REACH words after the seed, and before it from the nearest on, as big-endian 32-bit hashes; ``words`` counts all of the text."""
    for batch in batches:
        for part in runs(batch, "text"):
            words, first = word_hashes(part.column("text"))
            short = (words >> _U(32)).astype(">u4")
            out: list[list] = [[], [], [], [], [], []]
            for a, b, doc, places, seeds in zip(first[:-1], first[1:], part.column("doc").to_pylist(), part.column("places").to_pylist(), part.column("seeds").to_pylist()):
                for p, s in zip(places, seeds):
                    here = a + p
                    row = (s, short[here + SEED : min(b, here + SEED + REACH)].tobytes(), short[max(a, here - REACH) : here][::-1].tobytes(), doc, p, b - a)
                    for column, x in zip(out, row):
                        column.append(x)
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [c.split()[0] for c in _SUFFIX.split(", ")])


def _common(a: bytes, b: bytes) -> int:
    """Words that two contexts begin with together."""
    if a == b:
        return len(a) // 4
    n = min(len(a), len(b)) // 4
    differ = np.frombuffer(a, np.uint32, n) != np.frombuffer(b, np.uint32, n)
    return int(differ.argmax()) if differ.any() else n


_MATCH = "doc long, at int, left int, right int, other long"
_EDGE = _MATCH + ", shard int, last boolean, seed long, after binary, before binary"
_NAMES = [c.split()[0] for c in _EDGE.split(", ")]


def _match(x: tuple, y: tuple) -> list[tuple]:
    left, right = _common(x[2], y[2]), _common(x[1], y[1])
    if left + SEED + right < PASSAGE:
        return []
    return [(x[3], x[4], left, right, y[3]), (y[3], y[4], left, right, x[3])]


def _batch(matches: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    rows = [(*m, None, None, None, None, None) for m in matches] + [(*[None] * 5, *e) for e in edges]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], _NAMES)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of sorted suffixes with the nearest ones of other documents, and the partition's ends."""
    shard = TaskContext.get().partitionId()
    run: list[tuple] = []  # the latest suffixes: one seed, one document
    earlier: tuple | None = None  # the last suffix before them, of the same seed
    first = None
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*[batch.column(c).to_pylist() for c in ("seed", "after", "before", "doc", "at")]):
            first = first or row
            if run and run[-1][0] != row[0]:
                run, earlier = [], None
            if run and run[-1][3] != row[3]:
                for x in run:
                    out += _match(x, row)
                run, earlier = [], run[-1]
            elif earlier:
                out += _match(earlier, row)
            run.append(row)
        yield _batch(out, [])
    if first:
        ends = [(shard, last, r[0], r[1], r[2]) for last, r in ((False, first), (True, run[-1]))]
        rows = [(r[3], r[4], None, None, None, *e) for r, e in zip((first, run[-1]), ends)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_batch([], []).schema)], _NAMES)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            x = tuple(r["end"][c] for c in ("seed", "after", "before", "doc", "at"))
            y = tuple(r["begin"][c] for c in ("seed", "after", "before", "doc", "at"))
            if x[0] == y[0] and x[3] != y[3]:
                out += _match(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], _NAMES[:5])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all windows of PASSAGE words around each seed; ``back`` counts the words before it."""
    for batch in batches:
        n, backs, marks = [], [], []
        for seed, after, before in zip(*[batch.column(c).to_pylist() for c in ("seed", "after", "before")]):
            a, b = np.frombuffer(after, ">u4").astype(np.uint64), np.frombuffer(before, ">u4").astype(np.uint64)
            after_to = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a + _U(1)) * _PLACES[: len(a)])])
            before_to = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + _U(1)) * _PLACES[REACH : REACH + len(b)])])
            back = np.arange(max(0, REACH - len(a)), min(REACH, len(b)) + 1)
            h = mix(mix(before_to[back], 1) + mix(after_to[REACH - back], 2) + _U(seed & 0xFFFFFFFFFFFFFFFF)) if len(back) else np.zeros(0, np.uint64)
            n.append(len(back))
            backs.append(back.astype(np.int8))
            marks.append(h.view(np.int64))
        if n:
            row = pa.array(np.repeat(np.arange(len(n)), n))
            found = [batch.column(c).take(row) for c in ("context", "one", "two")]
            yield pa.RecordBatch.from_arrays([*found, pa.array(np.concatenate(backs)), pa.array(np.concatenate(marks))], ["context", "one", "two", "back", "mark"])


def _merged(spans: DataFrame) -> DataFrame:
    """The spans of each document, overlapping ones as one."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    until = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("new", F.coalesce(F.col("start") > until, F.lit(True)).cast("int"))
    numbered = begun.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("doc", "part").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("other_id").alias("other_id")
    )
    return whole.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("start", "end")], (F.col("end") - F.col("start")).cast("int").alias("n_words"), "other_id")


def _sorted(df: DataFrame) -> DataFrame:
    """Asks for a sort-merge join: these tables grow with the corpus, and joins go the same way at every size."""
    return df.hint("merge")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words, other_id) of every stretch of ``docs`` (doc_id, text) that other documents repeat.

    ``start`` and ``end`` count words; every stretch consists of passages of at least PASSAGE words. ``other_id``
    is the least id found among the documents it was compared with.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"))
    seeds, seeds_at = saved(keyed.select("doc", "text").mapInArrow(_seeded, "doc long, at int, seed long"), "seeds")
    # a row that is there twice has every seed twice, all in one document
    often = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    often, often_at = saved(often, "often")  # a table of its own, so that a seed of very many suffixes can be split in the join
    chosen = seeds.join(_sorted(often), "seed", "left_semi").groupBy("doc").agg(F.collect_set(F.struct("at", "seed")).alias("s"))
    chosen = chosen.select("doc", F.col("s.at").alias("places"), F.col("s.seed").alias("seeds"))
    # the join leaves equal rows beside each other, so one of them is taken before its suffixes would be shuffled
    texts = keyed.join(_sorted(chosen), "doc").select("doc", "text", "places", "seeds").dropDuplicates(["doc"])
    whole, _ = saved(texts.mapInArrow(_contexts, _SUFFIX), "suffixes")
    suffixes = whole.drop("words")
    dropped(spark, seeds_at, often_at)
    order = ["seed", "after", "doc", "at"]
    sorted_, sorted_at = saved(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, _EDGE), "neighbours")
    ends = sorted_.filter("shard is not null")
    row = F.struct("seed", "after", "before", "doc", "at")
    # two rows of each partition, in order
    pairs = ends.select(row.alias("end"), "last", F.lead(row).over(Window.orderBy("shard", "last")).alias("begin")).filter("last and begin is not null")
    matches = sorted_.filter("shard is null").select("doc", "at", "left", "right", "other")
    matches = matches.unionByName(pairs.mapInArrow(_ends, _MATCH))
    matches, _ = saved(matches, "matches")
    dropped(spark, sorted_at)
    best = matches.groupBy("doc", "at").agg(F.max(F.struct(F.col("left") + F.col("right"), "left", "right")).alias("one"))
    best = best.select("doc", "at", F.col("one.left").alias("left"), F.col("one.right").alias("right"))
    most = F.least(F.lit(REACH), F.octet_length("before") / 4)  # words a window may begin before the seed
    least = F.greatest(F.lit(0), REACH - F.octet_length("after") / 4)
    covered = F.coalesce((most <= F.col("left")) & (REACH - least <= F.col("right")), F.lit(False))
    context = F.xxhash64("seed", "after", "before")
    uncovered = suffixes.join(_sorted(best), ["doc", "at"], "left").filter((least <= most) & ~covered)
    uncovered, _ = saved(uncovered.select("seed", context.alias("context"), "doc", "at"), "uncovered")
    # equal contexts have equal windows: they are looked up once for all documents that hold them
    asked_seeds, asked_at = saved(uncovered.select("seed").distinct(), "open-seeds")
    asked = suffixes.join(_sorted(asked_seeds), "seed", "left_semi")
    asked = asked.groupBy("seed", "after", "before").agg(F.min("doc").alias("one"), F.max("doc").alias("two"))
    asked = asked.select(context.alias("context"), "seed", "after", "before", "one", "two")
    open_, _ = saved(asked.mapInArrow(_windows, "context long, one long, two long, back byte, mark long"), "windows")
    dropped(spark, asked_at)
    shared = open_.groupBy("mark").agg(F.min("one").alias("least"), F.max("two").alias("most")).filter("least != most")
    # all windows around a seed overlap, so those that others hold make one span
    wide = open_.select("context", "back", "mark").join(_sorted(shared), "mark").groupBy("context").agg(
        F.min("back").alias("low"), F.max("back").alias("high"), F.min("least").alias("one"), F.max("most").alias("two")
    )
    late = uncovered.join(_sorted(wide), "context").select(
        "doc", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + PASSAGE).alias("end"),
        F.when(F.col("doc") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("other"),
    )
    early = matches.select("doc", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + SEED + F.col("right")).alias("end"), "other")
    found = early.unionByName(late).groupBy("doc", "start", "end").agg(F.min("other").alias("other"))
    sizes = whole.select("doc", "words").distinct()
    names = keyed.select("doc", "doc_id").join(_sorted(sizes), "doc").groupBy("doc").agg(
        F.min("doc_id").alias("doc_id"), F.min("words").alias("words"), F.count(F.lit(1)).alias("rows")
    )
    names, _ = saved(names, "names")
    other = names.select(F.col("doc").alias("other"), F.col("doc_id").alias("other_id"))
    spans = found.join(_sorted(names), "doc").join(_sorted(other), "other", "left").select("doc", "doc_id", "start", "end", "other_id")
    # rows that are there twice repeat as a whole; their words were counted above, so no text is shuffled again
    twice = names.filter("rows > 1").select("doc", "doc_id", F.lit(0).alias("start"), F.col("words").alias("end"), F.col("doc_id").alias("other_id"))
    return _merged(spans.unionByName(twice))
