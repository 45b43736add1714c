"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, other words lose case and punctuation at
their edges; what is left is a template, the same for a question and for its
re-parameterised copies. A capitalised word that opens a sentence may be a name or not, so windows
with one are hashed under both readings and the slots decide. Windows of WINDOW template words are hashed and joined with
those of the benchmark. Matches of one document and item on one diagonal make a run. In a run,
every value of the item stands for one value of the document and the other way round, type by
type: the one it meets most often. Places with another value, or without a most frequent
one, cut the run as a changed literal does, but windows equal to the item's value by value
always count. Windows that together cover at least SHARE of an item's words, or LONG of them,
are a leak.

Before the join, document windows pass a bitmap of the benchmark's hashes of fixed size
(2**BITS bits), so only windows that may match leave their task. The join itself is an
ordinary hash join of any two sizes. A template window with fewer than half literal words says
too little and has no template hash. Every window also has a hash of its actual values, so
verbatim copies are found whatever they are made of.

An item with fewer than WINDOW template words has one window of all of them, which documents
match with windows of that size.

Cases: null and empty texts have no windows, on either side. A null id is an id like any other,
but an item with a null id cannot be named and is ignored. Repeated rows give their hits
once. An empty table on either side gives no hits. Extra columns are not read; ``without_leaks``
passes them on and keeps documents without hits, whatever their columns hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletide.llm.tables import fresh_name, runs, saved
from tripletide.llm.words import mix, shingle_hashes, span_hashes, text_bytes, word_spans

WINDOW = 8
SHARE = 0.5
LONG = 16
BITS = 23
_U = np.uint64

NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "m cm mm km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "g kg mg gram grams kilogram kilograms ton tons pound pounds lb lbs ounce ounces oz l ml litre litres liter liters gallon "
    "gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars "
    "cent cents euro euros percent degree degrees kmh mph kw watt watts volt volts"
).split()
LITERAL, NUMBER, NAME, UNIT, OPENER = 0, 1, 2, 3, 4
EXACT = 7  # salt of the hashes of values
_SLOT = np.array([0, 0x6C62272E07BB0142, 0x62B821756295C58D, 0x27D4EB2F165667C5], np.uint64)

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 63]] = True


def _hash(words: list[str]) -> np.ndarray:
    return np.unique(canonical(pa.array([" ".join(words)]), typed=False)[0])


def canonical(column: pa.Array, typed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value hashes, kinds and, per text, the first of its template words (plus the total).

    A word of punctuation only is no template word.
    """
    raw, starts = text_bytes(column)
    begin, end, first = word_spans(raw, starts)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), first
    last_byte = raw[end - 1]
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    low, high = begin.copy(), end.copy()
    while True:
        cut = np.flatnonzero((low < high) & _PUNCTUATION[raw[np.minimum(low, len(raw) - 1)]])
        if not len(cut):
            break
        low[cut] += 1
    while True:
        cut = np.flatnonzero((low < high) & _PUNCTUATION[raw[high - 1]])
        if not len(cut):
            break
        high[cut] -= 1
    value = span_hashes(raw, low, high)
    some = low < high
    kind = np.zeros(len(begin), np.int8)
    if typed:
        opens = np.ones(len(begin), bool)  # sentences
        opens[1:] = _STOP[last_byte[:-1]] | (lines[begin[1:]] > lines[end[:-1]])
        opens[first[:-1][first[:-1] < len(begin)]] = True
        head = raw[np.minimum(low, len(raw) - 1)]
        accented = (head == 0xC3) & (raw[np.minimum(low + 1, len(raw) - 1)] <= 0x9E)
        upper = _UPPER[head] | accented
        kind[upper] = np.where(opens[upper], OPENER, NAME)
        kind[np.isin(value, _known()[0])] = NUMBER
        kind[np.isin(value, _known()[1])] = UNIT
        kind[_DIGIT[head]] = NUMBER
    kept = np.concatenate([[0], np.cumsum(some)])
    return value[some], kind[some], kept[first]


_lists: list[np.ndarray] = []


def _known() -> list[np.ndarray]:
    if not _lists:
        _lists.extend([_hash(NUMBER_WORDS), _hash(UNITS)])
    return _lists


def _within(marks: np.ndarray, size: int) -> np.ndarray:
    """How many of each ``size`` marks in a row are set."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[size:] - total[:-size]


def windows(values: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of a text, by template and by value, and where each begins."""
    if len(values) < size or not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    exact = mix(shingle_hashes(values, size), EXACT)
    hashes, places = [exact], [np.arange(len(exact))]
    opens = _within(kinds == OPENER, size) > 0
    for reading in (NAME, LITERAL) if opens.any() else (NAME,):
        read = np.where(kinds == OPENER, reading, kinds)
        some = 2 * _within(read == LITERAL, size) >= size
        at = np.flatnonzero(some & opens if reading == LITERAL else some)
        hashes.append(shingle_hashes(np.where(read == LITERAL, values, _SLOT[read]), size)[at])
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


_HITS = "id long, own long, size int, hash long, at long, words long, values array<long>, kinds binary"


def _windowed(sizes: list[int], bitmap: bytes | None):
    """Windows of (id, text) rows; with a bitmap only those that may match."""
    bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text"):
                values, kinds, first = canonical(part.column("text"))
                ids, own = part.column("id").to_pylist(), part.column("own").to_pylist()
                out: list[list] = [[] for _ in range(8)]
                for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    for size in sizes if bits is not None else [min(WINDOW, int(b - a))]:
                        h, at = windows(values[a:b], kinds[a:b], size)
                        if bits is not None:
                            maybe = bits[(h >> _U(64 - BITS)).astype(np.int64)]
                            h, at = h[maybe], at[maybe]
                        for x, p in zip(h.view(np.int64).tolist(), at.tolist()):
                            v = values[a + p : a + p + size].view(np.int64).tolist()
                            for column, y in zip(out, (ids[k], own[k], size, x, p, int(b - a), v, kinds[a + p : a + p + size].tobytes())):
                                column.append(y)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [c.split()[0] for c in _HITS.split(", ")])

    return work


def _keyed(df: DataFrame, doc_id: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64("text").alias("own"), "text")


def _agreeing(run: pd.DataFrame) -> np.ndarray:
    """Which windows of a run, all of one size, equal the item's or hold no slot in conflict with the run's others."""
    there, item, kinds = np.stack(run["values"]), np.stack(run["item_values"]), np.stack([np.frombuffer(k, np.int8) for k in run["kinds"]])
    kinds = np.where(kinds == OPENER, NAME, kinds)
    equal = (there == item).all(axis=1)
    if equal.all():
        return equal
    at = run["at"].to_numpy()[:, None] + np.arange(there.shape[1])
    _, once = np.unique(at, return_index=True)
    slots = once[kinds.ravel()[once] != LITERAL]
    places = list(zip(kinds.ravel()[slots].tolist(), item.ravel()[slots].tolist(), there.ravel()[slots].tolist()))
    met = Counter(places)
    most: dict = {}  # the highest count of each side's value, and how many pairs have it
    for (k, w, v), n in met.items():
        for side in (("item", k, w), ("there", k, v)):
            top, ties = most.get(side, (0, 0))
            most[side] = (n, 1) if n > top else (top, ties + (n == top))
    bad = [p for p, (k, w, v) in zip(at.ravel()[slots], places) if not most["item", k, w] == most["there", k, v] == (met[k, w, v], 1)]
    return equal | ~np.isin(at, bad).any(axis=1)


_FOUND = "id long, own long, item_id long, start long, end long, matched long, item_words long, exact boolean"


def _judged(share: float, long: int):
    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of one document and item: the windows both have."""
        covered: set[int] = set()
        spans, exact = [], True
        for _, run in rows.groupby(rows["at"] - rows["item_at"]):
            run = run.sort_values("at").drop_duplicates("at")
            at = run["at"].to_numpy()
            cuts = np.flatnonzero(np.diff(at) > run["size"].to_numpy()[:-1])
            for piece in np.split(np.arange(len(run)), cuts + 1):
                part = run.iloc[piece]
                part = part[_agreeing(part)]
                if not len(part):
                    continue
                for i, n in zip(part["item_at"], part["size"]):
                    covered.update(range(i, i + n))
                spans.append((int(part["at"].min()), int((part["at"] + part["size"]).max())))
                exact &= all(list(a) == list(b) for a, b in zip(part["values"], part["item_values"]))
        words = int(rows["item_words"].iloc[0])
        if not covered or (len(covered) < share * words and len(covered) < long):
            return pd.DataFrame(columns=[c.split()[0] for c in _FOUND.split(", ")])
        found = (*key[:3], min(s for s, _ in spans), max(e for _, e in spans), len(covered), words, exact)
        return pd.DataFrame([found], columns=[c.split()[0] for c in _FOUND.split(", ")])

    return work


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, long: int = LONG) -> DataFrame:
    """(doc_id, item_id, start, end, matched, item_words, exact) of every leak of ``benchmark`` (item_id, text) in ``docs``.

    ``start`` and ``end`` are template words of the document, ``matched`` counts the item's words
    found, ``exact`` tells a copy from a re-parameterised one.
    """
    return _leaks(docs, benchmark, share, long).drop("own").withColumnRenamed("id", "doc_id").distinct()


def _leaks(docs: DataFrame, benchmark: DataFrame, share: float, long: int) -> DataFrame:
    items = _keyed(benchmark.filter("item_id is not null and text is not null"), "item_id")
    items, _ = saved(items.mapInArrow(_windowed([], None), _HITS), "items")
    # at most 2**BITS numbers, and WINDOW sizes
    buckets = items.select(F.shiftrightunsigned("hash", 64 - BITS).alias("b")).distinct().toArrow()["b"].to_numpy()
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[buckets] = True
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    hits = _keyed(docs, "doc_id").mapInArrow(_windowed(sizes, np.packbits(bitmap).tobytes()), _HITS)
    items = items.select(
        "size", "hash", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("words").alias("item_words"), F.col("values").alias("item_values")
    ).distinct()
    found = hits.drop("words").join(items, ["size", "hash"])
    return found.groupBy("id", "own", "item_id").applyInPandas(_judged(share, long), _FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, long: int = LONG) -> DataFrame:
    """The rows of ``docs`` in which no item of ``benchmark`` leaks."""
    own, bad, bad_id = (fresh_name(docs.columns, c) for c in ("own__", "bad__", "bad_id__"))
    found, _ = saved(_leaks(docs, benchmark, share, long).select(F.col("id").alias(bad_id), F.col("own").alias(bad)).distinct(), "leaks")
    keyed = docs.withColumn(own, F.xxhash64("text"))
    return keyed.join(found, (keyed[own] == found[bad]) & keyed["doc_id"].eqNullSafe(found[bad_id]), "left_anti").drop(own)
