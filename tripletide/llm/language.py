"""Language by interpolated Kneser-Ney character models, one per language.

Letters are lower-cased and spelled in SYMBOLS: the OWN most frequent letters of the learning
texts have a symbol of their own, every other letter is a LEAD and one or two further symbols,
different for each, and a run of anything else is one boundary. The grams of ORDER symbols
of all learning texts are counted, per partition first and then by (language, gram); lower orders
follow from the distinct grams as continuation counts. The models are built on the driver, whose
memory grows with the different grams of all languages; they are kept as arrays sorted
by gram hash, with every language's log probability beside each hash, and backing-off weights
by context.

A text gets the language of the lowest cross-entropy per symbol. The score is that
language's share after a temperature fitted on all learning texts; ``rejected`` marks texts whose
cross-entropy lies above what nearly all learning texts of the language have.

Cases: ``und`` with score 0 for a null text or one without a letter, and for every text if
nothing could be learned. Null languages are not learned from; with a null id a document is
neither held out nor learned from. Empty learning texts count nothing. Ties go to
the language first in code point order. Repeated rows are each returned; an empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletide.llm.quality import remainder
from tripletide.llm.tables import dropped, listed, runs, saved
from tripletide.llm.words import mix

ORDER = 4
BITS = 8
SYMBOLS = 1 << BITS
# Symbols: 0 the boundary, then OWN letters, then leads of spellings of two symbols, the last of those of three.
OWN = 160
# Grams counted in a task before they are handed over.
HELD = 1 << 21
REJECTED_SHARE = 0.001
# Temperatures tried, and bins of cross-entropy a unit, in which the rejection limits are looked for.
TRIED = np.geomspace(0.01, 2, 60)
BINS = 4096
UNKNOWN = "und"

_folds: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For every UTF-16 unit: the lower-case letter it stands for, or 0 if it is no letter.

    Units of letters beyond the basic plane count as letters.
    """
    if not _folds:
        out = np.zeros(1 << 16, np.uint16)
        for i in range(1 << 16):
            if 0xD800 <= i <= 0xDFFF:
                out[i] = i
            elif chr(i).isalpha():
                low = chr(i).lower()
                out[i] = ord(low) if len(low) == 1 else i
        _folds.append(out)
    return _folds[0]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def symbols_of(text: str, alphabet: np.ndarray) -> np.ndarray:
    """Symbols of a text between boundaries; runs of boundaries are one."""
    spelled = alphabet[units(text)]
    used = spelled != 0
    used[:, 0] = True  # the boundary
    s = np.concatenate([[0], spelled[used], [0]])
    return s[(s != 0) | (np.concatenate([[1], s[:-1]]) != 0)]


def grams_of(symbols: np.ndarray) -> np.ndarray:
    """Codes of the grams of ORDER symbols that end at each symbol after the first boundary."""
    s = np.concatenate([np.zeros(ORDER - 2, np.uint32), symbols.astype(np.uint32)])
    n = len(s) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = np.zeros(n, np.uint32)
    for i in range(ORDER):
        code = (code << np.uint32(BITS)) | s[i : i + n]
    return code


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for part in runs(batch, "text"):
            joined = "".join(t for t in part.column("text").to_pylist() if t)
            total += np.bincount(units(joined), minlength=1 << 16)
    by_letter = np.bincount(_folded(), weights=total, minlength=1 << 16).astype(np.int64)
    by_letter[0] = 0
    used = np.flatnonzero(by_letter)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(by_letter[used])], ["letter", "n"])


def alphabet_of(counts: list[tuple[int, int]]) -> np.ndarray:
    """The up to three symbols of every UTF-16 unit, zeros behind them, from (letter, count).

    The most frequent letters have one symbol, the next ones two; all others have three, by their unit.
    """
    rank = [letter for letter, _ in sorted(counts, key=lambda x: (-x[1], x[0]))]
    further = SYMBOLS - 1  # what follows a lead is no boundary
    letters = np.arange(1 << 16)
    spelled = np.stack([np.full(1 << 16, SYMBOLS - 1), 1 + letters // further % further, 1 + letters % further], axis=1)
    spelled[letters // further >= further, 0] = SYMBOLS - 2
    own, two = np.array(rank[:OWN], np.int64), np.array(rank[OWN : OWN + (SYMBOLS - 3 - OWN) * further], np.int64)
    spelled[own] = 0
    spelled[own, 0] = 1 + np.arange(len(own))
    spelled[two] = 0
    spelled[two, 0] = 1 + OWN + np.arange(len(two)) // further
    spelled[two, 1] = 1 + np.arange(len(two)) % further
    spelled[0] = 0
    return spelled.astype(np.uint8)[_folded()]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One of each code, in order, with the sum of its counts."""
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)


def _counted(alphabet: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in runs(batch, "text"):
                by: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    if text and lang is not None:
                        by.setdefault(lang, []).append(grams_of(symbols_of(text, alphabet)))
                for lang, parts in by.items():
                    new = np.unique(np.concatenate(parts), return_counts=True)
                    total[lang] = _merged([total[lang], new]) if lang in total else new
                if sum(len(c) for c, _ in total.values()) > HELD:
                    for lang in list(total):
                        yield _gram_rows(lang, *total.pop(lang))
        for lang, found in total.items():
            yield _gram_rows(lang, *found)

    return work


def _gram_rows(lang: str, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


@dataclass(frozen=True)
class Level:
    """Grams of one order, in hash order: log probability by language; contexts: log weight of the order below."""

    hashes: np.ndarray
    codes: np.ndarray
    logs: np.ndarray
    context_hashes: np.ndarray
    context_codes: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(codes: np.ndarray, logs: np.ndarray, contexts: np.ndarray, weights: np.ndarray, order: int) -> Level:
        h, c = mix(codes.astype(np.uint64), order), mix(contexts.astype(np.uint64), order)
        a, b = np.argsort(h), np.argsort(c)
        return Level(h[a], codes[a], logs[a].astype(np.float32), c[b], contexts[b], weights[b].astype(np.float32))


def _at(hashes: np.ndarray, codes: np.ndarray, wanted: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes in a hash array, and which are there."""
    if not len(hashes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(hashes, mix(wanted.astype(np.uint64), order)), len(hashes) - 1)
    return at, codes[at] == wanted


@dataclass(frozen=True)
class Model:
    languages: list[str]
    alphabet: np.ndarray
    levels: list[Level]  # from order 1 to ORDER
    temperature: float = 1.0
    limits: tuple[float, ...] = ()

    def logs(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probabilities (code, language) of the last symbol of each gram after the others."""
        if order == 0:
            return np.full((len(codes), len(self.languages)), -BITS * np.log(2))
        level = self.levels[order - 1]
        at, there = _at(level.hashes, level.codes, codes, order)
        out = level.logs[at].astype(float) if len(level.hashes) else np.zeros((len(codes), len(self.languages)))
        rest = np.flatnonzero(~there)
        if len(rest):
            shorter = codes[rest] & np.uint32((1 << BITS * (order - 1)) - 1)
            low = self.logs(shorter, order - 1)
            at, known = _at(level.context_hashes, level.context_codes, codes[rest] >> np.uint32(BITS), order)
            if len(level.context_hashes):
                low = low + np.where(known[:, None], level.weights[at], 0)
            out[rest] = low
        return out

    def entropy(self, text: str) -> np.ndarray:
        """Cross-entropy per symbol of a text with letters, by language."""
        codes, n = np.unique(grams_of(symbols_of(text, self.alphabet)), return_counts=True)
        return -(n @ self.logs(codes)) / n.sum()

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0, True
        e = self.entropy(text)
        best = int(np.argmin(e))
        share = 1 / np.exp(np.clip((e[best] - e) / self.temperature, -700, 0)).sum()
        return self.languages[best], float(share), bool(self.limits and e[best] > self.limits[best])


def build(languages: list[str], alphabet: np.ndarray, grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from (codes, counts) of the highest order by language."""
    tables: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [grams]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before a gram
        mask = np.uint32((1 << BITS * order) - 1)
        tables.insert(0, {k: np.unique(c & mask, return_counts=True) for k, (c, _) in tables[0].items()})
    levels: list[Level] = []
    model = Model(languages, alphabet, levels)
    for order, table in enumerate(tables, 1):
        codes = np.unique(np.concatenate([c for c, _ in table.values()])).astype(np.uint32)
        contexts = np.unique(codes >> np.uint32(BITS))
        low = np.exp(model.logs(codes & np.uint32((1 << BITS * (order - 1)) - 1), order - 1))
        weights = np.ones((len(contexts), len(languages)))
        logs = np.zeros((len(codes), len(languages)))
        place = np.searchsorted(contexts, codes >> np.uint32(BITS))
        for k, lang in enumerate(languages):
            own, n = table[lang]
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            discount = min(max(discount, 0.1), 0.9)
            count = np.zeros(len(codes))
            count[np.searchsorted(codes, own)] = n
            total = np.bincount(place, weights=count, minlength=len(contexts))
            kinds = np.bincount(place, weights=count > 0, minlength=len(contexts))
            some = total > 0
            weights[some, k] = discount * kinds[some] / total[some]
            kept = np.maximum(count - discount, 0) / np.maximum(total[place], 1)
            logs[:, k] = np.log(kept + weights[place, k] * low[:, k])
        levels.append(Level.of(codes, logs, contexts, np.log(weights), order))
    return model


def _entropies(model: Model):
    """(lang, e) of every learning text with a letter, and per task the summed ``loss`` of every temperature."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(model.languages)}
        loss = np.zeros(len(TRIED))

        def packed(true: list, own: list, losses: list) -> pa.RecordBatch:
            columns = [pa.array(true, pa.int64()), pa.array(own, pa.float64()), pa.array(losses, pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, ["lang", "e", "loss"])

        for batch in batches:
            for part in runs(batch, "text"):
                rows = [
                    (place[k], model.entropy(t))
                    for k, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()) if has_letter(t)
                ]
                if rows:
                    true, e = np.array([k for k, _ in rows]), np.array([x for _, x in rows])
                    own, gap = e[np.arange(len(e)), true], e - e.min(axis=1, keepdims=True)
                    far = gap[np.arange(len(e)), true]
                    loss += [(far / t + np.log(np.exp(np.maximum(-gap / t, -700)).sum(axis=1))).sum() for t in TRIED]
                    yield packed(true.tolist(), own.tolist(), [None] * len(rows))
        yield packed([None], [None], [loss.tolist()])

    return work


def _limits(found: DataFrame, n_languages: int) -> tuple[float, ...]:
    """For every language the cross-entropy that all but REJECTED_SHARE of its texts keep to, exactly: counts by bin
    tell the bins of the two values it lies between, and of these bins the different values are read."""
    texts = found.filter("lang is not null").withColumn("bin", F.floor(F.col("e") * BINS))
    counts: dict[int, list] = {}
    for r in texts.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "bin").collect():
        counts.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    places, wanted = {}, []
    for k, bins in counts.items():
        ends = np.cumsum([n for _, n in bins])
        at = (int(ends[-1]) - 1) * (1 - REJECTED_SHARE)
        low, high = (int(np.searchsorted(ends, i, side="right")) for i in (int(at), int(np.ceil(at))))
        places[k] = at, int(ends[low - 1]) if low else 0
        wanted.append((k, bins[low][0], bins[high][0]))
    out = [float("inf")] * n_languages
    if not wanted:
        return tuple(out)
    held = texts.join(F.broadcast(listed(found.sparkSession, wanted, "lang long, low long, high long")), "lang")  # a row per language
    values: dict[int, list] = {}
    for r in held.filter("bin between low and high").groupBy("lang", "e").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "e").collect():
        values.setdefault(r["lang"], []).append((r["e"], r["n"]))
    for k, (at, before) in places.items():
        ends = before + np.cumsum([n for _, n in values[k]])
        a, b = (values[k][int(np.searchsorted(ends, i, side="right"))][0] for i in (int(at), int(np.ceil(at))))
        out[k] = a + (b - a) * (at - int(at))
    return tuple(out)


def calibrated(model: Model, texts: DataFrame) -> Model:
    """The temperature that makes the true languages of all ``texts`` (lang, text) likeliest, and each language's
    rejection limit."""
    found, path = saved(texts.mapInArrow(_entropies(model), "lang long, e double, loss array<double>"), "entropies")
    sums = found.filter("loss is not null").select(F.posexplode("loss").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    loss = {r["i"]: r["x"] for r in sums.collect()}  # a row per temperature
    limits = _limits(found, len(model.languages))
    dropped(found.sparkSession, path)
    if all(np.isinf(limits)):
        return model
    return Model(model.languages, model.alphabet, model.levels, float(TRIED[min(loss, key=lambda i: (loss[i], i))]), limits)


def learn(docs: DataFrame, held_out: Column) -> Model:
    """Models of the texts of ``docs`` (doc_id, lang, text) that have a language and are not held out."""
    texts = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    letters = texts.select("text").mapInArrow(_letters, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    alphabet = alphabet_of([(r["letter"], r["n"]) for r in letters.collect()])  # at most 65,536 rows
    counts = texts.select("lang", "text").mapInArrow(_counted(alphabet), "lang string, gram long, n long")
    counts, _ = saved(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    found = counts.toArrow()  # a row per language and different gram
    lang = np.array(found["lang"].to_pylist(), object)
    gram, n = found["gram"].to_numpy().astype(np.uint32), found["n"].to_numpy()
    languages = sorted(set(lang.tolist()))
    if not languages:
        return Model([], alphabet, [])
    grams = {}
    for k in languages:
        own = lang == k
        order = np.argsort(gram[own])
        grams[k] = (gram[own][order], n[own][order])
    model = build(languages, alphabet, grams)
    return calibrated(model, texts.select("lang", "text"))


def _judged(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text"):
                rows = [model.judge(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return work


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``docs`` (doc_id, lang, text).

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out of learning.
    """
    held_out = remainder("doc_id", 5) == 0
    model = learn(docs.select("doc_id", "lang", "text"), held_out)
    out = docs.select("doc_id", "text").mapInArrow(_judged(model), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
