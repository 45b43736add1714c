"""Token ids in Huffman-coded files.

``write_tokens`` tokenizes whole texts, orders the documents, counts every id over the whole
corpus and writes the ids with one canonical, length-limited Huffman code. ``read_tokens``
decodes the files again.

Files: a folder with ``code`` (one row: code length of every id) and ``blocks`` (Parquet rows,
foldered by shard). Shards follow each other in ascending order of the documents; inside a
shard ``start`` orders the blocks. A block holds whole documents, at least BLOCK_TOKENS ids
unless a file ends, and stands alone: ``doc_ids``, ``lengths`` (ids of each document),
``start`` (ids of all documents before it), ``checkpoints`` (bit offset of every
CHECKPOINT-th id) and ``payload`` (the code words, most significant bit first).

Cases: a null text is empty; every document ends with ``end_id``, so an empty one has one id.
Documents with a null id come first. Equal ids are ordered by a hash of the text, equal rows
are interchangeable and all are written. An empty table gives no block and an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletide.llm.tables import dropped, runs
from tripletide.scratch import scratch_path

LIMIT = 16
CHECKPOINT = 512
BLOCK_TOKENS = 1 << 16
# Entries of a worker's cache of words; a full cache loses its older half.
CACHED_WORDS = 800_000

# The outer cuts of the byte-level pattern: no token crosses them.
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Without these, and no blank at either end, the pieces are lines' words, each with the blank before it, and line ends.
_GAPS = ("  ", "\n\n", "\n ", " \n", "\t", "\r", "\x0b", "\x0c")
# Marks that are a part of their own behind letters.
_MARKS = frozenset(".,;:!?")
_FINE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _odd_pattern() -> str:
    """Characters of the basic plane that Python's classes and the tokenizer's Unicode classes see differently."""
    odd = []
    for i in range(1 << 16):
        c = chr(i)
        if 0xD800 <= i <= 0xDFFF:
            continue
        if (c.isspace() and c not in " \n\t\r\x0b\x0c") or (c.isalnum() and not c.isalpha() and not c.isdecimal()):
            odd.append(re.escape(c))
    return "[" + "".join(odd) + "]"


class _Words(dict):
    """Ids of words met before, each with ``before`` in front; a new one is learnt when it is asked for."""

    def __init__(self, encoder: Encoder, before: str):
        self.encoder, self.before, self.spelled = encoder, before, encoder.spell(before)

    def __missing__(self, word: str) -> bytes:
        enc = self.encoder
        if word.isalpha():
            held = enc.spelled_ids(self.spelled + (word if word.isascii() else enc.spell(word)))
        elif word[-1:] in _MARKS and word[:-1].isalpha():
            held = self[word[:-1]] + enc.learn([word[-1]])
        else:
            held = enc.learn(_FINE.findall(self.before + word))
        self[word] = held
        return held


class Encoder:
    """Ids of texts by the tokenizers library, with a cache of the words met before.

    The byte-level pattern cuts a text into words that are tokenized independently, so each
    word goes through the library's model once. Many texts are encoded together: the cache is
    asked once for each different word of theirs, and the ids are dealt out by arrays. Texts with
    characters on which the pattern's classes could differ, or with a special token, go through
    the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.width = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile(_odd_pattern())
        spelled = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        rest = [b for b in range(256) if b not in set(spelled)]
        self.letters = {b: b for b in spelled} | {b: 256 + k for k, b in enumerate(rest)}
        self.packers = [struct.Struct(f"<{n}{'H' if self.width == '<u2' else 'I'}").pack for n in range(32)]
        self.words, self.spaced = _Words(self, ""), _Words(self, " ")
        self.fine: dict[str, bytes] = {}
        said = json.loads(self.whole.to_str())
        self.plain = self._is_plain(said)
        self.model = self._uncached(said["model"]) if self.plain else self.whole.model

    def _is_plain(self, said: dict) -> bool:
        """Whether this file is a plain byte-level model, the only kind that may be cut into words."""
        kind = said.get("pre_tokenizer") or {}
        return (
            said.get("normalizer") is None and said["model"].get("type") == "BPE" and not said["model"].get("ignore_merges")
            and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        )

    def _uncached(self, model: dict):
        """The library's model without its own cache, which is no use where each word comes once."""
        from tokenizers.models import BPE

        names = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback")
        merges = [tuple(m) for m in model["merges"]]
        return BPE(model["vocab"], merges, cache_capacity=0, **{k: model[k] for k in names if model.get(k) is not None})

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def spell(self, part: str) -> str:
        """The bytes of ``part`` in the letters of the model."""
        return part.encode().decode("latin-1").translate(self.letters)

    def spelled_ids(self, spelled: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(spelled)]
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else self._bytes(ids)

    def learn(self, parts: list[str]) -> bytes:
        """Ids of a word's parts; parts of letters are words themselves and stand with these only."""
        out = []
        for part in parts:
            if part.isalpha():
                held = self.words[part]
            elif part[0] == " " and part[1:].isalpha():
                held = self.spaced[part[1:]]
            else:
                held = self.fine.get(part)
                if held is None:
                    held = self.fine[part] = self.spelled_ids(self.spell(part))
            out.append(held)
        return b"".join(out)

    def forget(self) -> None:
        for cache in (self.words, self.spaced, self.fine):
            cache.clear()

    def _is_odd(self, text: str) -> bool:
        if any(t in text for t in self.special):
            return True
        if text.isascii():
            return any(c in text for c in "\x1c\x1d\x1e\x1f")
        return len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text) or self.odd.search(text) is not None

    def _is_lines(self, text: str) -> bool:
        """Whether blanks and line ends are all that cuts ``text``, each of them alone."""
        return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(gap in text for gap in _GAPS)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text], b"")[0].tobytes()

    def encode_all(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with ``end`` behind it, and their number by text."""
        for cache in (self.words, self.spaced, self.fine):
            if len(cache) > CACHED_WORDS:
                for word in list(islice(cache, len(cache) // 2)):
                    del cache[word]
        line = self.words["\n"] if self.plain else b""
        lines: list[str | None] = []  # with a blank before every line end, and a line end more in front; no value for other texts
        tails, tail = [end], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            odd = not self.plain or self._is_odd(text)
            if not odd and self._is_lines(text):
                lines.append("\n" + text.replace("\n", " \n"))
                continue
            lines.append(None)
            tail[i] = len(tails)
            if odd:
                tails.append(self._bytes(self.whole.encode(text, add_special_tokens=False).ids) + end)
            else:
                tails.append(b"".join(map(self.words.__getitem__, _PIECES.findall(text))) + end)
        parts = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        words = parts.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        held = [line + self.words[w[1:]] if w[0] == "\n" else self.spaced[w] for w in known] + tails

        # What stands where: the words of a text, then its tail.
        nth, behind = np.arange(len(texts)), parts.offsets.to_numpy()
        first, last = behind[:-1] + nth, behind[1:] + nth
        at = np.zeros(len(words) + len(texts), np.int64)
        is_word = np.ones(len(at), bool)
        is_word[last] = False
        at[is_word] = words.indices.to_numpy()
        at[last] = len(known) + tail

        size = np.fromiter(map(len, held), np.int64, len(held)) // np.dtype(self.width).itemsize
        begin = (np.cumsum(size) - size)[at]
        size = size[at]
        first = first[last > first]  # the line end in front goes again
        extra = len(line) // np.dtype(self.width).itemsize
        begin[first] += extra
        size[first] -= extra
        ends = np.cumsum(size)
        place = np.repeat((begin + size - ends).astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        return np.frombuffer(b"".join(held), self.width)[place], np.diff(ends[last], prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_TOKENS = pa.schema([("shard", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def forget_words() -> None:
    """Frees the words this worker has met, which it would hold while other tasks need its memory."""
    for enc in _encoders.values():
        enc.forget()


def _tokenized(path: str, end_id: int, vocabulary: int):
    """Ids by document; a shard's last row, the only one with ``counts``, has its number of ids in ``at``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at, shard = encoder(path), 0, TaskContext.get().partitionId()
        end = np.array([end_id], enc.width).tobytes()
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part in runs(batch, "text"):
                ids, lengths = enc.encode_all([t or "" for t in part.column("text").to_pylist()], end)
                before = np.cumsum(lengths) - lengths
                total += np.bincount(ids, minlength=vocabulary)
                bounds = pa.array(np.append(before, len(ids)) * len(end), pa.int32())
                coded = pa.Array.from_buffers(pa.binary(), len(lengths), [None, bounds.buffers()[1], pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lengths), shard, np.int32)), pa.array(at + before), part.column("doc_id").cast(pa.int64()), pa.array(lengths), coded, pa.nulls(len(lengths), pa.binary())],
                    schema=_TOKENS,
                )
                at += len(ids)
        if at:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "at": at, "counts": total.tobytes()}], _TOKENS)

    return work


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for counts in batch.column("counts"):
            total = np.frombuffer(counts.as_buffer(), np.int64)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "count"])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code whose words have at most ``limit`` bits (package-merge).

    Ids that never occur get length 0; a single id gets 1.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit in code words of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    lists, level = [], np.zeros(0)
    for _ in range(limit):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        sort = np.argsort(both, kind="stable")
        level = both[sort]
        lists.append(sort < len(weights))
    take, depth = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for leaf in reversed(lists):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


@dataclass(frozen=True)
class Code:
    """The canonical code of given lengths: words ascend by (length, id)."""

    lengths: np.ndarray

    @property
    def limit(self) -> int:
        return max(1, int(self.lengths.max(initial=0)))

    def words(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        span = np.uint64(1) << (self.limit - self.lengths[order].astype(np.int64)).astype(np.uint64)
        first = np.cumsum(span) - span
        words = np.zeros(len(self.lengths), np.uint64)
        words[order] = first >> (self.limit - self.lengths[order].astype(np.int64)).astype(np.uint64)
        return words

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The id and the length that every ``limit`` bits begin with."""
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        repeat = 1 << (self.limit - self.lengths[order].astype(np.int64))
        ids, size = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.int64)
        filled = np.repeat(order, repeat)
        ids[: len(filled)] = filled
        size[: len(filled)] = self.lengths[filled]
        return ids, size


def pack(ids: np.ndarray, code: Code, words: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code words of ``ids`` in a row, and the bit offset of every CHECKPOINT-th id."""
    lengths = code.lengths.astype(np.int64)
    size = lengths[ids]
    offset = np.cumsum(size) - size
    bits = int(size.sum())
    cells = np.zeros(bits // 64 + 2, np.uint64)
    cell, skip = offset >> 6, offset & 63
    word = (words << np.where(lengths > 0, 64 - lengths, 0).astype(np.uint64))[ids]  # from a cell's first bit on
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    cells[cell[starts]] = np.bitwise_or.reduceat(word >> skip.astype(np.uint64), starts)
    over = np.flatnonzero(skip + size > 64)
    cells[cell[over] + 1] |= word[over] << (64 - skip[over]).astype(np.uint64)
    return cells.astype(">u8").tobytes()[: (bits + 7) // 8], offset[::CHECKPOINT]


def unpack(payloads: list[bytes], checkpoints: list[np.ndarray], totals: list[int], code: Code) -> list[np.ndarray]:
    """Ids of several blocks. All stretches between checkpoints are decoded side by side."""
    ids, size = code.table()
    raw = np.frombuffer(b"".join(p + bytes(4) for p in payloads), np.uint8)
    wide = np.zeros(len(raw), np.uint32)
    for i in range(4):
        wide[: len(raw) - i] |= raw[i:].astype(np.uint32) << np.uint32(24 - 8 * i)
    base = np.cumsum([0, *[len(p) + 4 for p in payloads]])[:-1] * 8
    lanes = [len(c) for c in checkpoints]
    at = np.concatenate([c + b for c, b in zip(checkpoints, base)]).astype(np.int64)
    left = np.concatenate([np.minimum(n - CHECKPOINT * np.arange(k), CHECKPOINT) for n, k in zip(totals, lanes)])
    out = np.zeros((len(at), CHECKPOINT), np.uint32)
    order = np.argsort(-left, kind="stable")  # the lanes still at work come first
    at, left = at[order], left[order]
    live, mask = len(at), np.uint32((1 << code.limit) - 1)
    done = np.zeros((CHECKPOINT, len(at)), np.uint32)
    for step in range(CHECKPOINT):
        while live and left[live - 1] <= step:
            live -= 1
        if not live:
            break
        now = at[:live]
        seen = (wide[now >> 3] >> (32 - code.limit - (now & 7)).astype(np.uint32)) & mask
        done[step, :live] = ids[seen]
        now += size[seen]
    out[order] = done.T
    ends = np.cumsum(lanes)
    return [out[e - k : e].reshape(-1)[:n] for e, k, n in zip(ends, lanes, totals)]


_BLOCK = "shard int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, checkpoints array<long>, payload binary"


def _packed(base: dict[int, int], lengths: np.ndarray, width: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()  # all texts are tokenized by now
        code = Code(lengths)
        words = code.words()
        held: list[tuple[int, int, int | None, int, np.ndarray]] = []
        total = 0

        def block():
            payload, marks = pack(np.concatenate([h[4] for h in held]), code, words)
            row = [held[0][0], base[held[0][0]] + held[0][1], total, [h[2] for h in held], [h[3] for h in held], marks.tolist(), payload]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "at", "doc_id", "n")]
            for shard, at, doc, n, ids in zip(*cols, batch.column("ids")):
                if held and (shard != held[0][0] or at != held[-1][1] + held[-1][3] or total >= BLOCK_TOKENS):
                    yield block()
                    total = 0
                held.append((shard, at, doc, n, np.frombuffer(ids.as_py(), width)))
                total += n
        if held:
            yield block()

    return work


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end_id: int = 2, limit: int = LIMIT) -> None:
    """Tokenizes ``docs`` (doc_id, text) with the file ``tokenizer`` and writes them under ``out``."""
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    width, vocabulary = enc.width, max(enc.whole.get_vocab_size(), end_id + 1)
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    tokens = ordered.mapInArrow(_tokenized(tokenizer, end_id, vocabulary), "shard int, at long, doc_id long, n long, ids binary, counts binary")
    path = scratch_path(spark, "tokens")
    tokens.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(tokens.schema).parquet(path)
    ends, tokens = tokens.filter("counts is not null"), tokens.filter("counts is null").drop("counts")

    counts = np.zeros(vocabulary, np.int64)  # one number for each id of the vocabulary
    for r in ends.select("counts").mapInArrow(_counted, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect():
        counts[r["id"]] = r["count"]
    lengths = code_lengths(counts, limit)
    base, total = {}, 0  # one number for each shard
    for r in ends.select("shard", "at").orderBy("shard").collect():
        base[r["shard"]], total = total, total + r["at"]
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{out}/code")
    blocks = tokens.mapInArrow(_packed(base, lengths, width), _BLOCK)
    blocks.write.option("compression", "uncompressed").partitionBy("shard").parquet(f"{out}/blocks")
    dropped(spark, path)


def _decoded(lengths: bytes, wanted: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            rows, held, size = batch.to_pylist(), [], 0
            for i, row in enumerate(rows):
                held.append(row)
                size += row["n_tokens"]
                if size < 16 * BLOCK_TOKENS and i + 1 < len(rows):
                    continue
                ids = unpack([r["payload"] for r in held], [np.array(r["checkpoints"], np.int64) for r in held], [r["n_tokens"] for r in held], code)
                for r, all_ids in zip(held, ids):
                    ends = np.cumsum(r["lengths"])
                    begins = ends - np.array(r["lengths"])
                    cut = [all_ids[b:e] for b, e in zip(begins, ends)]
                    last = pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cut], pa.int64()) if wanted == "ids_crc32" else pa.array([c.astype(np.int64) for c in cut], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(begins + r["start"]), pa.array(r["lengths"], pa.int64()), last], ["doc_id", "start", "n_tokens", wanted])
                held, size = [], 0

    return work


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files under ``path``; ``digest`` gives ids_crc32 for ids."""
    lengths = bytes(spark.read.schema("lengths binary").parquet(f"{path}/code").head()[0])
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").drop("shard")
    last = ("ids_crc32", "long") if digest else ("ids", "array<long>")
    return blocks.mapInArrow(_decoded(lengths, last[0]), f"doc_id long, start long, n_tokens long, {last[0]} {last[1]}")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the token files in the scratch folder and returns what they hold, by document."""
    out = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, tokenizer, out, end_id)
    return read_tokens(docs.sparkSession, out, digest=True)
