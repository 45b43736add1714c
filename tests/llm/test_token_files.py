import zlib

import numpy as np
from tokenizers import Tokenizer

from tripletide.llm import token_files as T
from tripletide.llm.queries import tokenizer


def test_words_are_cached_and_halves_forgotten():
    whole, enc = Tokenizer.from_file(tokenizer()), T.Encoder(tokenizer())
    texts = ["", " ", "It's  a\n\n test_case, isn't it?", "x\x1cy", "café ² \U0001f600", "<|endoftext|> a", "tail  ", "\t\tdeep  \n x1y22 ", "a b\nc d\ne", "a\n\n\nb", "a \nb", "a\n b", "\na", "a\n", "don't 12ab\n34 x_y"] + [f"w{i} v{i}" for i in range(300)]
    kept, T.CACHED_WORDS = T.CACHED_WORDS, 50
    try:
        for text in texts:
            assert np.frombuffer(enc.encode(text), enc.width).tolist() == whole.encode(text, add_special_tokens=False).ids
            assert max(map(len, (enc.words, enc.spaced, enc.fine))) < 60
    finally:
        T.CACHED_WORDS = kept


def test_very_many_empty_texts_take_linear_time(spark):
    docs = spark.range(70_000).selectExpr("id AS doc_id", "if(id % 7 = 0, null, '') AS text", "1 AS shard")
    got = T.token_digest(docs, tokenizer()).orderBy("doc_id").collect()
    crc = zlib.crc32(np.array([2], "<u4").tobytes())
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got[:3]] == [(i, i, 1, crc) for i in range(3)]
    assert len(got) == 70_000 and got[-1]["start"] == 69_999


def test_ids_are_counted_while_they_are_made(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('word ', id % 7, ' another') AS text").repartition(3)
    rows = docs.mapInArrow(T._tokenized(tokenizer(), 2, 50_257), "shard int, at long, doc_id long, n long, ids binary, counts binary").collect()
    for shard in range(3):
        own = [r for r in rows if r["shard"] == shard]
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in own if r["counts"] is None), "<u2")
        (last,) = [r for r in own if r["counts"] is not None]
        assert last is own[-1] and last["at"] == len(ids)
        assert (np.frombuffer(bytes(last["counts"]), np.int64) == np.bincount(ids, minlength=50_257)).all()


def test_words_are_held_once_and_freed_before_packing():
    enc = T.encoder(tokenizer())
    T.forget_words()
    enc.encode("so one, (two) three 3, one two, three. and, and")
    assert not any(part.strip().isalpha() for part in enc.fine)  # these stand with the words
    assert "two" in enc.words and "one" in enc.spaced and "and," in enc.spaced
    assert list(T._packed({}, np.zeros(0, np.uint8), "<u2")(iter([]))) == []
    assert not enc.words and not enc.spaced and not enc.fine


def test_texts_of_a_run_ask_once_for_each_word():
    whole, enc = Tokenizer.from_file(tokenizer()), T.Encoder(tokenizer())
    asked = []

    class Counted(T._Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    enc.words, enc.spaced = Counted(enc, ""), Counted(enc, " ")
    texts = ["one two, two.\nthree one's x!? dogs'", "", "two", "  gap one", "x\x1cy one", "one\ntwo\nthree", "\n", "<|endoftext|> one", "über één\nÈé, 12ab. _."] * 200
    ids, lengths = enc.encode_all(texts, np.array([2], enc.width).tobytes())
    want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert asked.count("two,") == asked.count("dogs'") == 1  # texts whose gaps are wider ask for their own words
    none, sizes = enc.encode_all([], b"")
    assert len(none) == len(sizes) == 0
