import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tripletide.llm import html_text, language, lines, mixing, near_dup, quality, suffixes, templates, token_files
from tripletide.llm.queries import tokenizer
from tripletide.llm.tables import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
EDGES = [(1, "one two"), (2, "ONE  two"), (3, None), (4, ""), (None, "one two"), (5, " \n"), (7, "a b c d e f"), (7, "q r s t u v"), (8, "x " * 3000)]


def _docs(spark, rows=()):
    given = table(spark, SF, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    return spark.createDataFrame([*EDGES, *rows], DOC).unionByName(given)


def _key(rows):
    return Counter(tuple(r) for r in rows)


def test_near_duplicates_equal_brute_force(spark):
    docs = _docs(spark)
    want = brute.near_duplicates([tuple(r) for r in docs.collect()])
    assert _key(near_dup.near_duplicates(docs).collect()) == _key(want)
    assert near_dup.near_duplicates(docs.limit(0)).collect() == []


def test_near_duplicates_of_a_large_group_with_different_edits(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for p in r.sample(range(150), i % 7):
            text[p] = f"e{i}x{p}"
        rows.append((i, " ".join(text)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert _key(got) == _key(brute.near_duplicates(rows))


def test_keep_first_keeps_one_row_of_a_group(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0), (2, "A b c d e f", 1), (2, "A b c d e f", 1), (3, None, 2), (3, None, 2), (None, "z z z z z", 3)], DOC + ", class__ int")
    got = near_dup.keep_first(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter([1, 3, 3, None])


def test_passages_equal_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = [[r.choice(vocabulary) for _ in range(r.randint(20, 90))] for _ in range(20)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(shared)
            text += p[: r.randint(0, len(p))] if r.random() < 0.5 else p
            text += [r.choice(vocabulary) for _ in range(r.randint(0, 8))]
        rows.append((i, " ".join(text)))
    rows += [(900, "x " * 300), (901, "x " * 70), (902, "y " * 49), (903, "a b " * 100), (904, "q a b " + "a b " * 60), (905, None), (906, "")]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, DOC)).collect()
    assert {(x["doc_id"], x["start"], x["end"]) for x in got} == brute.passages(rows)
    assert suffixes.repeated_passages(spark.createDataFrame([], DOC)).collect() == []


def test_rows_that_repeat_as_a_whole_take_no_second_shuffle_of_texts(spark):
    long, longer = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("v", 60), ("u", 75)))
    rows = [(1, long), (1, long), (2, "other"), (2, "other"), (3, longer), (3, longer), (3, longer), (4, "t " + longer), (None, long)]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, DOC))
    # all that the result is made of are tables of hashes, places and counts
    assert not re.search(r"\btext#", got._jdf.queryExecution().analyzed().toString())
    assert {(r["doc_id"], r["start"], r["end"], r["n_words"]) for r in got.collect()} == {(1, 0, 60, 60), (3, 0, 75, 75), (4, 1, 76, 75), (None, 0, 60, 60)}


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    docs = _docs(spark, [(9, "z<|endoftext|> y"), (10, "½ cup, it's 12kg_foo\t\tx  \n\n y \U0001F600")])
    got = token_files.token_digest(docs, tokenizer()).orderBy("start").collect()
    whole = Tokenizer.from_file(tokenizer())
    want = Counter()
    for d, text in docs.collect():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert got[0]["doc_id"] is None and ids == sorted(ids)
    assert token_files.token_digest(docs.limit(0), tokenizer()).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 700, 20000])
def test_code_words_are_limited_and_decode(n):
    r = np.random.default_rng(n)
    counts = (10.0 ** r.uniform(0, 9, n)).astype(np.int64)
    code = token_files.Code(token_files.code_lengths(counts))
    ids = r.choice(n, 3000).astype("<u2")
    payload, marks = token_files.pack(ids, code, code.words())
    assert code.limit <= token_files.LIMIT
    assert all((x == ids).all() for x in token_files.unpack([payload] * 2, [marks] * 2, [3000] * 2, code))


def test_mix_meets_targets_and_equals_its_texts(spark):
    docs = table(spark, SF, "documents")
    rows = mixing.mix(docs, (5, 2, 1)).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    assert abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1
    mixed = mixing.mixed(docs, (5, 2, 1))
    sizes = mixed.groupBy("doc_id").agg(F.sum(mixing.size_of()).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in sizes} == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    odd = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "d", None), (3, None, None)], "doc_id long, text string, source string")
    assert mixing.mix(odd, (5, 2, 1)).count() == 4
    assert mixing.mix(odd.limit(0), (5, 2, 1)).collect() == [] == mixing.mixed(odd.limit(0), (5, 2, 1)).collect()


def test_targets_share_what_lies_above_three_sizes():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 0], [5, 2, 1]) == [30.0, 80.0, 0.0]


def test_main_text():
    long = "This is the text of the story and it is told by the people who were there for a long time, with all of it."
    page = (
        f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>{long}</div><article><h1>Head</h1>"
        f"<p>{long}<br>A&amp;B&nbsp;c<p>Short.<script>var t='</p>';</script><div class=ad>{long}</div><section id=comments><p>{long}</section></article>"
        f"<aside>{long}</aside><form>{long}</form><footer>{long}</footer>"
    )
    assert html_text.main_text(page) == f"Head\n{long} A&B c\nShort."
    assert html_text.main_text(f"<div>{long}</div><p>End.") == f"{long}\nEnd."
    assert [html_text.main_text(x) for x in (None, "", "plain", "<!-- x", "a < b", "<p cla")] == ["", "", "plain", "", "a < b", ""]


def test_language_accuracy_and_probabilities(spark):
    docs = table(spark, SF, "documents")
    rows = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    model = language.learn(docs, F.lit(False))
    context = int(language.grams_of(language.symbols_of("the end", model.alphabet))[4]) >> language.BITS << language.BITS
    total = np.exp(model.logs(np.uint32(context) + np.arange(language.SYMBOLS, dtype=np.uint32))).sum(axis=0)
    assert np.allclose(total, 1, atol=1e-5)
    odd = spark.createDataFrame([(1, None, None), (2, "en", "12 34"), (None, None, "hi")], "doc_id long, lang string, text string")
    assert {r["lang_pred"] for r in language.languages(odd).collect()} == {"und"}
    assert language.languages(odd.limit(0)).collect() == []


def test_main_text_in_languages_without_stop_words():
    russian = "Это длинный рассказ о людях, которые жили тогда в маленьком городе у реки и помнили всё, что там случилось."
    polish = "Jest to długa opowieść o ludziach, którzy mieszkali wtedy w małym mieście nad rzeką i pamiętali wszystko."
    chinese = "这是一个关于当时住在河边小城里的人们的长篇故事他们记得在那里发生的一切事情" * 3
    english = "This is the text of the story and it is told by the people who were there for a long time, with all of it."
    code = "for (int i = 0; i < count; i++) { total += values[i] * weights[i]; result.push(total); }"
    menu = "<nav><a href=x>Menu</a></nav>"
    foot = "<footer>Impressum</footer>"
    for text in (russian, polish, chinese):
        assert html_text.main_text(f"{menu}<h1>Head</h1><p>{text}</p><p>{text}</p>{foot}").endswith(f"{text}\n{text}")
    assert html_text.main_text(f"{menu}<p>{english}<p>{russian}<p>{english}") == f"{english}\n{russian}\n{english}"
    assert html_text.main_text(f"<p>{english}</p><pre>{code.replace('<', '&lt;')}</pre><p>{english}") == f"{english}\n{code}\n{english}"
    assert html_text.main_text(code.replace("<", "&lt;")) == code
    assert html_text.main_text(f"{menu}<p>Only this.</p>{foot}") == "Only this."
    listed = "cheap flights hotels cars deals offers prices booking travel summer winter beach city tours"
    assert html_text.main_text(f"<p>{english}<p>{english}<div>{listed}</div>") == f"{english}\n{english}"
    linked = "<article><ul><li><a href=x>tag</a></ul><h1><a href=x>Head of it</a></h1><ul><li><a href=x>tag</a></ul>"
    assert html_text.main_text(f"{linked}<p>{english}</article>") == f"Head of it\n{english}"


def test_languages_in_the_shadow_of_a_hot_one(spark):
    r = random.Random(2)
    scripts = {"ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "ka": range(0x10D0, 0x10F1), "zh": range(0x4E00, 0x5A00), "ja": range(0x5A00, 0x6600)}
    rows = []
    for i in range(1500):
        letters = [chr(x) for x in r.choices([*range(97, 123), *range(0xE0, 0xF7), *range(0x100, 0x140, 2)], k=120)]
        rows.append((i, "en", " ".join("".join(letters[k : k + 6]) for k in range(0, 120, 6))))
    for n, (lang, script) in enumerate(scripts.items()):
        rows += [(10000 * (n + 1) + i, lang, "".join(chr(r.choice(script)) for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {x["doc_id"]: x["lang_pred"] for x in language.languages(docs).filter("held_out").collect()}
    assert len(got) > 300
    right = Counter(lang for d, lang, _ in rows if d in got and got[d] == lang)
    assert all(right[lang] >= 0.9 * sum(d in got and k == lang for d, k, _ in rows) for lang in ("en", *scripts))


def test_every_letter_has_a_spelling_of_its_own():
    letters = np.unique(language._folded())[1:]
    alphabet = language.alphabet_of([(int(x), 1 + int(x) % 1000) for x in letters])
    spelled = {bytes(alphabet[x]).rstrip(b"\0") for x in letters}
    assert len(spelled) == len(letters) and b"" not in spelled
    some = {bytes(x) for x in language.alphabet_of([(97, 1)])[letters]}
    assert len(some) == len(letters)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "a")], DOC)
    assert {(r["score"], r["predicted"]) for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {(0.5, 1)}
    assert quality.quality_scores(odd.limit(0), labels).collect() == []
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def test_leaks_by_template(spark):
    item = "John has 3 apples and gives 2 apples to Mary who then walks 5 km with John."
    items = spark.createDataFrame([(1, item), (2, "short item here"), (None, "x y"), (3, None), (4, "")], "item_id long, text string")
    ask = "we saw that Peter has 7 apples and gives 9 apples to Anna who then walks 11 miles with {} today"
    docs = spark.createDataFrame([(1, ask.format("Peter")), (2, ask.format("Anna")), (3, "a short item here too"), (None, item), (5, None), (6, "")], DOC)
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in templates.leaks(docs, items).collect()}
    assert got == {(1, 1): False, (3, 2): True, (None, 1): True}
    assert {r["doc_id"] for r in templates.without_leaks(docs, items).collect()} == {2, 5, 6}
    assert templates.leaks(docs, items.limit(0)).collect() == [] == templates.leaks(docs.limit(0), items).collect()


def test_leaks_of_items_rich_in_slots(spark):
    texts = ["Compute 12 + 34 - 56 * 78 / 9 + 10", "we met Anna Berg, Carl Dahl, Eva Falk, Georg Holm and Ida Juhl", "the table 1 2 3 4 5 6 7 8 9 10 11 12 13 14"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = [(i, f"before it all {t} after it all") for i, t in enumerate(texts)] + [(9, "Compute 12 + 34 - 56 * 78 / 9 + 11")]
    got = templates.leaks(spark.createDataFrame(docs, DOC), items).collect()
    assert {(r["doc_id"], r["item_id"], r["matched"] == r["item_words"], r["exact"]) for r in got} == {(i, i, True, True) for i in range(3)}


def test_leaks_with_names_that_open_sentences(spark):
    ask = "{0} has {1} red apples. {0} buys {2} more apples. {0} eats {3} of them."
    items = spark.createDataFrame([(1, ask.format("Tom", 3, 4, 2)), (2, "The cat sleeps on the mat while the dog barks.")], "item_id long, text string")
    rows = [(1, ask.format("Sam", 5, 6, 3)), (2, "We know that {}".format(ask.format("Sam", 5, 6, 3))), (3, "but the cat sleeps on the mat while the dog barks")]
    mixed_up = (4, "Sam has 5 red apples. Ann buys 6 more apples. Joe eats 3 of them.")
    got = templates.leaks(spark.createDataFrame([*rows, mixed_up], DOC), items).collect()
    assert {(r["doc_id"], r["item_id"], r["exact"]) for r in got} == {(1, 1, False), (2, 1, False), (3, 2, True)}


def test_one_inconsistent_slot_leaves_the_rest_of_a_leak(spark):
    item = ["so"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(58)]
    item[10], item[45], item[30] = "7", "7", "8"
    one, other = list(item), list(item)
    one[45] = "9"
    other[10], other[45], other[30] = "5", "6", "4"
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(other)), (3, " ".join(item))], DOC)
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["matched"], r["item_words"], r["exact"]) for r in templates.leaks(docs, items).collect()}
    assert got == {1: (58, 59, True), 2: (57, 59, False), 3: (59, 59, True)}


def test_boilerplate_lines(spark):
    rows = [(i, f"own line {i}\n shared  \n\nnear {i // 12}", f"s{i % 11}") for i in range(44)]
    rows += [(100, None, "s1"), (101, "", None), (102, "shared", None), (102, "shared", None)]
    docs = spark.createDataFrame(rows, DOC + ", source string")
    got = {r["doc_id"]: r for r in lines.without_boilerplate(docs, sites=11).collect()}
    spread = {}
    for d, text, s in rows:
        for x in (text or "").split("\n"):
            if x.strip(" "):
                spread.setdefault(x.strip(" "), set()).add(s)
    for d, text, _ in rows:
        kept = [x for x in (text or "").split("\n") if len(spread.get(x.strip(" "), set()) - {None}) < 11]
        assert got[d]["text"] == "\n".join(kept)
    assert lines.without_boilerplate(docs).count() == len(rows)
    assert lines.without_boilerplate(docs.limit(0)).collect() == []


def test_language_limits_and_temperature_come_from_all_learning_texts(spark):
    rng = random.Random(5)
    rows = [(k, "ab"[i % 2], " ".join(rng.choices(("ana bana", "cab", "dada", "efe") if i % 2 else ("ono", "mopo", "dada", "efe"), k=6)))
            for k, i in enumerate(range(24_000))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(8)
    model = language.learn(docs, F.lit(False))
    known = {t: model.entropy(t) for t in {t for _, _, t in rows}}
    e = np.array([known[t] for _, _, t in rows])
    true = np.array([model.languages.index(k) for _, k, _ in rows])
    for k in range(2):
        assert model.limits[k] == pytest.approx(np.quantile(e[true == k, k], 1 - language.REJECTED_SHARE), rel=1e-12)
    gap = e - e.min(axis=1, keepdims=True)
    own = gap[np.arange(len(e)), true]
    loss = [(own / t + np.log(np.exp(np.maximum(-gap / t, -700)).sum(axis=1))).mean() for t in language.TRIED]
    assert model.temperature == language.TRIED[int(np.argmin(loss))]
