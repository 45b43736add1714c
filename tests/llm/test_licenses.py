import random
import re
import string

import pytest
from pyspark.sql import Row

from tripletide.llm import licenses as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def places(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def brute(doc_id, text):
    w = words(text)
    base = [(i, label) for label, phrase in L.BASE for i in places(w, phrase)]
    labels, best = {label for label, phrase in L.BASE + L.PHRASES if places(w, phrase)}, 0.0
    for label, phrase in L.BASE + L.PHRASES:
        best = max([best] + [1.0 for _ in places(w, phrase)])
        p = phrase.split()
        if len(p) == 3 or len(p) > 4:  # parts of a phrase count for the score
            k = 2 if len(p) == 3 else 4
            grams = {tuple(p[j : j + k]): j for j in range(len(p) - k + 1)}
            votes = {}
            for i in range(len(w) - k + 1):
                j = grams.get(tuple(w[i : i + k]))
                if j is not None:
                    votes.setdefault(i - j, set()).add(j)
            best = max([best] + [len(v) / (len(p) - k + 1) for v in votes.values()])
    for label, notice in L.NOTICES:
        t = words(notice)
        at = {}
        for j in range(len(t) - 3):
            at.setdefault(tuple(t[j : j + 4]), []).append(j)
        votes = {}
        for i in range(len(w) - 3):
            for j in at.get(tuple(w[i : i + 4]), ()):
                votes.setdefault(i - j, set()).add(j)
        held, last = set(), None
        for d in sorted(votes) + [None]:
            if d is None or last is None or d - last > L.SHIFT:
                share = len(held) / (len(t) - 3)
                best = max(best, share)
                if share >= L.COVER:
                    labels.add(label)
                held = set()
            if d is not None:
                held |= votes[d]
                last = d
    starts = [i for i, _ in base]
    return (
        doc_id, len(w), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), round(best, 9),
    )


def corpus():
    rng = random.Random(5)
    pieces = [p for _, p in L.BASE + L.PHRASES + L.NOTICES] + ["MIT", "License", "gnu general", "\u00c9t\u00e9 2\u00b2", "cc", "by", "by cc by", "apache\x00license", "mit_license"]
    docs = [(i, "; ".join(rng.choice(pieces) for _ in range(rng.randrange(6)))) for i in range(80)]
    for i in range(40):  # notices with lost, doubled and changed words
        w = words(rng.choice(L.NOTICES)[1])
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [w[k], w[k]], ["other"]])
        docs.append((100 + i, " ".join(w[: rng.randrange(len(w) + 1)] + ["end"])))
    return docs + [(None, "MIT license"), (None, None), (None, "MIT license"), (3, "cc by cc by cc by"), (3, ""), (7, "\U00010400 MIT\u212a LICENSE mit license")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS pos", "2 AS k", "'x' AS words", "0 AS hash", "0 AS template")


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_equals_brute_force(spark):
    docs = corpus()
    got = [(*r[:7], round(r[7], 9)) for r in L.license_labels(frame(spark, docs)).collect()]
    assert in_order(got) == in_order(brute(*d) for d in docs)


def test_spans_of_an_edited_notice(spark):
    text = L.NOTICES[0][1].replace("free of charge", "wholly free of any charge").replace("merge, ", "")
    rows = L.license_spans(frame(spark, [(1, "some words first. " + text + " and after")])).collect()
    assert [(r["label"], r["first_word"]) for r in rows] == [("mit", 3)]
    assert rows[0]["share"] > 0.6 and rows[0]["last_word"] == 3 + len(words(text)) - 1


def test_a_phrase_in_part_is_no_place(spark):
    docs = [(1, "gnu general public"), (2, "cc-by-nc"), (3, "GNU  general\npublic LICENSE")]
    rows = {r["doc_id"]: r for r in L.license_labels(frame(spark, docs)).collect()}
    assert (rows[1]["n_base"], rows[1]["labels"]) == (0, "")
    assert (rows[2]["base_labels"], rows[2]["labels"]) == ("cc-by", "cc-by,cc-by-nc")
    assert (rows[3]["first_word"], rows[3]["labels"]) == (0, "gpl")


def test_only_builtin_functions(spark):
    plan = L.license_labels(frame(spark, [(1, "mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table_long_text_and_large_templates(spark):
    assert L.license_labels(frame(spark, [])).count() == 0
    row = L.license_labels(frame(spark, [(1, "filler words here " * 300_000 + "apache license")])).first()
    assert (row["n_words"], row["first_word"], row["n_base"]) == (900_002, 900_000, 1)
    kept, L.BROADCAST_BYTES = L.BROADCAST_BYTES, 10
    try:
        with pytest.raises(ValueError, match="at most 10"):
            L.license_labels(frame(spark, [(1, "x")]))
    finally:
        L.BROADCAST_BYTES = kept
    own = spark.createDataFrame([Row(template=0, label="own", base=True, text="one", cover=1.0, shift=0)], "template int, label string, base boolean, text string, cover double, shift int")
    assert L.license_labels(frame(spark, [(1, "one two")]), own).first()["labels"] == ""
