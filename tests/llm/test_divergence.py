import re
from collections import Counter, defaultdict

from tripletide.llm import divergence as D


def brute(docs):
    docs = [tuple(v or "" for v in d) for d in docs]
    groups, counts, spread = sorted({d[1:] for d in docs}), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        low = text.translate({c: c + 32 for c in range(65, 91)})
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(terms)
        spread[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in spread[lang].items() if n >= D.MIN_DOCS)
        others = [s for g, s in groups if g == lang]

        def p(count, term):
            return 1 + 10**9 * (count[term] + 2) // (sum(count[t] for t in kept) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        mine, whole = counts[lang, source], sum((counts[lang, s] for s in others), Counter())
        parts = {
            "pair": [(s, sum(f(p(mine, t), p(counts[lang, s], t)) for t in kept)) for s in others if s != source],
            "term": [(t, f(p(mine, t), p(whole, t))) for t in kept if mine[t] and p(mine, t) > p(whole, t)],
        }
        for part, rows in parts.items():
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            for i, (item, value) in enumerate(rows[:10] if part == "term" else rows):
                out.append((lang, source, part, item, value, i + 1))
    return sorted(out)


def corpus():
    words = ["Alpha", "beta", "GAMMA", "\u00e9t\u00e9", "\u0130x", "snow_flake", "x1y", "z"]
    docs = []
    for i in range(120):
        text = " ".join(words[(i * k * k + k) % len(words)] for k in range(i % 17)) + "\x00omega-" * (i % 3)
        docs.append((text if i % 11 else None, ["en", "de", None][i % 3], [f"s{i % 7}", None][i % 13 == 0]))
    return docs + [docs[5]] * 9 + [("", "fr", "a"), ("rare", "fr", "b"), (None, None, None)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string, source string").selectExpr(
        "*", "1 AS term", "2 AS n", "3 AS at", "4 AS head"
    )


def test_equals_brute_force(spark):
    docs = corpus()
    assert sorted(map(tuple, D.divergence(frame(spark, docs)).collect())) == brute(docs)


def test_spilled_blocks_and_split_pairs_change_nothing(spark):
    docs = corpus()
    batches = frame(spark, docs).select("text", "lang", "source").fillna("").toArrow().to_batches()
    whole = Counter()
    for entries in (3, 10**6):
        D.BLOCK_ENTRIES, kept = entries, D.BLOCK_ENTRIES
        try:
            runs = [r for b in D._runs(iter(batches)) for r in b.to_pylist()]
        finally:
            D.BLOCK_ENTRIES = kept
        sums = Counter()
        for r in runs:
            sums[r["lang"], r["term"], r["source"]] += r["n"]
        whole = whole or sums
        assert sums == whole
    assert len(runs) < 400


def test_terms_of_many_sources(spark):
    docs = [(f"common word{i % 3}", "en", f"s{i}") for i in range(60)] * 2
    kept, D.PAIRS = D.PAIRS, 16
    try:
        import pyarrow as pa

        lists = [[{"at": i, "p": 100 + i, "z": 7} for i in range(30)]]
        batch = pa.RecordBatch.from_pydict({"lang": ["en"], "held": lists})
        got = Counter()
        for b in D._corrections(iter([batch])):
            for r in b.to_pylist():
                got[r["a"], r["b"]] += r["value"]
    finally:
        D.PAIRS = kept
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for (a, b), v in got.items():
        assert v == f(100 + a, 100 + b) - f(100 + a, 7) - f(7, 100 + b) + f(7, 7)
    assert len(got) == 30 * 29 // 2
    assert sorted(map(tuple, D.divergence(frame(spark, docs)).collect())) == brute(docs)


def test_empty_table_and_long_text(spark):
    assert D.divergence(frame(spark, [])).count() == 0
    docs = [("word " * 200_000 + "q" * 300_000, "en", "a"), ("word", "en", "b")] * 10
    assert sorted(map(tuple, D.divergence(frame(spark, docs)).collect())) == brute(docs)
