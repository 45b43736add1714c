import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tripletide.llm import prefixes as P


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in convs.items()}


def regrouped(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        out[c] = base[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = own + sum(saved[k] for k in children[node])
    out = []
    for node, held in members.items():
        ends = sorted(c for c in held if len(convs[c]) == len(node))
        out.append((
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]), leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[1], r[0]))


def corpus():
    rng, rows = random.Random(3), []
    for c in [*range(-25, 120), 10**15, 10**15 + 1]:
        base = rng.choice([0, 1, 2])
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            text = f"turn {t} of {base}" if rng.random() < 0.8 else rng.choice(["", None, "x y  z", "\u00e9\u00a0w"])
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), text))
    for c in range(200, 260):  # exact copies
        rows += [(c, t, "user", f"same {t}") for t in range(6)]
    return rows + [(None, 1, "user", "nobody"), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS x", "2 AS depth", "3 AS at", "4 AS words")


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0]))


def test_equals_brute_force(spark):
    rows = corpus()
    assert nodes(P.prefix_trie(frame(spark, rows))) == brute(ordered(rows))


def test_regrouped_equals_brute_force(spark):
    rows = corpus()
    assert nodes(P.regrouped_trie(frame(spark, rows))) == brute(regrouped(ordered(rows)))


@pytest.mark.parametrize(("chunk", "cells", "hot"), [(2, 1, 10_000), (4096, 1 << 27, 10**9)])
def test_chunks_small_sketches_and_hot_parents_change_nothing(spark, chunk, cells, hot):
    rows, kept = corpus(), (P.CHUNK, P.CELLS, P.BLOCK, P.HOT_PARENTS)
    P.CHUNK, P.CELLS, P.BLOCK, P.HOT_PARENTS = chunk, cells, 16 if cells == 1 else kept[2], hot
    try:
        assert nodes(P.prefix_trie(frame(spark, rows))) == brute(ordered(rows))
    finally:
        P.CHUNK, P.CELLS, P.BLOCK, P.HOT_PARENTS = kept


def test_what_is_alone_is_proven_alone(spark):
    rows = corpus()
    turns = P.ordered_turns(frame(spark, rows))
    prefixes = P._prefixes(turns, turns.select("conv_id").distinct()).cache()
    count = {r["x"]: r["n"] for r in prefixes.groupBy("x").count().withColumnRenamed("count", "n").collect()}
    screened = P._screened(prefixes, prefixes.count()).collect()
    alone = [r for r in screened if r["alone"]]
    assert all(count[r["x"]] == 1 for r in alone)
    assert len(alone) > 0.9 * sum(n == 1 for n in count.values())


def test_empty_table_and_long_conversation(spark):
    assert P.prefix_trie(frame(spark, [])).count() == 0
    rows = [(c, t, "user", "w " * (t % 3)) for c in (1, 2) for t in range(5000)] + [(2, 5000, "user", "more " * 100_000)]
    got = nodes(P.prefix_trie(frame(spark, rows)))
    assert [r[:7] for r in got[:2]] == [(1, 0, None, 2, 1, 1, 4999), (1, 1, 1, 2, 1, 1, 4999)]
    assert got[-1][:7] == (2, 5001, 1, 1, 0, 1, 0) and got[-2][:7] == (1, 5000, 1, 2, 1, 1, 1)
