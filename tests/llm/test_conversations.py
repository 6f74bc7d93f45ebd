"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest
from helpers import SF01, read

from scorecard.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    """Conversations by id, as the contract rebuilds them."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    # turns that tie are in the order of their digest
    own = {c: [x for _, x in sorted(t, key=lambda y: (y[0], digest(*y[1])))] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()


def expected(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, own + sum(below[k][1] for k in kids[p]))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def got(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.RESULT).collect()))


def key(rows):
    return sorted(rows, key=str)


def test_op12_whole_table(spark):
    rows = read(SF01, "conversations")
    assert key(got_any(queries.op12_prefix_trie(spark, SF01))) == key(expected(rebuilt(rows)))


def got_any(df):
    return [tuple(r) for r in df.select(*prefix_trie.RESULT).collect()]


def conversations(rng, n, hot):
    """Conversations over few turns, a share ``hot`` of them the same."""
    said = [("user", "hi"), ("assistant", "yes"), ("user", ""), (None, None), ("assistant", "é日本🙂"), ("user", "x" * 500)]
    same = [(i, *rng.choice(said)) for i in range(6)]
    rows = []
    for c in rng.sample(range(-20, 40 * n), n):
        turns = same if rng.random() < hot else [
            (rng.choice([None, i, i]), *rng.choice(said)) for i in range(rng.choice([1, 2, 3, 12, 40]))]
        rows += [(c, *t) for t in turns]
    return rows + [(None, 1, "user", "no conversation")] + rows[:3]


@pytest.mark.parametrize("turns,parts", [(1, 3), (40, 8), (10**9, 1), (300, 5)])
def test_many_tries_are_one(spark, turns, parts):
    rng = random.Random(turns + parts)
    rows = conversations(rng, 150, 0.4)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS depth", "'n' AS node", "'k' AS kind", "'p' AS path", "'s' AS sizes", "'b' AS `by`").repartition(4)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = got_any(prefix_trie.nodes(prefix_trie.rebuilt_paths(df), turns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert key(out) == key(expected(rebuilt(rows)))


def test_as_they_are(spark):
    rows = [(c, t, r, x) for c, t, r, x in conversations(random.Random(1), 60, 0.2) if c is not None]
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append(((t is not None, t or 0), (r or "", x or "")))
    convs = {c: tuple(x for _, x in sorted(t, key=lambda y: (y[0], digest(*y[1])))) for c, t in convs.items()}
    out = got_any(prefix_trie.nodes(prefix_trie.paths(spark.createDataFrame(rows, SCHEMA))))
    assert key(out) == key(expected(convs))


def test_no_conversations(spark):
    assert got(prefix_trie.nodes(prefix_trie.rebuilt_paths(spark.createDataFrame([], SCHEMA)))) == []
    lone = spark.createDataFrame([(1, 1, "user", "a")], SCHEMA)  # crc32("1") % 9 turns of it go, and 0 is absent
    assert key(got_any(prefix_trie.nodes(prefix_trie.rebuilt_paths(lone)))) == key(
        expected(rebuilt([(1, 1, "user", "a")])))


def test_long_conversation(spark):
    rows = [(c, i, "user", f"turn {i}" + ("!" if c == 5 and i == 1500 else "")) for c in (0, 5, 10) for i in range(3000)]
    out = got_any(prefix_trie.nodes(prefix_trie.rebuilt_paths(spark.createDataFrame(rows, SCHEMA)), 4000))
    assert key(out) == key(expected(rebuilt(rows)))


def test_fat_binary_search():
    rng = random.Random(5)
    for a in range(40):
        for b in range(a + 1, 41):
            f = prefix_trie.two_fattest(a, b)
            assert a < f <= b and all((x & -x) <= (f & -f) for x in range(a + 1, b + 1))
    letters = [os.urandom(prefix_trie.WIDTH) for _ in range(3)]
    for _ in range(30):
        trie, seen = prefix_trie.ZFastTrie(), []
        for i in range(60):
            path = b"".join(rng.choices(letters, weights=[8, 1, 1], k=rng.randrange(30)))
            trie.insert(path, [1] * 30, i)
            seen.append(path)
        for x in trie.summed():
            assert x is trie.root or trie.table[trie._handle(x)] is x
            assert x.n == sum(p.startswith(x.extent) for p in seen)
        assert len(trie.table) == len(trie.summed()) - 1
