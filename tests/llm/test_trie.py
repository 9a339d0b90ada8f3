"""Prefix tries against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql.types import StructType

from scorelake.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos string, depth double, key1 string, shard string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], StructType.fromDDL(SCHEMA))


def originals(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs, every=5, heads=9):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def direct(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, out = {}, []
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def awkward():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "system", None]), rng.choice(["a", "b", "é日", "", None])) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(100 + c, 0, "system", "same") for c in range(60)] + [(100 + c, 1, "user", "same too") for c in range(60)]
    rows += [(200, None, "user", "x"), (200, None, "user", "x"), (200, 3, "user", "y"), (200, 3, "assistant", "y"), (200, 3, "user", "y")]
    rows += [(None, 0, "user", "lost"), (None, None, None, None), (-7, 0, "user", "a"), (-5, 0, "user", "b"), (2**62, 5, None, None)]
    rows += [(300, t, "user", "long" if t % 3 else "x" * 2000) for t in range(400)]
    return rows + [(301, t, "user", "long" if t % 3 else "x" * 2000) for t in range(390)]


@pytest.mark.parametrize("shard, band", [(512, 64), (16, 5), (8, 1)])
def test_awkward_rows(spark, monkeypatch, shard, band):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "BAND", band)
    monkeypatch.setattr(trie, "WEIGHED", 50)
    rows = awkward()
    turns = trie.turn_table(frame(spark, rows).repartition(3))
    assert found(trie.prefix_trie(turns, turns)) == direct(originals(rows))
    shared = trie.with_shared_heads(turns, every=5, heads=9)
    assert found(trie.prefix_trie(shared, turns)) == direct(rebuilt(originals(rows)))


def test_conversations_without_turns_end_at_the_root(spark):
    turns = trie.turn_table(frame(spark, [(1, 0, "user", "a"), (2, 0, "user", "a")]))
    ids = spark.createDataFrame([(1,), (2,), (3,), (9,), (None,), (3,)], "conv_id bigint")
    assert found(trie.prefix_trie(turns, ids)) == direct({1: [("user", "a")], 2: [("user", "a")], 3: [], 9: []})


def test_no_rows(spark):
    for rows in ([], [(None, 1, "user", "a")]):
        turns = trie.turn_table(frame(spark, rows))
        assert trie.prefix_trie(trie.with_shared_heads(turns, every=5, heads=9), turns).collect() == []


def test_one_conversation_copied_a_thousand_times(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1000) for t in range(6)] + [(2000 + c, 0, "user", str(c)) for c in range(500)]
    turns = trie.turn_table(frame(spark, rows))
    assert found(trie.prefix_trie(turns, turns)) == direct(originals(rows))


def test_packed_members():
    for members in ([0], [511], [3, 4, 200], list(range(0, 512, 2)), list(range(512))):
        bits = sum(1 << i for i in members)
        packed = trie._packed(bits)
        assert trie._places(packed).tolist() == members == trie._members(bits) and len(packed) <= 64
