"""The prefix trie against sets of prefixes in Python."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from quarry.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int, key int"


def _digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return sha256(b"%d:" % len(role) + role + text).digest()[:16]


def _ordered(rows):
    """conv_id -> its turns (role, text) in order."""
    found = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, _digest(role, text), role or "", text or ""))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in found.items()}


def _remainder(c, n):
    """As SQL has it: the sign is that of c."""
    return abs(c) % n * (1 if c >= 0 else -1)


def _grafted(own, every=5, most=9):
    out = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % most
        out[c] = own.get(c - _remainder(c, every), [])[:h] + ts[h:]
    return out


def _nodes(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(m) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    assert df.columns == [c.split()[0] for c in trie.NODE.split(", ")]
    return sorted(map(tuple, df.collect()), key=str)


def _random(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 100), n):
        start = rng.choice(["a", "b"])
        for t in range(rng.randrange(0, 12)):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "user", None]), rng.choice([start, start, start, "é" * rng.randrange(3), None, ""]), "x", 1, 2))
    return rows + rows[:5] + [(None, 1, "user", "lost", "x", 1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_grafted_against_brute_force(spark, seed):
    rows = _random(seed)
    numbered = trie.number_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert _got(trie.build(*trie.graft(numbered))) == _nodes(_grafted(_ordered(rows)))


def test_as_they_are_and_long_shared_paths(spark):
    rows = [(c, t, "user", f"{t} {'é' * 3}", None, None, None) for c in (1, 2, 3) for t in range(14)] + [(4, 0, "user", "alone", None, None, None), (2, 20, "user", "more", None, None, None)]
    got = _got(trie.build(*trie.whole_conversations(trie.number_turns(spark.createDataFrame(rows, SCHEMA)))))
    assert got == _nodes(_ordered(rows))


def test_role_and_text_are_not_run_together(spark):
    rows = [(1, 0, "ab", "c", None, None, None), (2, 0, "a", "bc", None, None, None), (3, 0, None, "abc", None, None, None)]
    got = _got(trie.build(*trie.whole_conversations(trie.number_turns(spark.createDataFrame(rows, SCHEMA)))))
    assert [r[1] for r in got].count(1) == 3


def test_a_conversation_over_many_ranges(spark):
    """Two thirds of all rows are of one conversation: its places go on from range to range."""
    rows = [(7, t, "user", f"turn {t}", None, None, None) for t in range(400)] + [(c, t, "user", f"{c}", None, None, None) for c in (5, 6, 8) for t in range(60)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = trie.number_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert [r.place for r in numbered.where("conv_id = 7").orderBy("place").collect()] == list(range(400))
    by_place = {r.place: r.key for r in numbered.where("conv_id = 7").collect()}
    assert all(bytes(by_place[t]) == _digest("user", f"turn {t}") for t in range(400))
    assert _got(trie.build(*trie.graft(numbered))) == _nodes(_grafted(_ordered(rows)))


def test_empty_and_a_conversation_without_turns(spark):
    assert _got(trie.build(*trie.graft(trie.number_turns(spark.createDataFrame([], SCHEMA))))) == []
    lost = next(c for c in range(1, 100) if c % 5 and crc32(str(c).encode()) % 9 > 2)  # its base is absent, it has one turn
    rows = [(lost, None, None, None, None, None, None)]
    assert _got(trie.build(*trie.graft(trie.number_turns(spark.createDataFrame(rows, SCHEMA))))) == [(lost, 0, None, 1, 0, 1, 0, sha256(str(lost).encode()).hexdigest())]


def test_many_ends_at_one_node(spark):
    """They are sorted by ranges: several pieces make one digest."""
    rows = [(c, 0, "user", "same", None, None, None) for c in range(-3000, 3000)]
    got = _got(trie.build(*trie.whole_conversations(trie.number_turns(spark.createDataFrame(rows, SCHEMA)))))
    assert got == _nodes(_ordered(rows))


def test_hot_keys_are_joined_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(trie, "FEW", 1)
    rows = _random(3)
    numbered = trie.number_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert _got(trie.build(*trie.graft(numbered))) == _nodes(_grafted(_ordered(rows)))
