"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from callscope.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, depth int, pos long"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(c % 100), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            sum(len(p) == len(path) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, sorted(c for c in convs if whole[c] == path))).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1, 9) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.prefix_trie(turns).collect()), key=str)


@pytest.mark.parametrize("segment,convs", [(64, 1024), (3, 4)])
def test_random_conversations(spark, monkeypatch, segment, convs):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "SHARD_CONVS", convs)
    rand = random.Random(segment)
    rows = []
    for c in rand.sample(range(420), 60) + [0, 100, 200]:
        for turn in range(rand.randrange(1, 12)):
            rows.append((c, turn, rand.choice(["user", "bot", None]), rand.choice(["hi", "hé", "", None, "same words"])))
    rows += [(7, None, "user", "null turn"), (None, 1, "user", "no conversation"), (8, 1, "a", "tie"), (8, 1, "b", "tie"), (8, 1, "b", "tie")]
    rows += [(300, t, "user", "long " * 2000 if t == 3 else "x") for t in range(20)] + [(301, t, "user", "x") for t in range(9)]
    rows = [r for i, r in enumerate(rows) if r[0] not in (300, 301) or r[3] in ("x", "long " * 2000)]
    assert run(spark, rows) == plain(rows)


def test_one_common_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_CONVS", 8)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 6000, 100) for t in range(4)]
    got = run(spark, rows)
    assert got == plain(rows) and len(got) == 5


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
