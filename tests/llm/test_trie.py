"""The prefix trie against brute force and SQL, over one piece and over many."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import compare, connect

from siftgate.llm import prefix_trie
from siftgate.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, c int, d int, piece string, p1 string, depth string, words string, ends string"


def brute_force(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in paths.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    out = set()
    for node, cs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(x[: len(m)] == m and len(x) > len(m) for x in below)]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(cs), len(node), parent, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for c in range(0, 130):
        if c % 40 == 20:
            continue  # an absent donor
        for t in range(rng.integers(1, 7)):
            out.append((c, int(t), ["user", "assistant", None][t % 3], ["a b", "a b  c", "", None, "x"][rng.integers(5)]))
    out += [(500 + i, 0, "user", "same") for i in range(30)] + [(500 + i, 1, "bot", "same end") for i in range(30)]
    out += [(700, t, "user", f"long {t}") for t in range(60)]  # one long conversation
    out += [(701, t, "user", f"long {t}") for t in range(60)]
    out += [(900, None, "user", "first"), (900, 0, "b", "tie"), (900, 0, "a", "tie"), (900, 0, "a", "tie"), (None, 1, "a", "b"), (901, 5, None, None)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], SCHEMA)


def trie(spark, rows):
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns(frame(spark, rows))))


@pytest.mark.parametrize("piece", [200_000, 25])
def test_trie_is_brute_force(spark, rows, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE_ROWS", piece)
    monkeypatch.setattr(prefix_trie, "MANY_CHILDREN", 3)
    got = [tuple(r) for r in trie(spark, rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force(rows)


def test_trie_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES["op13_prefix_trie"](spark, sf), connect(sf), ORACLES["op13_prefix_trie"]) is None


def test_trie_of_nothing(spark):
    assert trie(spark, []).collect() == [] and trie(spark, [(None, 1, "a", "b")]).collect() == []


def test_trie_of_turnless_members_only(spark):
    turnless = [(c, 0, "u", "x") for c in (5, 7, 25, 26) if zlib.crc32(str(c).encode()) % 4 >= 1]
    assert turnless and {tuple(r) for r in trie(spark, turnless).collect()} == brute_force(turnless)


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    a[:2500] = a[2500:]  # half of the keys differ in one word only
    table = prefix_trie.PerfectHash(a, b)
    slots = table.slots(a, b)
    assert sorted(slots) == list(range(5000)) and (table.keys[slots, 0] == a).all()
    assert (table.slots(b, a) == -1).all() and len(prefix_trie.PerfectHash(a[:0], b[:0]).slots(a[:3], b[:3])) == 3
