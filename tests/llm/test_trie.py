"""The conversation trie against plain dictionaries of prefixes, and the radix tree's layouts."""

import hashlib
import random
import re
import zlib

import pytest

from tidewatch.llm import trie
from tidewatch.llm.trie import RESULT, Node, conversation_trie, insert

TURNS = "conv_id long, turn int, role string, text string, name string, n long, path string"


def brute(rows):
    turns = {}
    for r in rows:
        if r[0] is not None:
            turns.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members, ends = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
        ends.setdefault(v, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in below)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    return sorted(tuple(r[c] for c in RESULT) for r in df.collect())


def conversations(rng, n):
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            hot = rng.random() < 0.6
            rows.append((c, t, "user" if t % 2 == 0 else "bot", "the same first words" if t == 0 and hot else rng.choice(["yes", "no  way", "", None, "a b c d"]), "x", 1, None))
    return rows


@pytest.mark.parametrize("block", [3, 20_000])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rng = random.Random(5)
    rows = conversations(rng, 400)
    rows += [(1000 + i, t, "user", f"copied turn {t}", "x", 1, None) for i in range(90) for t in range(4)]
    rows += [(2000, t, "user", f"long {t % 7}", "x", 1, None) for t in range(700)] + [(2001, t, "user", f"long {t % 7}", "x", 1, None) for t in range(650)]
    rows += [(None, 1, "user", "nobody", "x", 1, None), (40, None, None, None, "x", 1, None), (60, 1, "a", "bc", "x", 1, None), (61, 1, "ab", "c", "x", 1, None), (-3, 0, "user", "minus", "x", 1, None)]
    rows += rows[:25]
    assert got(conversation_trie(spark.createDataFrame(rows, TURNS).repartition(5))) == brute(rows)


def test_trie_of_a_table(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert got(conversation_trie(table)) == brute(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_layouts_grow_and_paths_split():
    root = Node(b"")
    rng = random.Random(1)
    paths = sorted({bytes([a, b]) + bytes(rng.choices(range(256), k=14)) + bytes([c]) * 16 for a in (1, 2) for b in range(0, 256, 1 if a == 1 else 9) for c in range(3)})
    for p in paths:
        insert(root, p, p)
    one, two = root.find(1), root.find(2)
    assert one.keys is None and len(two.keys) == 256 and len(two.children) == 29
    seen = []

    def walk(node, path):
        path += node.prefix
        if node.value is not None:
            seen.append(path)
            assert node.value == path
        for c in node.ordered():
            walk(c, path)

    walk(root, b"")
    assert seen == paths
