"""The prefix trie of conversations against a dictionary of all beginnings, with trees of any size."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from swaplens.llm import conversation_trie as C
from swaplens.llm.radix_tree import LAYOUTS, Tree

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, tree long"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    said = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes = defaultdict(list)
    length = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        block = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = (*said.get(block, [])[:h], *said[c][h:])
        length[c] = len(whole)
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
    children = defaultdict(set)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]].add(p)
    for p, convs in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in cs if length[c] == len(p)))).encode()).hexdigest())
        for p, cs in nodes.items()
    )


def talk(seed, n):
    """Many beginnings and whole conversations that are alike, turns out of order, ties, repeats, nulls."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        c = r.choice([k, k, -k, 300 + k])
        for t in range(r.choice([0, 1, 2, 3, 5, 9])):
            text = "the same" if t < 2 and r.random() < 0.7 else r.choice(["yes", "no", "é漢😀", "", None, "long " * 50])
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "user", None, ""]), text, "k", 3, 5))
    rows += rows[:5] + [(None, 1, "user", "nobody", "k", 1, 1)]
    rows += [(1000 + k, t, "user", f"copy {t}", "k", 1, 1) for k in range(60) for t in range(3)]  # one large group
    rows += [(2000, t, "user", f"turn {t}", "k", 1, 1) for t in range(300)] + [(2001, t, "user", f"turn {t}", "k", 1, 1) for t in range(290)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, rows, size", [(1, 7, 10**6), (2, 1, 10**6), (3, 50_000, 400), (4, 50_000, 8_000_000)])
def test_nodes_equal_brute_force(spark, seed, rows, size):
    data = talk(seed, 120)
    turns = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = sorted(map(tuple, C.trie(C.rebuilt(C.conversations(turns)), rows, size).select(*C.NODE).collect()))
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(brute(data), key=key)


def test_no_conversations_give_no_nodes(spark):
    for data in ([], [(None, 1, "user", "x", "k", 1, 1)]):
        assert C.trie(C.rebuilt(C.conversations(spark.createDataFrame(data, SCHEMA)))).count() == 0


def test_only_turnless_conversations_give_the_root(spark):
    data = [(1, 0, "user", "x", "k", 1, 1)]  # its first turns come from conversation 0, which is absent
    assert zlib.crc32(b"1") % 6 > 0
    (row,) = C.trie(C.rebuilt(C.conversations(spark.createDataFrame(data, SCHEMA)))).collect()
    assert tuple(row)[:7] == (1, 0, None, 1, 0, 1, 0)


def test_radix_tree_keeps_keys_in_every_layout():
    r = random.Random(9)
    for n in (3, 12, 40, 200, 256):
        tree, keys = Tree(), {bytes([b]) + b"tail" for b in r.sample(range(256), n)} | {b"", b"\x00ta", b"\x00tail and more", b"\x00tale"}
        for k, key in enumerate(sorted(keys, key=lambda _: r.random())):
            assert tree.insert(key, k) == k
            assert tree.insert(key, -1) == k
        found, stack = [], [(tree.root, b"")]
        while stack:
            node, at = stack.pop()
            at += node.path
            if node.value is not None:
                found.append(at)
            assert node.layout in LAYOUTS and node.size <= node.layout and node.size == sum(1 for _ in node.items())
            stack += [(child, at) for _, child in reversed(list(node.items()))]
        assert found == sorted(keys)
