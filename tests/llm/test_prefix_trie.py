"""The conversation trie against a plain one, with long, equal, nested and turnless conversations."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from verdigris.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(data):
    out = {}
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append((turn is not None, turn or 0, sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    return {c: [(role, text) for *_, role, text in sorted(v)] for c, v in out.items()}


def lent(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def plain(convs):
    """Rows of nodes by dictionaries of prefixes."""
    nodes, kids = {}, {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in kids
    end = lambda p, m: sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], end(p, m)) for p, m in nodes.items())


def got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def trie_of(spark, convs):
    rows = [(c, d, bytearray(sha256(repr(t).encode()).digest()), len(t[1].encode())) for c, v in convs.items() for d, t in enumerate(v, 1)]
    return prefix_trie.trie(spark.createDataFrame([(c,) for c in convs], "conv_id long"), spark.createDataFrame(rows, "conv_id long, depth long, token binary, bytes long").repartition(3))


@pytest.mark.parametrize("block,most", [(16, 6), (2, 24)])
def test_random_tries(spark, monkeypatch, block, most):
    """With small blocks, names of names are ranked."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    r = random.Random(block)
    make = lambda: [("u", r.choice(["a", "bé", "ccc"])) for _ in range(r.randint(0, most))]
    pool = [make() for _ in range(15)]
    convs = {c * 3 - 60: r.choice(pool)[: r.randint(0, most)] + (make() if r.random() < 0.3 else []) for c in range(90)}
    out = trie_of(spark, convs).cache()
    assert got(out) == plain(convs)
    # Preorder intervals: each node's subtree is that of its descendants.
    rows = out.collect()
    paths = {(r["conv_id"], r["depth"]): tuple(convs[r["conv_id"]][: r["depth"]]) for r in rows}
    at = {r["preorder"]: paths[r["conv_id"], r["depth"]] for r in rows}
    for r_ in rows:
        own = at[r_["preorder"]]
        assert {at[i] for i in range(r_["preorder"], r_["subtree_end"] + 1)} == {p for p in at.values() if p[: len(own)] == own}


def test_copies_and_one_first_turn(spark):
    first = ("user", "Hello")
    convs = {c: [first, ("assistant", "Hi")] for c in range(400)} | {1000 + c: [first, ("assistant", str(c))] for c in range(200)} | {5000: [first]}
    assert got(trie_of(spark, convs)) == plain(convs)


def test_a_long_conversation(spark):
    convs = {1: [("u", str(i % 7)) for i in range(1500)], 2: [("u", str(i % 7)) for i in range(900)], 3: []}
    assert got(trie_of(spark, convs)) == plain(convs)


def test_rebuilt_odd_rows(spark):
    r = random.Random(5)
    data = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["x", "yé", None, ""])) for c in [*range(-12, 25), 10**12 + 1, 10**12] for t in range(r.randint(1, 12))]
    data += [(7, 1, "user", "twice"), (7, 1, "user", "twice"), (7, 1, None, "tie"), (None, 0, "user", "no conversation"), (30, 0, "a", "bc"), (31, 0, "ab", "c"), (40, 0, "u", "long " * 50_000)]
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "token", "rank", "first", "one_", "place", "dotted.name")})
    convs, rows = prefix_trie.rebuilt(prefix_trie.turns_of(df))
    assert got(prefix_trie.trie(convs, rows)) == plain(lent(ordered(data)))
    assert got(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df.limit(0))))) == []
    assert got(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df.where("conv_id is null"))))) == []


def test_only_turnless(spark):
    [row] = got(prefix_trie.trie(spark.createDataFrame([(4,), (2,)], "conv_id long"), spark.createDataFrame([], "conv_id long, depth long, token binary, bytes long")))
    assert row == (2, 0, None, 2, 0, 1, 0, sha256(b"2,4").hexdigest())


def test_prefix_sums_over_empty_parts(spark):
    parts = prefix_trie.sorted_parts(spark.createDataFrame([(i, 2 * i) for i in (5, 1, 3)], "k long, x long"), "k")
    assert [tuple(r) for r in prefix_trie.prefix_sums(parts, total="x").orderBy("k").collect()] == [(1, 2, 2), (3, 6, 8), (5, 10, 18)]
    assert prefix_trie.prefix_sums(prefix_trie.sorted_parts(parts.limit(0), "k"), total="x").count() == 0
