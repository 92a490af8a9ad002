"""The conversation trie against brute force and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from lumenframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, p int, node string"


def ordered(rows):
    out = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            out[c].append(((t is not None, t or 0, role or "", text or ""), (role or "", text or "")))
    return {c: [x for _, x in sorted(v)] for c, v in out.items()}


def regrafted(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]  # as SQL has it for numbers below 0
    return out


def trie_by_brute_force(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", x[-1][1])) for x in below if x)
        here = ",".join(str(c) for c in m if len(convs[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), sum(len(x) == len(k) + 1 for x in below), leaves, saved, hashlib.sha256(here.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(rng):
    """Prefixes that many share, repeated turns and rows, nulls, an absent first conversation and one of 70 turns."""
    rows, first = [], [(None, "hello there  you"), ("user", None), ("user", "a\tb"), ("bot", "")]
    for c in range(20, 90):
        for t in range(rng.choice([0, 1, 2, 3, 5, 6, 9])):
            role, text = first[t] if t < len(first) and rng.random() < 0.8 else (rng.choice(["user", "bot"]), rng.choice(["x", "y z", None]))
            rows.append((c, t if rng.random() < 0.9 else None, role, text, 1, "k"))
    rows += [(100, t, "user", f"t{t % 3}", 1, "k") for t in range(70)] + [(101, t, "user", f"t{t % 3}", 1, "k") for t in range(65)]
    rows += [(5, 0, "user", "alone", 1, None), (None, 0, "user", "nobody's", 1, None), (-20, 1, "user", "x", 1, None), (-3, 1, "user", "x", 1, None), (-3, 1, "user", "x", 1, None), (4100, 1, "user", "x", 1, None)]
    return rows


@pytest.mark.parametrize("seed", [1])
def test_tries_by_brute_force(spark, seed):
    rows = conversations(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    convs = ordered(rows)
    assert found(prefix_trie.prefix_trie(df)) == trie_by_brute_force(convs)
    assert found(prefix_trie.trie(*prefix_trie.regrafted(prefix_trie.numbered(df)))) == trie_by_brute_force(regrafted(convs))


def test_a_conversation_that_many_ranges_hold(spark):
    rows = [(7, t, "user", f"w {t}", 1, "k") for t in range(3000)] + [(c, 0, "user", "w 0", 1, "k") for c in (3, 9)]
    got = prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.p for r in got.where("conv = 7").collect()) == list(range(3000))
    top = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).where("depth < 2").orderBy("depth").collect()
    assert [(r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in top] == [(3, 3, 1, 1, 4), (3, 3, 1, 1, 4)]


def test_members_are_hashed_in_order_across_strings(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 3)
    ids = [-7, -1, 0, 2, 3, 10, 11, 100]
    got = prefix_trie.ends(spark.createDataFrame([(1, 1, c) for c in ids] + [(2, 1, 5)], "node long, depth long, conv long")).collect()
    want = {1: ",".join(map(str, ids)), 2: "5"}
    assert {r.node: r.ends_sha256 for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x", 1, "k")]])
def test_without_conversations_there_are_no_nodes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert prefix_trie.prefix_trie(df).count() == 0
    assert prefix_trie.trie(*prefix_trie.regrafted(prefix_trie.numbered(df))).count() == 0
