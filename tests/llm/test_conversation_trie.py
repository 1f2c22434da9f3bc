from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from bulwark.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, depth int, digest string, pos int, kind string"
EMPTY = hashlib.sha256().hexdigest()


def order(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()

    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found[c].append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    return {c: tuple(t for _, t in sorted(ts)) for c, ts in found.items()}


def brute(rows, rebuild=True):
    found = order(rows)
    if rebuild:
        whole = {}
        for c, ts in found.items():
            h = zlib.crc32(str(c).encode()) % 9
            base = c - int(abs(c) % 5 * (1 if c > 0 else -1))
            whole[c] = found.get(base, ())[:h] + ts[h:]
        found = whole
    members = defaultdict(list)
    for c, ts in found.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def walk(node):
        """Leaves and savings of a subtree, deepest first."""
        leaves, saved = (0, 0) if children[node] else (1, 0)
        for child in children[node]:
            a, b = sums[child]
            leaves, saved = leaves + a, saved + b
        return leaves, saved + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)

    sums = {}
    for node in sorted(members, key=len, reverse=True):
        sums[node] = walk(node)
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(found[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 9, "y") for r in rows], SCHEMA).repartition(3)


def check(spark, rows, **options):
    df = table(spark, rows)
    assert sorted(map(tuple, ct.rebuilt_trie(df, **options).select(COLUMNS).collect()), key=str) == brute(rows)
    assert sorted(map(tuple, ct.conversation_trie(df, **options).select(COLUMNS).collect()), key=str) == brute(rows, rebuild=False)


def some(rng, convs, most, words):
    rows = []
    for c in convs:
        for turn in range(rng.randint(1, most)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows


def test_random(spark):
    rng = random.Random(1)
    rows = some(rng, range(60), 9, ["a", "b", None, "é😀"]) + some(rng, range(100, 130), 3, ["a"])
    rng.shuffle(rows)
    check(spark, rows)


def test_blocks_of_ancestors(spark):
    """Several levels of blocks: copies of deep conversations that part at random depths."""
    rng = random.Random(2)
    trunk = [("user", rng.choice("abc")) for _ in range(45)]
    rows = []
    for c in range(25):
        stem = rng.randint(0, 45)
        ts = trunk[:stem] + [("user", rng.choice("xy"))] * rng.randint(0, 6)
        rows += [(c, k, *t) for k, t in enumerate(ts)] or [(c, 0, "user", "z")]
    check(spark, rows, fan=3, piece=2)


def test_edges(spark):
    rows = [
        (None, 1, "user", "lost"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, None, None), (0, 2, "user", "long " * 50_000), (5, 1, "user", "a"), (5, 1, "user", "b"), (5, 1, "assistant", "a"),
        (-3, 1, "user", "x"), (-5, 1, "user", "y"), (7, 1, "", ""), (7, 2, "1:u", "ser"), (8, 1, "1", ":user"), (10**15 + 1, 3, "user", "far"), (6, None, None, "q"),
    ]
    check(spark, rows)


def test_turnless_and_single(spark):
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    check(spark, [(lone, 1, "user", "gone")])
    check(spark, [(3, 1, "user", "a"), (3, 2, "user", "b")])


def test_many_ends(spark):
    rows = [(c * 5, 1, "user", "the same") for c in range(700)] + [(c * 5, 1, "user", "other") for c in range(700, 720)]
    check(spark, rows, piece=16)


def test_empty(spark):
    assert ct.rebuilt_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_same_as_sql(spark):
    rng = random.Random(4)
    rows = some(rng, range(-20, 60), 10, ["a", "b", "c"])
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    relation = con.sql(ct.SQL)
    at = [relation.columns.index(c) for c in COLUMNS]
    assert sorted((tuple(r[k] for k in at) for r in relation.fetchall()), key=str) == brute(rows)
