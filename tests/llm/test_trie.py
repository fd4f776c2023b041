import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from brinelink.llm import trie
from brinelink.llm.common import table
from brinelink.llm.trie import conversation_trie, fattest, numbered, prefix_trie, subtree

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, n long, h long, at long, block long, d long, a long, e string, x string"


def table_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "e", "x") for r in rows], SCHEMA).repartition(parts)


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in own.items()}


def rebuild(rows):
    own = ordered(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(paths):
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        own = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += node not in children
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), up, len(m), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


def of_paths(spark, paths, batches):
    turns = [(c, i, r, t) for c, p in paths.items() for i, (r, t) in enumerate(p)]
    turns = spark.createDataFrame(turns, "conv_id long, at long, role string, text string")
    lengths = spark.createDataFrame([(c, len(p)) for c, p in paths.items()], "conv_id long, length long")
    return rows_of(prefix_trie(turns, lengths, batches))


def test_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)] + [(2**40 - 1, 2**40 + 5), (0, 2**45 - 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", fattest(df.a, df.b).alias("f")).collect():
        assert r.a < r.f <= r.b
        low = r.f & -r.f
        assert not any((k * 2 * low) > r.a and (k * 2 * low) <= r.b for k in (r.b // (2 * low),))


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_any_batches_give_the_same_trie(spark, batches):
    rnd = random.Random(4)
    paths = {}
    for c in range(60):  # edits of one another: splits, ends on edges, ends at nodes, copies
        base = list(paths[rnd.randrange(c)]) if c and rnd.random() < 0.8 else []
        base = base[: rnd.randrange(len(base) + 1)] if rnd.random() < 0.7 else base
        paths[c * 3] = paths[c] = base + [(rnd.choice("ua"), rnd.choice(["x", "é", ""])) for _ in range(rnd.randrange(5))]
    assert of_paths(spark, paths, batches) == brute(paths)


def test_long_chains_and_edges(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "IDS", 4)
    long = [("u", f"t{i % 7}") for i in range(150)]
    paths = {i: long[: i * 3] for i in range(40)} | {100: long, 101: long[:70] + [("a", "else")] + long[71:], 102: long[:33], 200: []}
    paths |= {i: long[:64] for i in range(300, 330)}
    assert of_paths(spark, paths, 2) == brute(paths)


def test_turns_are_numbered_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(1, t, "r", str((t or 0) % 3)) for t in (5, 3, None, 17, 4, 4, 400, -9, None)] + [(2, 1, None, None)]
    got = defaultdict(dict)
    for r in numbered(table_of(spark, rows)).collect():
        got[r.conv_id][r["at"]] = (r.role, r.text)
    assert {c: [t[i] for i in sorted(t)] for c, t in got.items()} == ordered(rows)
    assert all(sorted(t) == list(range(len(t))) for t in got.values())


def test_subtree_sums(spark):
    up = {i: i // 2 for i in range(2, 40)} | {40 + i: 39 + i for i in range(30)} | {40: 39}
    nodes = [(k, up.get(k), 1, k) for k in range(1, 70)]
    got = {r.k: (r.n, r.m) for r in subtree(spark.createDataFrame(nodes, "k long, up long, n long, m long"), ["n"], ["m"]).collect()}
    want = {k: 0 for k in range(1, 70)}
    for k in range(1, 70):
        while k is not None:
            want[k] += 1
            k = up.get(k)
    assert got == {k: (n, k) for k, n in want.items()}


def test_odd_rows(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(5, 30) for t in range(c % 4 + 1)]
    rows += [(None, 0, "user", "lost"), (3, None, None, None), (3, 0, None, ""), (4, 0, "a", "b"), (4, 0, "a", "b"), (11, 2, "z", "é" * 90_000)]
    rows += [(1_000_000_007, t, "u", "x") for t in range(300)] + [(41, 0, "u", "only"), (42, 0, "u", "only")]
    assert rows_of(conversation_trie(table_of(spark, rows))) == brute(rebuild(rows))
    assert conversation_trie(table_of(spark, rows).where("false")).count() == 0


def test_whole_table_and_sql(spark, sf):
    conversations = table(spark, sf, "conversations")
    got = rows_of(conversation_trie(conversations))
    assert got == brute(rebuild([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.SQL})").fetchall(), key=lambda r: r[:2]) == got
