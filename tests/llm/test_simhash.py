import itertools
import random

import pytest

from brinelink.llm.common import components, table
from brinelink.llm.simhash import fingerprint, links, masks, near_duplicates


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def brute(rows):
    """(doc_id, fingerprint, component) of rows with ids."""
    fps = [fingerprint(t) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    comp = union(len(rows), near)
    low = {}
    for (i, _), c in zip(rows, comp):
        low[c] = min(low.get(c, i), i)
    return sorted((i, f"{f:016x}", low[c]) for (i, _), f, c in zip(rows, fps, comp))


def test_masks_cover_every_pair_within_the_radius():
    table_masks = masks(2)
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m & (1 << i | 1 << j) for m in table_masks)
    for m in table_masks:
        assert 30 <= m.bit_count() <= 40


def test_fingerprint_by_hand():
    assert fingerprint(None) == fingerprint("") == fingerprint(" \t\n") == 0
    assert fingerprint("A b") == fingerprint("a  B")
    assert fingerprint("É x y") != fingerprint("é x y")  # only A-Z are folded


@pytest.mark.parametrize("pairwise", [0, 2, 1000])
def test_links_give_the_same_components_as_all_pairs(spark, pairwise):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = set(base) | {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(25)}
    fps |= {base[0] ^ (1 << i) for i in range(64)} | {0}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    near = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2]
    want = {f: fps[c] for f, c in zip(fps, union(len(fps), near))}
    edges = links(spark.createDataFrame([(f,) for f in fps], "fp long"), pairwise=pairwise)
    got = {f: f for f in fps} | {r.node: r.component for r in components(edges).collect()}
    assert got == want


def test_odd_rows(docs_of):
    rows = [(3, None), (1, ""), (2, " "), (9, "one two"), (8, "ONE  two"), (7, "one two three four five"), (7, "one two three four five"), (5, "x " * 30_000)]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs_of(rows)).collect())
    assert got == brute(rows)
    assert near_duplicates(docs_of(rows).where("false")).count() == 0
    lost = near_duplicates(docs_of([(None, "a b c"), (4, "a b c"), (None, "z")])).collect()
    assert sorted(map(str, [(r.doc_id, r.component_id) for r in lost])) == ["(4, 4)", "(None, 4)", "(None, None)"]


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()) == brute(rows)


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
