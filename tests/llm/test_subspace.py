import numpy as np
import pytest

from brinelink.llm.common import table
from brinelink.llm.subspace import near_duplicates, rotation


def brute(rows):
    """n_links and component by rows, all pairs compared."""
    ok = []
    for v, e, label in rows:
        x = None if e is None or None in e else np.array(e, np.float32).astype(float)
        ok.append(x if label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            low[find(i)] = min(v, low.get(find(i), v))
    return sorted(((v, links[i], low.get(find(i)), v == low.get(find(i))) for i, (v, _, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, uid string, copies string, block string, component string"
    return spark.createDataFrame([(v, None if e is None else [None if x is None else float(x) for x in e], c, "x", "x", "x", "x") for v, e, c in rows], schema)


def cases():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 20))
    rows = [(i, b.tolist(), i % 2) for i, b in enumerate(base)]
    for i in range(70):  # around the limit on both sides, many in one crowded place
        k = 0 if i < 40 else i % 12
        x = base[k] * rng.uniform(0.1, 9) + rng.standard_normal(20) * np.linalg.norm(base[k]) * rng.choice([0.01, 0.03, 0.045, 0.06])
        rows.append((100 + i, x.tolist(), k % 2))
    zero = [0.0] * 20
    rows += [(300, None, 0), (301, [], 0), (302, zero, 0), (303, [None] + zero[1:], 0), (304, [float("nan")] * 20, 0)]
    rows += [(305, [float("inf")] + zero[1:], 0), (306, rows[0][1], None), (307, rows[0][1], None), (308, [1.0, 2.0], 0), (309, [2.0, 4.0], 0)]
    rows += [(310, [1e30] * 20, 0), (311, [1e-30] * 20, 0), (312, [-0.0, 1.0], 1), (313, [0.0, 1.0], 1), (314, [3.0], 1), (315, [5.0], 1), (316, [-5.0], 1)]
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[6][1], 0), (None, [9.0, -9.0], 0)]
    return rows


@pytest.mark.parametrize("chunk,grid", [(1500, 2), (7, 2), (1500, 3)])
def test_equals_all_pairs(spark, chunk, grid):
    rows = cases()
    assert got(near_duplicates(vectors(spark, rows), chunk=chunk, grid_dims=grid)) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(vectors(spark, cases()).where("false")).count() == 0


def test_rotation_keeps_lengths():
    q = rotation(64)
    assert np.allclose(q @ q.T, np.eye(64))


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf, "embeddings").collect()]
    assert got(near_duplicates(table(spark, sf, "embeddings"))) == brute(rows)
