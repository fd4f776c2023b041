import collections
import hashlib
import random

import numpy as np
import pytest

from brinelink.llm.common import table
from brinelink.llm.suffixes import remove_repeats, repeated_starts, suffix_order


def brute(rows, length=200):
    """Every string counted, every covered byte marked."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[x : x + length] for _, b in raw for x in range(len(b) - length + 1))
    out = collections.Counter()
    for i, b in raw:
        cover = np.zeros(len(b) + 1, np.int64)
        for x in range(len(b) - length + 1):
            if seen[b[x : x + length]] > 1:
                cover[x : x + length] = 1
        spans = int((np.diff(np.concatenate([[0], cover])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[cover[:-1] == 0].tobytes()
        out[i, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_is_that_of_sorted_suffixes(seed):
    rnd = random.Random(seed)
    pieces = [bytes(rnd.choice(b"ab" if seed % 2 else b"abcd") for _ in range(rnd.randrange(1, 60))) for _ in range(5)]
    text = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
    ends = np.flatnonzero(text == 0)
    data = text.tobytes()

    def suffix(i):
        end = ends[np.searchsorted(ends, i)]
        return data[i:end], int(end)

    plain = sorted((i for i in range(len(text)) if text[i]), key=lambda i: suffix(i)[0])
    order = [i for i in suffix_order(text, 64).tolist() if text[i]]
    assert [suffix(i)[0] for i in order] == [suffix(i)[0] for i in plain]


def test_repeated_starts():
    a = b"x" * 3 + b"0123456789" * 2 + b"tail"
    found = repeated_starts([a, b"..." + a[3:13]], [len(a) - 9, 4], 10)
    assert found[0].tolist() == [3, 13] and found[1].tolist() == [3]


def rows_of(rnd):
    word = lambda: "".join(rnd.choice("abcdéf漢 ") for _ in range(rnd.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(60), text(30)
    rows = [(i, text(120)) for i in range(12)]
    rows += [(100 + i, text(20 + i) + shared + text(30)) for i in range(5)]
    rows += [(200 + i, text(9) + line[:110] + text(60)) for i in range(8)]
    near = shared + text(80)
    rows += [(300 + i, near[: 40 * i] + "#" + near[40 * i :]) for i in range(8)]
    rows += [(400, None), (401, ""), (402, "z" * 199), (403, "z" * 200), (404, "z" * 900), (405, "ab" * 300), (406, rows[0][1])]
    rows += [(407, shared + shared), (408, rows[1][1]), (408, rows[1][1]), (None, rows[2][1]), (409, "z" * 199), (410, "\0" * 250)]
    return rows


@pytest.mark.parametrize("crowded", [2048, 2])
def test_equals_brute_force(docs_of, crowded):
    rows = rows_of(random.Random(8))
    assert got(remove_repeats(docs_of(rows), crowded=crowded)) == brute(rows)


def test_one_text_in_a_third_of_all_rows(docs_of):
    rnd = random.Random(2)
    rows = rows_of(rnd)
    rows += [(1000 + i, "the same text over and over " * 12) for i in range(60)] + [(2000, "start " + "the same text over and over " * 9)]
    assert got(remove_repeats(docs_of(rows, 7))) == brute(rows)


def test_empty_table(docs_of):
    assert remove_repeats(docs_of([(1, "x")]).where("false")).count() == 0


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert got(remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("batch", [1, 2, 3, 10_000])
def test_strings_of_crowded_anchors_meet_without_a_join(spark, batch):
    from brinelink.llm import suffixes

    rnd = random.Random(8)
    text = lambda n: bytes(rnd.choice(b"abcdefgh") for _ in range(n))
    common = text(24)
    held = [(i, 1 + 8, text(i % 4) + common + text(8 - i % 4 - 4 + 4)) for i in range(30)]
    held = [(c, len(p) - 20 + 1, p) for c, _, p in held]
    rows = [(7, c, 30, n, bytearray(p)) for c, n, p in [*held, held[3]]]  # one from a copy of its text
    pieces = spark.createDataFrame(rows, "anchor long, content long, kinds long, number long, piece binary")
    places = collections.defaultdict(list)
    for c, n, p in held:
        for lo in range(n):
            places[p[lo : lo + 20]].append((c, lo, lo))
    want = sorted(x for v in places.values() if len(v) > 1 for x in v)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = suffixes._counted(pieces, 20)
        assert sorted(tuple(r) for r in found.select("content", "lo", "hi").collect()) == want and len(want) >= 90
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
