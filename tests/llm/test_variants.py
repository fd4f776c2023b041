import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import pytest

from brinelink.llm import variants
from brinelink.llm.common import table
from brinelink.llm.variants import near_pairs, roots, runs, spelling_variants

FOLD = {i: i + 32 for i in range(65, 91)}


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=199, length=6, often=5, times=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= often}
    near = {w: [o for o in n if distance_one(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_pairs_are_those_of_all_pairs(spark):
    rnd = random.Random(7)
    words = {"".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 9))) for _ in range(500)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "a", "b", "ab"}
    got = near_pairs(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")).collect()
    want = {p for a, b in combinations(words, 2) if distance_one(a, b) for p in ((a, b), (b, a))}
    assert len(got) == len(want)
    assert {(r.word, r.near) for r in got} == want
    assert all((r.n, r.near_n) == (len(r.word), len(r.near)) for r in got)


def test_nothing_is_broadcast(spark, docs_of):
    """A small file of words is a large table of signatures."""
    words = spark.createDataFrame([("abcdef", 1), ("abcdeg", 2)], "word string, n long")
    plans = [near_pairs(words), roots(words.selectExpr("word", "word || 'x' form")), spelling_variants(docs_of([(1, "abcdef " * 9)]))]
    for plan in plans:
        plan.collect()
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5"), ("y", "z")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w37" for i in range(37)} | {"x": "w37", "y": "z"}


def test_blocks_never_cut_a_run(docs_of, monkeypatch):
    text = "Ab \U0001f600cdé " * 40 + "x" * 50 + "×÷ Āz " + "q" * 9
    want = sorted(re.findall("[A-Za-zÀ-ÿ]+", text.translate(FOLD)))
    for size in (1, 7, 65_536):
        monkeypatch.setattr(variants, "BLOCK", size)
        assert sorted(r.run for r in runs(docs_of([(1, text)])).collect()) == want


def test_forms_by_hand(docs_of):
    rows = [(1, "colour " * 100 + "color " * 100 + "colours " * 20 + "colouds " * 5 + "Straße " * 30 + "strasse " * 5)]
    got = {r.word: r for r in spelling_variants(docs_of(rows), every=10**9).collect()}
    assert (got["colours"].form, got["colours"].root, got["colours"].n_near) == ("colour", "colour", 2)
    assert (got["colouds"].form, got["colouds"].root, got["colouds"].n_near) == (None, "colouds", 1)
    assert "color" not in got and got["straße"].n_near == 0


def test_odd_rows(docs_of):
    near = "abcdefg " * 40 + "abcdefh " * 6 + "abcdef " * 8
    rows = [(None, near), (3, near), (3, near), (4, None), (5, ""), (6, "é" * 9 + " 1 "), (7, ("Wordlike " * 9 + "WORDLIKE,wordlikes. ") * 3000)]
    for every in (2, 199):
        assert rows_of(spelling_variants(docs_of(rows), every=every)) == brute(rows, every=every)
    assert spelling_variants(docs_of(rows).where("false")).count() == 0


def test_equal_letters_crowd_one_signature(docs_of):
    """Many words of the same letters share every part of their vectors."""
    rnd = random.Random(3)
    words = {"".join(rnd.sample("abcdefgh", 8)) for _ in range(400)}
    rows = [(1, " ".join(w for w in sorted(words) for _ in range(5)) + " abcdefgh" * 90)]
    assert rows_of(spelling_variants(docs_of(rows), every=3)) == brute(rows, every=3)


@pytest.mark.filterwarnings("ignore")
def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(spelling_variants(docs)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cols = "word, form, root, n, n_near, form_n"
    assert sorted(con.execute(f"SELECT {cols} FROM ({variants.SQL})").fetchall()) == want
