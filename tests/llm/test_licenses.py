import re

import duckdb

from brinelink.llm import licenses as L
from brinelink.llm.common import table

COLUMNS = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
FOLD = {i: i + 32 for i in range(65, 91)}


def brute(text):
    """Every rule at every text, every pair of places compared."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))
    stream = "".join(f" {w} " for w in words)
    found = []
    for rule, label, priority, weight, rx, _ in L.rules():
        for m in re.finditer(rx, stream):
            found.append((stream.count(" ", 0, m.start()) // 2, stream.count(" ", 0, m.end()) // 2, priority, rule, label, weight))
    kept = [
        x
        for x in found
        if x[2] == 0
        or not any(
            o is not x and o[0] <= x[0] and o[1] >= x[1] and o[2] <= x[2] and (o[0] < x[0] or o[1] > x[1] or o[2:4] < x[2:4]) for o in found
        )
    ]
    base = [x for x in found if x[2] == 0]
    starts = [x[0] for x in base]
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({x[4] for x in base})),
        ",".join(sorted({x[4] for x in kept})),
        max((x[5] for x in kept), default=0.0),
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def want_of(rows):
    return sorted(((i, *brute(t)) for i, t in rows), key=repr)


TEXTS = [
    "Released under the MIT License, see LICENSE.",
    "under the mit license under the MIT-license under the mit LICENSE",
    "Apache License, Version 2.0 (the \"License\"); apache license version 2",
    "CC-BY-NC cc by nc CC BY-NC-SA 4.0",
    "GNU Lesser General Public License version 2.1 or GNU General Public License v3",
    "SPDX-License-Identifier: GPL-3.0-only. Dual licensed under GPL or the MIT licence.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy. All rights reserved.",
    "Creative Commons Attribution-NonCommercial. creative commons attribution non commercial share alike license",
    "under\x00the\x7fmit\tlicense  under\u00a0the mit license ",
    "permit emit mitt license; bsd; 3-clause BSD license; see the isc license for details",
]


def test_rules_are_many_and_gated():
    book = L.rules()
    assert len(book) > 300 and len({r[0] for r in book}) == len(book)
    assert all(f" {r[5]} " in r[4] for r in book)
    assert L.expression("a b|c d? ~2 e") == " a  (?:b|c) (?: d )?(?: [^ ]+ ){0,2} e "


def test_texts_by_brute_force(docs_of):
    rows = list(enumerate(TEXTS))
    assert rows_of(L.licenses(docs_of(rows))) == want_of(rows)


def test_by_hand(docs_of):
    got = {r.doc_id: r for r in L.licenses(docs_of(list(enumerate(TEXTS)))).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].labels) == (1, 1, 1, "mit")
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (3, 0, 8)
    assert (got[2].n_base, got[2].base_labels, got[2].labels) == (2, "apache-2", "apache-2")
    assert (got[3].n_base, got[3].base_labels, got[3].labels) == (3, "cc-by-nc", "cc-by-nc,cc-by-nc-sa")
    assert got[4].labels == "gpl-3,lgpl-2.1"  # the shorter names lie inside
    assert (got[8].n_base, got[8].n_words) == (1, 7)  # other blanks are part of a word


def test_contained_detections_go(spark):
    book = L.rules()
    rule = {p: next(r[0] for r in book if r[2] == p) for p in L.PRIORITIES}
    one, two = [r[0] for r in book if r[2] == 4][:2]
    places = [(1, rule[4], 2, 4), (1, rule[2], 0, 5), (1, rule[1], 2, 3), (1, rule[3], 4, 9), (1, rule[0], 3, 5), (2, one, 2, 4), (2, two, 2, 4)]
    got = {(r.uid, r.rule): r.kept for r in L.survivors(spark.createDataFrame(places, "uid long, rule int, start int, end int")).collect()}
    assert got == {
        (1, rule[4]): False,  # inside one of a better priority
        (1, rule[2]): True,
        (1, rule[1]): True,  # inside a worse one
        (1, rule[3]): True,  # overlaps
        (1, rule[0]): True,  # base stays
        (2, one): True,  # alike: the first
        (2, two): False,
    }


def test_odd_rows(docs_of):
    long = ("word " * 40 + "under the MIT license, Apache-2.0 licensed ") * 1500
    rows = [(None, None), (1, ""), (2, " ;\n"), (3, long), (3, long), (None, TEXTS[0]), (4, "é" * 70_000), (5, "mit " * 20_000)]
    assert rows_of(L.licenses(docs_of(rows)))[:4] and rows_of(L.licenses(docs_of(rows[:3] + rows[5:7]))) == want_of(rows[:3] + rows[5:7])
    got = [r for r in L.licenses(docs_of(rows)).collect() if r.doc_id == 3]
    assert len(got) == 2 and all((r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (1500 * 48, 1500, 40, 1499 * 48 + 40, "apache-2,mit") for r in got)
    assert L.licenses(docs_of(rows).where("false")).count() == 0


def test_whole_table_and_sql(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = rows_of(L.licenses(docs))
    assert got == want_of(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(con.execute(f"SELECT {COLUMNS} FROM ({L.sql()})").fetchall(), key=repr) == got


def test_no_python_in_the_plan(spark, sf):
    plan = L.licenses(table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
