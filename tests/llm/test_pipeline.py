"""The pipeline has no SQL; each stage is held against a plain version on the stage before."""

import collections

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from brinelink.llm.common import stored, table
from brinelink.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = {"input": docs}
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        out[name] = docs
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].columns == stages["input"].columns


def test_language_keeps_all_texts_in_a_known_language(stages):
    assert texts(stages["language"]) == {i: t for i, t in texts(stages["input"]).items() if t and any(c.isalpha() for c in t)}


def test_one_of_each_group_of_near_duplicates_stays(stages):
    rows = sorted((i, fingerprint(t)) for i, t in texts(stages["language"]).items())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, f) in enumerate(rows):
        for j, g in rows[:k]:
            if (f ^ g).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(texts(stages["simhash"])) == {i for i in root if find(i) == i}


def test_repeated_passages_go_but_for_one_holder(stages):
    before, after = texts(stages["simhash"]), texts(stages["passages"])
    holders = collections.defaultdict(set)
    for i, t in before.items():
        w = t.lower().split()
        for x in range(len(w) - 49):
            holders[tuple(w[x : x + 50])].add(i)
    shared = {k for k, v in holders.items() if len(v) > 1}
    left = collections.Counter()
    for i, t in after.items():
        w = t.lower().split()
        left.update({tuple(w[x : x + 50]) for x in range(len(w) - 49)} & shared)
    assert max(left.values(), default=0) <= 1
    touched = {i for k in shared for i in holders[k]}
    for i, t in before.items():
        if after.get(i) != t:
            kept = collections.Counter(after.get(i, "").split())
            assert not kept - collections.Counter(t.split())
    assert all(after[i] == before[i] for i in before if i not in touched and after.get(i) == before[i])


def test_no_document_holds_a_benchmark_item_and_clean_ones_stay(spark, sf, stages):
    before, after = texts(stages["passages"]), texts(stages["decontamination"])
    items = [r.text for r in table(spark, sf, "benchmark").collect() if r.text]
    assert not [i for i, t in after.items() if any(x in t for x in items)]
    for i in set(before) - set(after):  # what went holds half of some item's words in a row
        words = before[i].split()
        grams = {tuple(words[x : x + 5]) for x in range(len(words) - 4)}
        assert any(sum(tuple(w[x : x + 5]) in grams for x in range(len(w) - 4)) > 0.3 * len(w) for w in (x.split() for x in items))


def test_everything_left_is_packed(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(stages["decontamination"]).items()}
    got = collections.Counter()
    for r in stages["packing"].collect():
        got[r.doc_id] += r.length
    assert got == want


def test_run_is_the_stages_in_a_row(spark, sf, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    total = lambda rows: sum(r[2] for r in rows)
    assert total(key(cp.run(spark, sf))) == total(key(stages["packing"]))


def test_odd_rows(spark, sf, docs_of, monkeypatch):
    monkeypatch.setattr(cp, "LEAST_SCORE", 0.0)  # a few rows teach no language
    rows = [(1, None), (2, ""), (3, "12 34"), (4, "plain words in a row, and some more of them"), (4, "plain words in a row, and some more of them")]
    rows += [(4, "a second text of the same id that is not at all alike"), (None, "a text without an id, of another kind"), (None, None)]
    docs = docs_of([(i, t, None, "en") for i, t in rows])
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), f"odd-{name}")
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["4", "4", "None"]
    assert cp.STAGES[-1][1](spark, docs, sf).count() >= 3
    empty = docs.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_a_stage_goes_when_the_next_is_stored(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    seen = []

    def stage(name):
        def run(spark, docs, sf_dir):
            seen.append(docs)
            return docs

        return name, run

    monkeypatch.setattr(cp, "table", lambda *_: rows)
    monkeypatch.setattr(cp, "STAGES", [stage(x) for x in "abcd"])
    assert cp.run(spark, "").collect() == [(1, "a")]
    there = [spark._jvm.java.io.File(d.stored_at).exists() for d in seen[1:]]
    assert there == [False, False, True]
