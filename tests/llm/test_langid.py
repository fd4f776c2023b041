import numpy as np
import pytest

from brinelink.llm import langid
from brinelink.llm.common import held_out, table
from brinelink.llm.langid import LanguageFilter, corrected_counts, grams, predict, train


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def plain_grams(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    b = b"   " + b + b"   "
    return sorted(int.from_bytes(b[i : i + 4], "big") for i in range(len(b) - 3) if b[i : i + 4] != b"    ")


def test_grams_of_each_text():
    texts = ["Hello, wörld", "", "a", "123 !!", "x" * 9, ""]
    gram, owner = grams(*arrays(texts))
    for i, t in enumerate(texts):
        assert sorted(gram[owner == i].tolist()) == plain_grams(t)


def test_counts_are_corrected_for_false_positives():
    rng = np.random.default_rng(1)
    slots = np.zeros((1024, 1), np.uint64)
    slots[rng.random(1024) < 0.6] = 2  # language 1: nothing but noise
    model = LanguageFilter(["a", "b"], slots, np.array([0.0, np.count_nonzero(slots) / 1024]) ** langid.PROBES)
    text = bytes(rng.integers(97, 123, 40_000, dtype=np.uint8)).decode()
    n, found = corrected_counts(*arrays([text]), model)
    assert found[0, 0] == 0 and found[0, 1] < 0.03 * n[0]


def test_more_than_64_languages_and_odd_texts(spark, docs_of):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(70):
        unit = "".join(alphabet[(i * 7 + j * (1 + i % 11)) % 26] for j in range(6)) + alphabet[i % 26] + alphabet[i // 26]
        rows.append((i, (unit + " ") * 30, None, f"l{i:02}"))
    rows += [(100, None, None, "l00"), (101, "", None, "l00"), (102, "12 !?", None, "l00"), (103, "qqqq", None, None)]
    docs = docs_of(rows)
    model = train(docs, slots=1 << 14)
    assert len(model.languages) == 70
    got = {r.doc_id: r for r in predict(docs, model).collect()}
    assert all(got[i].lang_pred == f"l{i:02}" for i in range(70))
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[0].at == "x" and 0 <= min(r.score for r in got.values()) <= max(r.score for r in got.values()) <= 1
    assert predict(docs.where("false"), model).count() == 0
    nothing = train(docs.where("false"))
    assert predict(docs, nothing).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_filter_holds_every_chosen_gram(spark, docs_of):
    """Against plain counting: every n-gram that a language is to contain gives its bit."""
    rows = [(1, "the cat sat on the mat " * 9, None, "en"), (2, "le chat est sur la natte " * 9, None, "fr")]
    model = train(docs_of(rows), slots=1 << 12)
    for bit, (_, text, _, _) in enumerate(rows):
        gram = np.unique(np.array(plain_grams(text), np.uint32))
        n, found = corrected_counts(*arrays([text]), model)
        assert found[0, bit] >= 0.9 * n[0]
    assert model.languages == ["en", "fr"]


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    model = train(docs.where(~held_out("doc_id", 4, 2)))
    got = predict(docs, model).where(held_out("doc_id", 4, 2)).where("lang is not null and lang_pred <> 'und'")
    right = [r.lang == r.lang_pred for r in got.collect()]
    assert len(right) > 20 and sum(right) >= 0.97 * len(right)


def test_fold_is_the_stated_one(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in rows.select("doc_id", held_out("doc_id", 4, 2).alias("h")).collect()}
    assert got[None] is False
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(50))


@pytest.mark.parametrize("text", ["é", "漢", "a"])
def test_a_single_letter_counts_as_text(docs_of, text):
    docs = docs_of([(1, "a b c " * 20, None, "en"), (2, text)])
    assert {r.doc_id: r.lang_pred for r in predict(docs, train(docs)).collect()}[2] == "en"
