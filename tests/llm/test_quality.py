import numpy as np
import pytest

from brinelink.llm.common import held_out, table
from brinelink.llm.quality import N_FEATURES, features, fit, score, train


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["A plain text.\nAnother line.", "", "x x x x x x", "ÄÖ | a | b!!", "one\none\none"]
    together = features(*arrays(texts))
    assert together.shape == (5, N_FEATURES) and not together[1].any()
    for i, t in enumerate(texts):
        assert np.array_equal(together[i], features(*arrays([t]))[0])
    assert together[2][-8] == 1 and together[4][-4] == pytest.approx(2 / 3)  # most frequent word, different lines


def test_non_negative_risk_separates_what_is_only_in_the_unlabelled():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (3000, 5)).astype(np.float32), rng.normal(-2, 1, (1000, 5)).astype(np.float32)
    model = fit(good[:1000], np.concatenate([good[1000:], bad]), 2 / 3)
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95


def test_odd_rows_and_no_labels(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "some plain text here"), (3, "some plain text here"), (None, "é 漢"), (4, "x " * 50_000)])
    labels = spark.createDataFrame([(3, 1, None), (4, 0, 0), (None, 1, 0), (2, None, 0), (9, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.where("false")):
        rows = score(docs, train(docs, marks)).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert score(docs.where("false"), train(docs.where("false"), labels)).count() == 0


def test_held_out_accuracy(spark):
    """On documents whose labels were not seen."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = train(docs.where(~held_out("doc_id", 5, 0)), labels.where(~held_out("doc_id", 5, 0)))
    got = score(docs, model).join(labels, "doc_id").where(held_out("doc_id", 5, 0)).collect()
    right = [(r.score >= 0.3) == (r.quality == 1) for r in got]
    assert len(right) > 40 and np.mean(right) > 0.93
