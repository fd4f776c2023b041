"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages share one filter. A slot holds a bit per language, so looking up an n-gram is
the conjunction of a few slots and gives every language that contains it. For each language
the bits over a text's n-grams are counted and the count is corrected for those that chance
alone would set: with n lookups, c hits and a false-positive rate f, (c - n f) / (1 - f).
The language with the most is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinelink.llm import textarrays as ta
from brinelink.llm.common import stored

UNKNOWN = "und"
#: Slots of the filter. Its size, 8 bytes a slot for each 64 languages, does not grow with the corpus.
SLOTS = 1 << 21
PROBES = 3
#: A language contains an n-gram if it uses it this often and at no less than this share of the highest rate.
MIN_COUNT = 5
MIN_SHARE = 0.3
#: N-grams that a task gathers before it hands on their counts.
GATHERED = 4_000_000

_U = np.uint64
_GAP = 3
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class LanguageFilter:
    """Languages in bit order, the slots (a row per slot, 64 languages a column) and their false-positive rates."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte n-grams of texts, A-Z folded and all but letters a space, and their text's number."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    plain = np.full(len(data) + _GAP * (len(n) + 1), 0x20, np.uint8)
    plain[np.arange(len(data)) + _GAP * (doc + 1)] = _PLAIN[data]
    wide = plain.astype(np.uint32)
    gram = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    keep = gram != 0x20202020
    owner = np.repeat(np.arange(len(n)), n + _GAP)[: len(gram)]
    owner = np.concatenate([owner, np.full(len(gram) - len(owner), max(len(n) - 1, 0))])
    return gram[keep], owner[keep]


def _probes(gram: np.ndarray, size: int) -> list[np.ndarray]:
    h = ta.mix(gram.astype(np.uint64) + _U(0x632BE59BD9B4E019))
    first, step = h & _U(0xFFFFFFFF), h >> _U(32) | _U(1)
    return [((first + _U(i) * step) % _U(size)).astype(np.int64) for i in range(PROBES)]


def train(labelled: DataFrame, *, slots: int = SLOTS, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE) -> LanguageFilter:
    """Learns from columns text and lang of every row; rows with a null in either are passed over."""
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                gram = np.concatenate([p[0] for p in parts])
                n = np.concatenate([p[1] for p in parts])
                g, where = np.unique(gram, return_inverse=True)
                total = np.bincount(where, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(total)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for b in ta.blocks(batch):
                gram, owner = grams(*ta.utf8(b.column("text")))
                langs = np.array(b.column("lang").to_pylist(), dtype=object)
                for lang in set(langs):
                    g, n = np.unique(gram[(langs == lang)[owner]], return_counts=True)
                    held.setdefault(lang, []).append((g, n))
                    size += len(g)
            if size > GATHERED:
                yield from out()
                size = 0
        yield from out()

    counts = labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("t"))
    languages = sorted(r.lang for r in totals.select("lang").collect())  # the label set
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return LanguageFilter([], np.zeros((slots, 1), np.uint64), np.zeros(0))
    numbers = totals.select("lang", "t", (F.row_number().over(Window.orderBy("lang")) - 1).alias("bit"))
    rate = counts.join(F.broadcast(numbers), "lang").withColumn("rate", F.col("n") / F.col("t"))
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rate.join(top, "gram").where((F.col("n") >= min_count) & (F.col("rate") >= min_share * F.col("top")))
    masks = kept.groupBy("gram", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = _probes(b.column("gram").to_numpy(), slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(where)), *(pa.concat_arrays([b.column(c)] * PROBES) for c in ("word", "mask"))],
                ["slot", "word", "mask"],
            )

    placed = masks.mapInArrow(place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.expr("bit_or(mask)").alias("mask"))
    filled = placed.toArrow()  # at most a row per slot and 64 languages
    table = np.zeros((slots, words), np.uint64)
    table[filled.column("slot").to_numpy(), filled.column("word").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(table[:, i // 64] >> _U(i % 64) & _U(1)) / slots for i in range(len(languages))])
    return LanguageFilter(languages, table, fill**PROBES)


def corrected_counts(data: np.ndarray, at: np.ndarray, model: LanguageFilter) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of every text, and how many of them each language contains (texts x languages)."""
    gram, owner = grams(data, at)
    n = np.bincount(owner, minlength=len(at) - 1).astype(float)
    hits = np.zeros((len(at) - 1, len(model.languages)))
    where = _probes(gram, len(model.slots))
    bounds = np.concatenate([[0], np.cumsum(n).astype(np.int64)])
    for word in range(model.slots.shape[1]):
        column = model.slots[:, word]
        mask = column[where[0]]
        for w in where[1:]:
            mask = mask & column[w]
        for i in range(word * 64, min(len(model.languages), word * 64 + 64)):
            total = np.concatenate([[0], np.cumsum(mask >> _U(i % 64) & _U(1), dtype=np.int64)])
            hits[:, i] = total[bounds[1:]] - total[bounds[:-1]]
    f = model.false_positive
    return n, np.clip((hits - n[:, None] * f) / (1 - f), 0, n[:, None])


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``docs`` with lang_pred and score, the part of the text's n-grams that the language contains.

    lang_pred is ``und`` and score 0 if text is null or has no letter, and where nothing was
    learned. Ties go to the first language by name. Only text is read; all other columns are
    kept as they are, but for two of these names, which are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    inner = [f"c{i}" for i in range(len(names))]
    text = inner[names.index("text")]
    plain = docs.select(*names).toDF(*inner)
    plain = plain.withColumn("letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in ta.blocks(batch, text):
                letters = b.column("letters").to_numpy(zero_copy_only=False)
                if m.languages:
                    n, found = corrected_counts(*ta.utf8(b.column(text)), m)
                    best = found.argmax(axis=1)
                    score = np.where(letters, found[np.arange(len(b)), best] / np.maximum(n, 1), 0.0)
                    pred = [m.languages[i] if ok else UNKNOWN for i, ok in zip(best, letters)]
                else:
                    score, pred = np.zeros(len(b)), [UNKNOWN] * len(b)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in inner), pa.array(pred, pa.string()), pa.array(score)], [*inner, "lang_pred", "score"]
                )

    fields = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, docs.select(*names).schema))
    return plain.mapInArrow(run, f"{fields}, lang_pred string, score double").toDF(*names, "lang_pred", "score")
