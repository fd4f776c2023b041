"""Benchmark decontamination by templates.

A text becomes canonical tokens: numbers, quantities, units and names are replaced by typed
placeholders and their values kept as slots. Windows of ``WINDOW`` tokens are hashed. A
document meets an item over equal windows at one alignment; a window counts only if its
slots agree, that is if each of its item values stands for the value in the document that most tokens
of this item value stand for. So a question asked again with other numbers or names is found, and a text that
merely has the same shape is not.

Texts are read twice. In the plain reading a name is a capitalised word inside a sentence. In the wide reading capitals of any script
count, a capitalised word that opens a sentence is a name if it stands as one inside a sentence of the same text, and adjacent names
are one. Windows of a reading meet only windows of the same reading, so neither loses what it finds alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinelink.llm import textarrays as ta
from brinelink.llm.common import stored

WINDOW = 5
#: Share of an item's windows that a document must hold at one alignment.
COVERAGE = 0.5
#: Literal tokens that a window needs; with fewer it is compared with its values in place.
LITERALS = 3
#: Window hashes that a pass over the documents looks for; a larger benchmark takes several passes.
HASHES_PER_PASS = 4_000_000

# fixed values: unit names and symbols, singular and plural
UNITS = """
mm cm m km inch inches foot feet yard yards mile miles
mg g kg ton tons tonne tonnes ounce ounces pound pounds
ml l litre litres liter liters gallon gallons
s ms sec second seconds min minute minutes h hour hours day days week weeks month months year years
euro euros dollar dollars cent cents percent degrees
w kw j kj v a hz khz mhz ghz kb mb gb tb kmh mph
""".split()

_U = np.uint64
_NUM, _QTY, _UNIT, _NAME = 1, 2, 3, 4
_PLACE = ta.mix(np.arange(1, 6, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT = _flags(b"0123456789")
_IN_NUMBER = _flags(b"0123456789.,:/-+%$")
_PUNCT = _flags(b"!\"#&'()*,-./:;<=>?@[\\]^_`{|}~")
_SIGNED = _flags(b"$%+")
_ENDS = _flags(b".!?:\n|")
_UPPER = _flags(bytes(range(65, 91)))
_LOWER = _flags(bytes(range(97, 123)) + bytes(range(128, 256)))


def _letters(category: str) -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) == category for c in range(1 << 16)])


_ANY_UPPER, _ANY_LOWER = _letters("Lu"), _letters("Ll")


def _points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of up to three bytes that start at positions, 0 for longer ones, and their lengths in bytes."""
    a, b, c = (data[np.minimum(at + k, len(data) - 1)].astype(np.int64) for k in range(3))
    size = np.where(a < 0x80, 1, np.where(a < 0xE0, 2, np.where(a < 0xF0, 3, 4)))
    two, three = (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63
    return np.select([size == 1, size == 2, size == 3], [a, two, three], 0), size


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(ta.hashes(data, np.concatenate([[0], ends[:-1]]), ends))


_UNIT_HASHES = _unit_hashes()


def _among(x: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    return ranked[np.minimum(np.searchsorted(ranked, x), len(ranked) - 1)] == x if len(ranked) else np.zeros(len(x), bool)


class Tokens(NamedTuple):
    """Tokens of texts as both readings start from them: without names."""

    hashed: Callable[[np.ndarray, np.ndarray], np.ndarray]
    literal: np.ndarray
    kind: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw_end: np.ndarray
    first: np.ndarray
    opens: np.ndarray


def tokens_of(data: np.ndarray, at: np.ndarray) -> Tokens:
    starts, ends, first = ta.words(data, at)
    raw_end = ends
    # punctuation around a word does not count; a word of nothing else is none
    starts, ends = starts.copy(), ends.copy()
    for edge, step in ((starts, 1), (ends, -1)):
        move = np.arange(len(starts))
        while len(move):
            look = edge[move] - (step < 0)
            move = move[(starts[move] < ends[move]) & _PUNCT[data[np.clip(look, 0, len(data) - 1)]]]
            edge[move] += step
    real = starts < ends
    first = np.concatenate([[0], np.cumsum(real)])[first]
    starts, ends, raw_end = starts[real], ends[real], raw_end[real]
    hashed = ta.hasher(data)
    if not len(starts):
        return Tokens(hashed, np.zeros(0, _U), np.zeros(0, np.int8), starts, ends, raw_end, first, np.zeros(0, bool))

    literal = hashed(starts, ends)
    size = ends - starts
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[data])])[np.stack([starts, ends], 1)], axis=1)[:, 0]
    digits, numeric = count(_DIGIT), count(_IN_NUMBER)
    kind = np.zeros(len(starts), np.int8)
    number = (digits > 0) & (numeric == size)
    quantity = (digits > 0) & ~number & _DIGIT[data[starts]] & (size <= 24)
    kind[number] = _NUM
    # digits with a unit at once: the letters after the last digit
    some = np.flatnonzero(quantity)
    if len(some):
        where = np.where(_IN_NUMBER[data], np.arange(len(data)), -1)
        last = np.maximum.accumulate(where)[ends[some] - 1]
        letters = (last >= starts[some]) & (last + 1 < ends[some]) & (numeric[some] == last + 1 - starts[some])
        tail = hashed(np.minimum(last + 1, ends[some]), ends[some])
        kind[some[letters & _among(tail, _UNIT_HASHES)]] = _QTY
    begins = np.zeros(len(starts), bool)
    begins[first[:-1][first[:-1] < len(starts)]] = True
    after_number = np.concatenate([[False], kind[:-1] == _NUM]) & ~begins
    kind[(kind == 0) & after_number & _among(literal, _UNIT_HASHES)] = _UNIT
    ended = np.concatenate([[True], _ENDS[data[raw_end[:-1] - 1]]])
    line = np.concatenate([[0], np.cumsum(data == 10)])
    new_line = np.concatenate([[True], line[starts[1:]] != line[starts[:-1]]])
    return Tokens(hashed, literal, kind, starts, ends, raw_end, first, ended | begins | new_line)


def canonical(data: np.ndarray, at: np.ndarray, wide: bool = False, tokens: Tokens | None = None):
    """Tokens of texts: literal hash, kind (0 literal), start, end, and the first token of each text; ``wide`` for the wide reading.

    ``tokens`` are what ``tokens_of`` gives for the texts, if it was asked before.
    """
    hashed, literal, kind, starts, ends, raw_end, first, opens = tokens or tokens_of(data, at)
    if not len(starts):
        return literal, kind, starts, ends, first
    kind, size = kind.copy(), ends - starts
    if not wide:
        # a name has a capital and goes on in small letters, inside a sentence
        head, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
        third = data[np.minimum(starts + 2, len(data) - 1)]
        latin = (head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        capital = np.where(latin, _LOWER[third] & (size > 2), _UPPER[head] & _LOWER[second] & (size > 1))
        kind[(kind == 0) & capital & ~opens] = _NAME
        return literal, kind, starts, ends, first

    point, length = _points(data, starts)
    follows, _ = _points(data, starts + length)
    able = (kind == 0) & _ANY_UPPER[point] & _ANY_LOWER[follows] & (size > length)
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    word = ta.mix(literal ^ ta.mix(text))
    kind[able & np.isin(word, word[able & ~opens])] = _NAME
    # names side by side are one, unless a sentence or a mark stands between them
    name = kind == _NAME
    joined = name & ~opens & np.concatenate([[False], name[:-1] & (raw_end[:-1] == ends[:-1])])
    lead = np.flatnonzero(~joined)
    last = np.concatenate([lead[1:], [len(starts)]]) - 1
    starts, ends = starts[lead], ends[last]
    first = np.concatenate([[0], np.cumsum(~joined)])[first]
    return hashed(starts, ends), kind[lead], starts, ends, first


def template_windows(data: np.ndarray, at: np.ndarray, size: int = WINDOW, wide: bool = False, tokens: Tokens | None = None):
    """Hash and templated flag of every window, the first window of each text, and the tokens.

    A text of fewer tokens but one is one window.
    """
    literal, kind, starts, ends, first = canonical(data, at, wide, tokens)
    token = np.where(kind > 0, _PLACE[kind], literal)
    template, out_first = ta.shingles(token, first, size)
    plain, _ = ta.shingles(literal, first, size)
    counts = np.diff(first)
    n = np.diff(out_first)
    index = np.arange(out_first[-1]) - np.repeat(out_first[:-1], n) + np.repeat(first[:-1], n)
    width = np.minimum(np.repeat(counts, n), size)
    slots = np.concatenate([[0], np.cumsum(kind > 0)])
    held = slots[index + width] - slots[index]
    templated = (held > 0) & (width - held >= LITERALS)
    return np.where(templated, template, plain), templated, out_first, index, width, (kind, starts, ends)


def _sums(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number and sum of the window hashes of each text."""
    total = np.concatenate([[_U(0)], np.cumsum(hashed, dtype=np.uint64)])
    return np.stack([np.diff(first).astype(np.uint64), total[first[1:]] - total[first[:-1]]])


def _windows(texts: DataFrame, key: str, wanted=None) -> DataFrame:
    """Windows of texts, or those among the broadcast sorted hashes: key, reading, hash, place, windows, slots, and the slots' tokens.

    ``reading`` is 0 for the plain and 1 for the wide one, which is left out for texts that it does not change.
    """
    names = [key, "reading", "hash", "place", "windows", "slots", "spots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in ta.blocks(batch):
                data, at = ta.utf8(b.column("text"))
                plain, tokens = None, tokens_of(data, at)
                for reading in (0, 1):
                    hashed, templated, first, index, width, (kind, starts, ends) = template_windows(data, at, wide=reading == 1, tokens=tokens)
                    sums = _sums(hashed, first)
                    sel = np.arange(len(hashed)) if wanted is None else np.flatnonzero(_among(hashed, wanted.value))
                    doc = np.searchsorted(first, sel, "right") - 1
                    if reading:
                        changed = (sums != plain).any(axis=0)[doc]
                        sel, doc = sel[changed], doc[changed]
                    plain = sums
                    slots, spots = [], []
                    for w, d, full in zip(sel, doc, templated[sel]):
                        held = range(index[w], index[w] + width[w]) if full else ()
                        spots.append([i - index[first[d]] for i in held if kind[i]])
                        slots.append([f"{kind[i]}{data[starts[i]:ends[i]].tobytes().decode('utf-8', 'replace')}" for i in held if kind[i]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(key).take(pa.array(doc)),
                            pa.array(np.full(len(sel), reading, np.int32)),
                            pa.array(hashed[sel].view(np.int64)),
                            pa.array(sel - first[doc]),
                            pa.array(np.diff(first)[doc]),
                            pa.array(slots, pa.list_(pa.string())),
                            pa.array(spots, pa.list_(pa.int64())),
                        ],
                        names,
                    )

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, reading int, hash long, place long, windows long, slots array<string>, spots array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, per_pass: int = HASHES_PER_PASS) -> DataFrame:
    """Documents that hold benchmark items: doc_id, content (a key of id and text), item_id, covered, windows.

    ``covered`` counts the item's ``windows`` found at the best alignment, in the reading that finds the larger share. Null and texts
    without a word hold nothing and are no item. A null id is kept as such. Repeated rows of
    either table count once. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    items = items.withColumn("ik", F.xxhash64("item_id", "text"))
    bench = stored(_windows(items, "ik"), "bench")
    # found windows must hold one of any items's rarest half: only these lead to a document
    held_by = bench.groupBy("hash").agg(F.count_distinct("ik").alias("items"))
    by_rarity = Window.partitionBy("ik", "reading").orderBy("items", "hash", "place")
    enough = F.col("windows") - F.ceil(F.col("windows") * coverage) + 1
    bench = bench.join(held_by, "hash").withColumn("rare", F.row_number().over(by_rarity) <= enough).drop("items")
    bench = stored(bench.withColumnsRenamed({"place": "item_place", "slots": "item_slots"}), "bench-rare")

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text").where("text is not null")
    passes = max(1, -(-bench.count() // per_pass))
    hits = None
    for p in range(passes):
        part = bench.where(F.pmod("hash", F.lit(passes)) == p).select("hash").distinct().toArrow()
        ranked = spark.sparkContext.broadcast(np.sort(part.column("hash").to_numpy().view(np.uint64)))
        found = _windows(keyed, "rk", ranked).select("rk", "reading", "hash", "place", "slots")
        hits = found if hits is None else hits.union(found)
    hits = stored(hits, "hits").distinct()

    candidates = hits.join(bench.where("rare").select("hash", "ik", "reading"), ["hash", "reading"]).select("rk", "ik", "reading").distinct()
    pairs = hits.join(candidates, ["rk", "reading"]).join(bench.drop("rare"), ["hash", "ik", "reading"])
    pairs = pairs.withColumn("shift", F.col("place") - F.col("item_place"))
    lined = ["rk", "ik", "reading", "shift"]
    slots = pairs.select(*lined, "item_place", F.explode(F.arrays_zip("spots", "item_slots", "slots")).alias("s")).select(*lined, "item_place", "s.*")
    # one value of the item, one value here: that of most of its tokens. Windows with another do not count, nor any without a majority
    valued = [*lined, "item_slots"]
    read = slots.groupBy(*valued, "slots").agg(F.count_distinct("spots").alias("n"))
    read = read.withColumn("all", F.sum("n").over(Window.partitionBy(*valued)))
    clash = slots.join(read.where("2 * n <= all"), [*valued, "slots"]).select(*lined, "item_place").distinct()
    agreed = pairs.join(clash, [*lined, "item_place"], "left_anti")
    agreed = agreed.groupBy(*lined).agg(F.count_distinct("item_place").alias("covered"), F.first("windows").alias("windows"))
    best = agreed.where(F.col("covered") >= F.ceil(F.col("windows") * coverage))
    share = F.struct((F.col("covered") / F.col("windows")).alias("share"), "covered", "windows")
    best = best.groupBy("rk", "ik").agg(F.max(share).alias("b")).select("rk", "ik", "b.covered", "b.windows")
    ids = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk")).distinct()
    return (
        best.join(items.select("ik", "item_id"), "ik")
        .join(ids, "rk")
        .select("doc_id", F.col("rk").alias("content"), "item_id", "covered", "windows")
    )
