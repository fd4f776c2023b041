"""Removal of every byte that lies in a string of ``length`` bytes found anywhere else.

Equal strings have to meet, and no task can hold the suffixes of all texts. So each string of
``length`` bytes is given to an anchor: the smallest hash of the ``gram``-byte strings in it,
the leftmost if equal. It depends on the string alone, so equal strings have equal anchors.
Neighbouring strings mostly share theirs and form a stretch of text.

1. Stretches whose anchor occurs once anywhere can have no equal. For the rest, equal
   stretches are counted, and anchors with several different stretches go on.
2. The different stretches of an anchor meet in one task, which sorts their suffixes in two
   stages: only suffixes smaller than their successor are sorted directly; all others are
   induced by a scan over first bytes, as a suffix that is larger than its successor has its
   place by run length and by the place of what follows the run, which is known by then.
   Neighbours in that order with a common prefix of ``length`` are repeats.
3. An anchor with very many different stretches, such as one in a line that all pages have, is
   not sorted in one task: its strings are told apart by two hashes and counted.
4. Repeats become byte intervals of their texts; texts that are equal as a whole are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelink.llm import textarrays as ta
from brinelink.llm.common import partitions, stored

LENGTH = 200
GRAM = 40
#: Different stretches of an anchor beyond which its strings are counted by hash instead of sorted.
CROWDED = 2048
#: Bytes whose suffixes are sorted at once (an anchor's stretches are never divided).
SORTED_BYTES = 400_000
#: A text that makes up more than this part of all rows is set apart; there can be a thousand of them.
HOT_PART = 0.001
_U = np.uint64


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (0 ends a piece) in order, at least up to ``depth`` bytes or the end of their piece."""
    n = len(text)
    run_end = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, n)
    end = run_end[np.searchsorted(run_end, np.arange(n), "right")]
    after = np.where(end < n, text[np.minimum(end, n - 1)], 0)
    ends = text == 0
    smaller = (after > text) & ~ends
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rank = np.zeros(n, np.int64)
    rank[ends] = np.arange(ends.sum())  # pieces' ends differ from one another
    at = np.flatnonzero(smaller)
    # stage one: directly, as fixed-width strings
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[at]).view(f"S{depth}")[:, 0]
    direct = at[np.argsort(strings, kind="stable")]
    # stage two: byte by byte, the larger ones first within a byte
    larger = np.flatnonzero(~smaller & ~ends)
    by_byte = larger[np.argsort(text[larger], kind="stable")]
    small_of = np.searchsorted(text[direct], np.arange(258))
    large_of = np.searchsorted(text[by_byte], np.arange(258))
    base = int(ends.sum())
    for c in range(1, 256):
        here = by_byte[large_of[c] : large_of[c + 1]]
        if len(here):
            follows = np.where(end[here] < n, rank[np.minimum(end[here], n - 1)], -1)
            rank[here[np.lexsort((follows, end[here] - here))]] = base + np.arange(len(here))
            base += len(here)
        there = direct[small_of[c] : small_of[c + 1]]
        rank[there] = base + np.arange(len(there))
        base += len(there)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def repeated_starts(pieces: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """Of the first ``count`` positions of each piece, which begin a string of ``length`` that begins at another, too."""
    text = np.frombuffer(b"".join(b"\xff" + p for p in pieces) + b"\xff", np.uint8) + np.uint8(1)  # 255 is in no UTF-8
    starts = np.cumsum([1, *(len(p) + 1 for p in pieces)])[:-1]
    own = np.zeros(len(text), bool)
    for s, c in zip(starts, counts):
        own[s : s + c] = True
    order = suffix_order(text, length)
    order = order[own[order]]
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(length, np.uint8)]), length)
    repeat = np.zeros(len(text), bool)
    for s in range(0, len(order) - 1, 20_000):
        a, b = order[s : s + 20_000], order[s + 1 : s + 20_001]
        a = a[: len(b)]
        differ = view[a] != view[b]
        prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        same = prefix >= length
        repeat[a[same]] = True
        repeat[b[same]] = True
    return [np.flatnonzero(repeat[s : s + c]) for s, c in zip(starts, counts)]


def stretches(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Anchor hash, content hash, text number, start and number of strings of every stretch."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(_U), none.astype(_U), none, none, none
    begins = np.arange(len(data) - gram + 1)
    g = ta.hashes(data, begins, begins + gram, fold=False)
    anchor = ta.first_minima(g, length - gram + 1)
    doc = np.searchsorted(at, np.arange(len(anchor)), "right") - 1
    valid = np.arange(len(anchor)) + length <= at[doc + 1]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1]))
    start = np.flatnonzero(new)
    sums = np.concatenate([[0], np.cumsum(valid)])
    n = np.diff(np.append(sums[start], sums[-1]))
    a = anchor[start]
    content = ta.hashes(data, start, start + n - 1 + length, fold=False)
    content = ta.mix(content ^ ta.mix(((a - start) << 20 | n).astype(_U)))
    return g[a], content, doc[start], start - at[doc[start]], n


def _stretch_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Every stretch of every text (h, text): anchor, content, h, place (start and number). Copies in a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in ta.blocks(batch):
                h = b.column("h").to_numpy()
                fresh = []
                for i, x in enumerate(h.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                if len(seen) > 1_000_000:
                    seen.clear()
                part = b.take(pa.array(fresh, pa.int32()))
                anchor, content, doc, start, n = stretches(*ta.utf8(part.column("text")), length, gram)
                arrays = [anchor.view(np.int64), content.view(np.int64), h[np.array(fresh, np.int64)][doc], start << 16 | n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["anchor", "content", "h", "place"])

    return texts.select("h", "text").mapInArrow(run, "anchor long, content long, h long, place long")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty. Strings never cross texts, overlaps count, and all strings are
    judged on the input. Texts shorter than ``length`` bytes keep everything. Repeated rows
    are copies of one another like any other two rows. Null ids are kept. Other columns are
    not read. No rows give none. A text that repeats with a short period has a stretch for each
    of its bytes.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = F.octet_length("text").cast("long")
    copies = docs.groupBy("h").agg(F.count("*").alias("n"), F.max(size).alias("size"))
    copies = stored(copies.where((F.col("n") > 1) & (F.col("size") >= length)), "copies")
    total = docs.count()
    hot = [r.h for r in copies.where(F.col("n") > max(2, total * HOT_PART)).select("h").collect()]  # a thousand at most
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)

    texts = docs.where(size >= length)
    anchors = _stretch_rows(texts, length, gram).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    met = _stretch_rows(texts, length, gram).join(anchors.select("anchor"), "anchor")
    met = stored(met.distinct(), "stretches")
    kinds = met.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("h", "place")).alias("holder"))
    kinds = stored(kinds, "stretch-kinds")
    variety = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    compared = kinds.join(variety, "anchor")

    # one exchange of the texts serves the stretches to fetch and the result
    reps = docs.where(is_hot).groupBy("h").agg(F.first("text").alias("text"))
    dealt = docs.where(~is_hot).select("doc_id", "h", "text", F.lit(False).alias("spare"))
    spare = reps.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "h", "text", F.lit(True).alias("spare"))
    dealt = dealt.unionByName(spare).repartition(partitions(docs.sparkSession), "h")

    wanted = compared.groupBy(F.col("holder.h").alias("h")).agg(
        F.collect_list(F.struct("anchor", "content", "holder.place", "kinds")).alias("wanted")
    )
    pieces = _pieces(dealt.join(wanted, "h"), length)
    sorted_runs = _sorted(pieces.where(F.col("kinds") <= crowded), length)
    counted = _counted(pieces.where(F.col("kinds") > crowded), length)
    runs = sorted_runs.unionByName(counted)  # content, lo, hi: first and last repeated string of a stretch

    start, number = F.shiftright("place", 16), F.col("place").bitwiseAND(F.lit(0xFFFF))
    several = kinds.where("n > 1").select("content", F.lit(0).cast("long").alias("lo"), F.lit(1 << 16).cast("long").alias("hi"))
    spans = met.join(runs.unionByName(several), "content")
    spans = spans.select("h", (start + F.col("lo")).alias("lo"), (start + F.least(F.col("hi"), number - 1) + length).alias("hi"))
    spans = spans.union(copies.select("h", F.lit(0).cast("long"), "size"))
    spans = spans.groupBy("h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    result = _cut(dealt.join(spans, "h", "left").where("not spare"))
    whole = docs.where(is_hot).select(
        "doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"),
    )
    return result.unionByName(whole)


def _pieces(asked: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted stretches; of equal texts, one gives them."""
    names = ["anchor", "content", "kinds", "number", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                raw = text.encode()
                for w in wanted:
                    start, n = w["place"] >> 16, w["place"] & 0xFFFF
                    rows.append((w["anchor"], w["content"], w["kinds"], n, raw[start : start + n - 1 + length]))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    asked = asked.select("doc_id", "spare", "text", "wanted")
    return asked.mapInArrow(run, "anchor long, content long, kinds long, number long, piece binary")


def _sorted(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated strings of stretches that meet by anchor, as runs of positions."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        starts = repeated_starts([h[3] for h in held], [h[2] for h in held], length)
        for (_, content, _, _), found in zip(held, starts):
            if len(found):
                cut = np.flatnonzero(np.diff(found) > 1)
                for lo, hi in zip(np.append(0, cut + 1), np.append(cut, len(found) - 1)):
                    rows.append((content, found[lo], found[hi]))
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["content", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size, last = [], [], 0, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("anchor", "content", "number", "piece")]
            for row in zip(*cols):
                if row[0] != last:
                    held += group
                    group, last = [], row[0]
                    if size > SORTED_BYTES:
                        yield solve(held)
                        held, size = [], 0
                if group and group[-1][1] == row[1]:
                    continue  # from a copy of the text
                group.append(row)
                size += len(row[3])
        if held or group:
            yield solve(held + group)

    n = partitions(pieces.sparkSession)
    met = pieces.select("anchor", "content", "number", "piece").repartition(n, "anchor").sortWithinPartitions("anchor", "content")
    return met.mapInArrow(run, "content long, lo long, hi long")


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """The same for crowded anchors: every string by two hashes, met with its like by one sort over all different stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = ta.utf8(b.column("piece"))
            number = b.column("number").to_numpy()
            at_of = np.repeat(at[:-1], number)
            lo = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            start = at_of + lo
            one = ta.hashes(data, start, start + length, fold=False)
            two = ta.hashes(data, start, start + length // 2, fold=False)
            content = np.repeat(b.column("content").to_numpy(), number)
            arrays = [one.view(np.int64), two.view(np.int64), content, lo]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["one", "two", "content", "lo"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last, said = ["one", "two", "content", "lo"], np.zeros((4, 0), np.int64), True
        for b in batches:
            rows = np.stack([b.column(c).to_numpy() for c in names])
            rows = np.concatenate([last, rows], axis=1)
            new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))
            rows, k = rows[:, new], last.shape[1]  # without copies; the first row may be of the batch before
            like = (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)
            met = np.append(False, like) | np.append(like, False)
            if k and said:
                met[0] = False  # given with the batch before
            yield pa.RecordBatch.from_arrays([pa.array(rows[i, met]) for i in (2, 3, 3)], ["content", "lo", "hi"])
            said = bool(met[-1]) or (said and k > 0 and rows.shape[1] == 1)
            last = rows[:, -1:].copy()

    strings = pieces.select("content", "number", "piece").mapInArrow(run, "one long, two long, content long, lo long")
    dealt = strings.repartition(partitions(pieces.sparkSession), "one", "two")
    return dealt.sortWithinPartitions("one", "two", "content", "lo").mapInArrow(repeated, "content long, lo long, hi long")


def _cut(joined: DataFrame) -> DataFrame:
    id_type = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                raw, kept, at, removed, n = text.encode(), hashlib.sha256(), 0, 0, 0
                end = -1
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if lo > end:
                        kept.update(raw[at:lo])
                        n += 1
                        removed -= lo
                    else:
                        removed -= end
                    end = max(end, hi)
                    removed += end
                    at = end
                kept.update(raw[at:])
                rows.append((len(raw), removed, n, kept.hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    asked = joined.select("doc_id", "spare", "text", "spans")
    return asked.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
