"""Packing whole documents into fixed windows at target proportions of their sources.

Deficit round-robin in units of ``slot`` tokens. Each source is a queue of tokens. A round
fills one window; in it, a source earns its share of the window and may hand out a slot
whenever it has earned one. What it has earned beyond that is its deficit and is carried on.
The round in which slot k of a source goes out is therefore ceil((k + 1) * slot / share), so
no task has to walk the windows: partitions cut their documents into slots by themselves,
slots are numbered across partitions by a running sum of their counts, the round follows, and
the order of rounds gives every slot its place. Deficits are carried over windows and
partitions alike, as the number of a slot counts those of all partitions before.

A source's last, unfilled slot of each partition goes into extra windows, whole.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinelink.llm import textarrays as ta
from brinelink.llm.common import stored
from brinelink.llm.token_counts import tokenizer_of

WINDOW = 2048
SLOT = 128
#: Slots that one task orders.
SLOTS_PER_BUCKET = 100_000
#: Pieces that a Python worker remembers, up to twice.
REMEMBERED = 300_000
#: Words that are coded in one text.
JOINED = 1000

# also a zero byte, which marks first pieces below
_not_a_cut = re.compile(r" (?:[\s\x00]|$)")
_word_and_symbols = re.compile(r"(\x00?\w*[^\W\d_])([^\w\s\x00]+)")
_ids: dict[str, ta.Memory] = {}
_marked: dict[tuple[str, str], np.ndarray] = {}


def _parts(piece: str) -> list[str]:
    """A piece at further places where every byte-level pre-tokeniser cuts.

    These are a single line break between visible characters, and the step from a letter to symbols up to the end.
    """
    # most are a word and its punctuation, perhaps with the next line's first word
    line, broken, after = piece.partition("\n")
    word = line.rstrip(punctuation)
    if word.isalpha() and (after.isalpha() or not broken):
        out = [word, "\x00" + line[len(word) :]] if len(word) < len(line) else [word]
        return [*out, "\x00\n", "\x00" + after] if broken else out
    lines = piece.split("\n") if "\n" in piece else [piece]
    if len(lines) > 1 and not all(x.strip("\x00") and not x[0].isspace() and not x[-1].isspace() for x in lines):
        return [piece]
    out = []
    for i, line in enumerate(lines):
        if i:
            out.append("\x00\n")
            line = "\x00" + line
        m = _word_and_symbols.fullmatch(line)
        out += [line[: m.end(1)], "\x00" + m[2]] if m else [line]
    return out


def _word_ids(words: list[str], mark: str, spec: str) -> list[bytes]:
    """Ids of words of letters alone, coded many in one text.

    ``mark`` stands before each: a space, which belongs to the word, or a line break, which does not. No word holds either, so the
    ids of each begin with the mark.
    """
    tokenizer = tokenizer_of(spec)
    if (spec, mark) not in _marked:
        byte = "\u0120" if mark == " " else "\u010a"  # as byte-level vocabularies write them
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        _marked[spec, mark] = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        _marked[spec, mark][[i for token, i in vocabulary.items() if token[:1] == byte]] = True
    skip = int(mark != " ")
    groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
    out: list[bytes] = []
    for group, coded in zip(groups, tokenizer.encode_batch_fast([mark + mark.join(g) for g in groups], add_special_tokens=False)):
        ids = np.array(coded.ids, np.uint32)
        at = np.flatnonzero(_marked[spec, mark][ids])
        if len(at) == len(group) and at[0] == 0:
            data, ends = ids.tobytes(), np.append(at, len(ids)) * 4
            out += [data[a:b] for a, b in zip((ends[:-1] + 4 * skip).tolist(), ends[1:].tolist())]
        else:  # not a byte-level vocabulary
            alone = tokenizer.encode_batch_fast([w if skip else mark + w for w in group], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in alone]
    return out


def text_ids(texts: list[str], spec: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers.

    A byte-level pre-tokeniser always cuts before a space that a visible character follows, so a text is
    cut there and the ids of the pieces are remembered.
    """

    def code(new: list[str], known: dict[str, bytes]) -> None:
        mixed = [p for p in new if not p.isalpha()]
        split = [_parts(p) for p in mixed]
        pieces = [c for c in set().union(*split, filter(str.isalpha, new)) if c not in known]
        words = list(filter(str.isalpha, pieces))
        known.update(zip(words, _word_ids(words, " ", spec)))
        pieces = [p for p in pieces if not p.isalpha()]
        words = [p for p in pieces if p[:1] == "\x00" and p[1:].isalpha()]
        known.update(zip(words, _word_ids([p[1:] for p in words], "\n", spec)))
        pieces = [c for c in pieces if c not in known]
        whole = [p[1:] if p[:1] == "\x00" else " " + p for p in pieces]
        coded = tokenizer_of(spec).encode_batch_fast(whole, add_special_tokens=False)
        known.update((p, array("I", e.ids).tobytes()) for p, e in zip(pieces, coded))
        known.update((p, b"".join(map(known.__getitem__, c))) for p, c in zip(mixed, split) if len(c) > 1)

    cut: list[list[str]] = []
    for text in texts:
        pieces = text.split(" ")
        # a mark in front keeps apart the first piece, which has no space before it
        pieces[0] = "\x00" + pieces[0]
        if _not_a_cut.search(text):
            merged = pieces[:1]
            for p in pieces[1:]:
                if not p or p[0].isspace() or p[0] == "\x00":
                    merged[-1] += " " + p
                else:
                    merged.append(p)
            pieces = merged
        cut.append(pieces)
    return list(map(b"".join, _ids.setdefault(spec, ta.Memory(REMEMBERED)).results(cut, code)))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = 1,
    window: int = WINDOW,
    slot: int = SLOT,
    targets: dict[str, float] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``targets`` names the share of some sources; the others keep, among themselves, their
    share of the tokens. Without it every source keeps its share of the corpus. A source
    that is used up leaves its part of later windows to the others.

    Null text is an empty document, which is its end id alone. A null source is a queue of
    its own. Repeated rows are packed each. Other columns are not read. No rows give none.
    """
    if window % slot:
        raise ValueError("window must be a multiple of slot")
    pieces = stored(_pieces(docs, tokenizer_path, end_id, slot), "pieces")
    per_window = window // slot

    # tokens of each queue in each partition: small, one row per queue and input split
    totals = pieces.groupBy("queue", "pid").agg(F.sum("length").alias("t"))
    totals = totals.withColumn("full", F.floor(F.col("t") / slot).cast("long"))
    before = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("queue", "pid", "full", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("base"))
    totals = stored(totals, "queues")
    queues = totals.groupBy("queue").agg(F.sum("full").alias("n"))
    n_slots = totals.agg(F.sum("full")).first()[0] or 0
    queues = queues.withColumn("share", _share(F.col("queue"), targets, n_slots, queues))

    numbered = pieces.join(totals, ["queue", "pid"])
    filled = numbered.where("slot < full").join(queues.select("queue", "share"), "queue")
    filled = filled.withColumn("k", F.col("base") + F.col("slot"))
    earned = (F.col("k") + 1).cast("double") / (F.col("share") * per_window)
    filled = filled.withColumn("round", F.ceil(F.round(earned, 6)).cast("long"))
    step = max(1, SLOTS_PER_BUCKET // per_window)
    filled = filled.withColumn("bucket", F.floor(F.col("round") / step).cast("long"))

    # slots before each bucket of rounds: one row per hundred thousand slots
    counts = filled.where("at = 0").groupBy("bucket").agg(F.count("*").alias("slots"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", F.coalesce(F.sum("slots").over(running), F.lit(0)).alias("earlier"))
    order = Window.partitionBy("bucket").orderBy("round", "queue", "k", "at").rowsBetween(Window.unboundedPreceding, 0)
    placed = filled.withColumn("i", F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).over(order)).join(counts, "bucket")
    i = F.col("i") + F.col("earlier") - 1
    placed = placed.select(
        "doc_id",
        "source",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.floor(i / per_window).cast("long").alias("sequence_id"),
        (F.pmod(i, F.lit(per_window)) * slot + F.col("at")).cast("long").alias("offset"),
    )
    return placed.unionByName(_tails(numbered, totals, -(-n_slots // per_window), per_window))


def _share(queue: Column, targets: dict[str, float] | None, n_slots: int, queues: DataFrame) -> Column:
    corpus = F.col("n") / F.lit(max(n_slots, 1))
    if not targets:
        return corpus
    named = list(targets)
    rest = queues.where(~F.col("queue").isin([f"s{x}" for x in named])).agg(F.sum("n")).first()[0] or 0
    spare = max(0.0, 1 - sum(targets.values()))
    out = F.col("n") / F.lit(max(rest, 1)) * F.lit(spare or 1e-9)
    for name, share in targets.items():
        out = F.when(queue == f"s{name}", F.lit(float(share))).otherwise(out)
    return out


def _pieces(docs: DataFrame, tokenizer_path: str, end_id: int, slot: int) -> DataFrame:
    """Documents cut where a slot of their queue in this partition is full."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: a few MB, whatever the input
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    queue = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    docs = docs.select("doc_id", source.alias("source"), queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, source string, queue string, start long, length long, ids_crc32 long, "
        "doc_tokens long, pid long, slot long, at long"
    )
    end = end_id.to_bytes(4, "little")
    kinds = [pa.int32()] + [pa.int64()] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pid = TaskContext.get().partitionId()
        reached: dict[str, int] = {}  # tokens so far, of each source in this partition
        for b in batches:
            for part in ta.blocks(b):
                ids = text_ids(part.column("text").to_pylist(), spec.value)
                rows = []
                for row, (q, doc) in enumerate(zip(part.column("queue").to_pylist(), ids)):
                    data = memoryview(doc + end)
                    n, t, start = len(data) // 4, reached.get(q, 0), 0
                    while start < n:
                        k, at = divmod(t, slot)
                        size = min(slot - at, n - start)
                        crc = zlib.crc32(data[start * 4 : (start + size) * 4])
                        rows.append((row, start, size, crc, n, pid, k, at))
                        start, t = start + size, t + size
                    reached[q] = t
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                same = [part.column(c).take(cols[0]) for c in ("doc_id", "source", "queue")]
                yield pa.RecordBatch.from_arrays(
                    same + cols[1:],
                    ["doc_id", "source", "queue", "start", "length", "ids_crc32", "doc_tokens", "pid", "slot", "at"],
                )

    return docs.mapInArrow(run, schema)


def _tails(numbered: DataFrame, totals: DataFrame, first: int, per_window: int) -> DataFrame:
    """Pieces of unfilled slots, ``per_window`` slots to a window, which always fit."""
    tails = numbered.where("slot >= full")
    per_pid = tails.where("at = 0").groupBy("pid").agg(F.count("*").alias("c"))
    running = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per_pid = per_pid.select("pid", F.coalesce(F.sum("c").over(running), F.lit(0)).alias("earlier"))
    order = Window.partitionBy("pid").orderBy("queue", "at").rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumn("i", F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).over(order)).join(per_pid, "pid")
    tails = tails.withColumn("j", F.col("i") + F.col("earlier") - 1)
    tails = tails.withColumn("sequence_id", F.floor(F.col("j") / per_window).cast("long") + F.lit(first))
    run = Window.partitionBy("sequence_id").orderBy("j", "at").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("offset", F.coalesce(F.sum("length").over(run), F.lit(0)).cast("long"))
    return tails.select(
        "doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
