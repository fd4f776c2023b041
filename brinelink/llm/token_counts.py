"""Token counts of whole texts, also of texts too large to encode in one go.

A text of more than ``chunk_chars`` characters becomes overlapping chunks, each a row of its
own, encoded with offsets anywhere on the cluster. Neighbouring chunks are spliced at a
position where both have the start of a pre-token. Such a position is proven to be a true
one: pre-tokenisers read from left to right and look ahead a little, so

* the left chunk, right from its own splice on, is right up to a margin before its end;
* from a common start on, the right chunk reads the same characters from the same state;
* the character there is ASCII, which never joins a preceding one in normalisation.

If the overlap has no such position it is widened eightfold, and a text without any is
encoded whole in the end, so the count is always the library's own.

Short texts are cut at ASCII white space, where both pre-tokeniser and normaliser are known
to cut, and the counts of the pieces are remembered per Python worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinelink.llm import textarrays as ta
from brinelink.llm.common import partitions, stored

#: Pieces that a Python worker remembers, up to twice.
REMEMBERED = 300_000
#: Characters near the ends of a chunk whose pre-tokens may depend on what was cut off.
MARGIN = 16

_word_and_symbols = re.compile(rb"([A-Za-z0-9]*[A-Za-z])([!-/:-@\[-`{-~]+)")
_loaded: dict[str, object] = {}
_counts: dict[str, ta.Memory] = {}


def tokenizer_of(spec: str):
    """The tokenizer of a JSON text, loaded once per Python worker, without truncation or padding."""
    if spec not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(spec)
        tok.no_truncation()
        tok.no_padding()
        _loaded[spec] = tok
    return _loaded[spec]


def count_short(texts: list[str], spec: str) -> list[int]:
    """Counts by pieces between ASCII white space."""

    def code(new: list[bytes], known: dict[bytes, int]) -> None:
        # from a letter to symbols up to the end there is always a cut
        split = [m.groups() if (m := _word_and_symbols.fullmatch(p)) else (p,) for p in new]
        whole = [c for c in set().union(*split) if c not in known]
        coded = tokenizer_of(spec).encode_batch_fast([p.decode() for p in whole], add_special_tokens=False)
        known.update(zip(whole, map(len, coded)))
        known.update((p, known[c[0]] + known[c[1]]) for p, c in zip(new, split) if len(c) > 1)

    pieces = [t.encode().split() for t in texts]
    return list(map(sum, _counts.setdefault(spec, ta.Memory(REMEMBERED)).results(pieces, code)))


def encode_chunk(text: str, start: int, left: tuple[int, int], right: tuple[int, int], spec: str):
    """Tokens of a chunk and, in two zones of text positions, the pre-token starts with the tokens before each."""
    enc = tokenizer_of(spec).encode(text, add_special_tokens=False)
    offsets, words = enc.offsets, enc.word_ids
    zones: list[tuple[list[int], list[int]]] = [([], []), ([], [])]
    for j, (p, _) in enumerate(offsets):
        at = start + p
        for (lo, hi), (pos, before) in zip((left, right), zones):
            if lo <= at < hi and (j == 0 or words[j] != words[j - 1] or words[j] is None) and text[p].isascii():
                if not pos or pos[-1] != at:
                    pos.append(at)
                    before.append(j)
    return len(offsets), *zones[0], *zones[1]


def token_counts(
    docs: DataFrame, tokenizer_path: str, *, chunk_chars: int = 32_768, overlap_chars: int = 256
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, n_chunks.

    Null text counts as empty: no bytes, no tokens. Rows are independent, so repeated rows
    and null ids give a row each. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary: a few MB, whatever the input
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = F.octet_length("text").cast("long").alias("n_bytes")
    # the length in bytes bounds that in characters and costs nothing
    is_long = (F.octet_length("text") > chunk_chars) & (F.char_length("text") > chunk_chars)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in ta.blocks(batch)):
            counts = pa.array(count_short(b.column("text").to_pylist(), spec.value), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), counts, pa.array([1] * len(counts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "n_chunks"],
            )

    out_schema = f"doc_id {id_type}, n_bytes long, n_tokens long, n_chunks long"
    shorts = docs.where(~is_long).select("doc_id", size, "text").mapInArrow(short, out_schema)

    key = ["doc_id", "n_bytes", "content"]
    longs = docs.where(is_long).select("doc_id", size, F.xxhash64("text").alias("content"), "text")
    result = None
    waiting = None
    overlap = overlap_chars
    while True:
        source = longs.withColumn("uid", F.monotonically_increasing_id())
        if waiting is not None:
            # null-safe, as the id may be null; one row for each repeated one
            cond = longs.doc_id.eqNullSafe(waiting.doc_id) & (longs.content == waiting.content)
            source = longs.join(waiting.select("doc_id", "content").distinct(), cond, "left_semi").dropDuplicates(key)
            source = source.withColumn("uid", F.monotonically_increasing_id())
        whole = overlap * 2 > chunk_chars
        spliced = stored(_spliced(source, spec, chunk_chars, overlap, whole, id_type), "token-chunks")
        done = spliced.where("n_tokens is not null")
        if waiting is not None:
            d = done.select("doc_id", "content", "n_tokens", "n_chunks")
            w = waiting.select("doc_id", "n_bytes", "content")
            done = w.join(d, w.doc_id.eqNullSafe(d.doc_id) & (w.content == d.content)).select(w["*"], "n_tokens", "n_chunks")
            left = w.join(d, w.doc_id.eqNullSafe(d.doc_id) & (w.content == d.content), "left_anti")
        else:
            left = spliced.where("n_tokens is null").select(*key)
        done = done.select("doc_id", "n_bytes", "n_tokens", "n_chunks")
        result = done if result is None else result.unionByName(done)
        if whole or left.isEmpty():
            return shorts.unionByName(result)
        waiting = stored(left, "token-waiting")
        overlap *= 8


def _spliced(source: DataFrame, spec, chunk: int, overlap: int, whole: bool, id_type: str) -> DataFrame:
    """A row per text with its count, which is null if some neighbouring chunks have no common start."""
    n = F.ceil(F.char_length("text") / chunk).cast("int")
    first = F.lit(1) if whole else n
    k = F.explode(F.sequence(F.lit(0), first - 1)).alias("k")
    rows = source.select("uid", "doc_id", "n_bytes", "content", first.alias("n_chunks"), k, "text")
    begin = F.greatest(F.col("k") * chunk - overlap, F.lit(0))
    cut = F.col("text") if whole else F.substring("text", begin + 1, (F.col("k") + 1) * chunk + overlap - begin)
    rows = rows.select("uid", "doc_id", "n_bytes", "content", "n_chunks", "k", begin.alias("begin"), cut.alias("part"))
    rows = rows.repartition(partitions(source.sparkSession), "uid", "k")
    schema = (
        f"uid long, doc_id {id_type}, n_bytes long, content long, n_chunks int, k int, total long, "
        "l_pos array<int>, l_before array<int>, r_pos array<int>, r_before array<int>"
    )
    kept = ["uid", "doc_id", "n_bytes", "content", "n_chunks", "k"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in ta.blocks(batch, "part")):
            found = []
            for k, start, text in zip(*(b.column(c).to_pylist() for c in ("k", "begin", "part"))):
                lo, hi = k * chunk, (k + 1) * chunk
                left = (lo - overlap + MARGIN, lo + overlap - MARGIN) if k else (0, 0)
                found.append(encode_chunk(text, start, left, (hi - overlap + MARGIN, hi + overlap - MARGIN), spec.value))
            cols = list(zip(*found)) if found else [[]] * 5
            arrays = [pa.array(cols[0], pa.int64())] + [pa.array(c, pa.list_(pa.int32())) for c in cols[1:]]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept] + arrays, kept + ["total", "l_pos", "l_before", "r_pos", "r_before"]
            )

    w = Window.partitionBy("uid").orderBy("k")  # one text's chunks: small rows
    last = F.col("k") == F.col("n_chunks") - 1
    p = F.element_at(F.array_sort(F.array_intersect("r_pos", F.col("next_pos"))), F.lit(1))
    met = F.size(F.array_intersect("r_pos", F.col("next_pos"))) > 0
    c = rows.mapInArrow(encode, schema).withColumn("next_pos", F.lead("l_pos").over(w))
    c = c.withColumn("p", F.when(~last & met, p))
    c = c.withColumn("from", F.lag("p").over(w))
    at = lambda pos, before, x: F.element_at(before, F.array_position(pos, x).cast("int"))
    end = F.when(last, F.col("total")).otherwise(F.when(F.col("p").isNotNull(), at("r_pos", F.col("r_before"), F.col("p"))))
    start = F.when(F.col("k") == 0, F.lit(0)).otherwise(
        F.when(F.col("from").isNotNull(), at("l_pos", F.col("l_before"), F.col("from")))
    )
    c = c.select("uid", "doc_id", "n_bytes", "content", "n_chunks", (end - start).alias("n"))
    return c.groupBy("uid", "doc_id", "n_bytes", "content").agg(
        F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"),
        F.max("n_chunks").cast("long").alias("n_chunks"),
    )
