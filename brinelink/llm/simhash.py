"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit position i of a fingerprint gets a vector c(i) of radius + 1 bits. For every non-zero v
of as many bits, mask v keeps the positions where the dot product of c(i) and v is odd. Any ``radius``
positions span less than the whole space, so some v is orthogonal to all of them: in that
table the masked fingerprints of a pair within the radius are equal. Nothing is missed by chance.

Equal fingerprints are one node. A small bucket is compared pair by pair. A large one is linked
through its members' neighbours at half the radius: two fingerprints at most 2h apart have a
common neighbour within h of each, and all that share such a neighbour are within 2h of each
other, so a star per neighbour gives the same components with a number of rows that grows
with the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelink.llm.common import components, stored

RADIUS = 2
#: A bucket of more distinct fingerprints is linked through common neighbours.
PAIRWISE = 32


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority of the bits of all shingle hashes; fewer words: the whole sequence; none: zero."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles: Iterator[bytes] | list[bytes] = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, len(hashes), 65_536):  # bounded memory for a very long text
        block = hashes[s : s + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask per table. The vectors c(i) run through the non-zero ones in turn, so masks are balanced."""
    kinds = 2 ** (radius + 1) - 1
    vector = [1 + i % kinds for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, kinds + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) that connect exactly what links of at most ``radius`` bits connect, over distinct ``fp``."""
    if radius % 2 or not radius:
        raise ValueError("the radius must be even and positive")
    tables = F.explode(
        F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(masks(radius))])
    )
    entries = prints.select("fp", tables.alias("x")).select("fp", "x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    sizes = entries.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(entries.join(sizes, ["t", "key"]), "covering")
    a, b = met.where(F.col("n") <= pairwise).alias("a"), met.where(F.col("n") <= pairwise).alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    pairs = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = pairs.where(near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    flips = [0] + [
        sum(1 << i for i in which) for h in range(1, radius // 2 + 1) for which in combinations(range(64), h)
    ]
    crowded = met.where(F.col("n") > pairwise).select("fp").distinct()
    flip = F.explode(F.array(*[F.lit(_signed(x)) for x in flips]))
    around = crowded.select("fp", flip.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    hubs = around.groupBy("hub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("hub", "b")
    stars = around.join(hubs, "hub").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, group, content.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing
    bits, the document's own included; null ids are passed over, and it is null where none
    is known. ``group`` numbers the components and ``content`` is a key of id and text.
    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows give a row each; other columns are not read; no rows give none.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("content"), pa.array(fps, pa.int64())], ["doc_id", "content", "fp"]
            )

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("content"))
    rows = rows.mapInArrow(prints, f"doc_id {id_type}, content long, fp long")
    rows = stored(rows, "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = components(links(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    known = firsts.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    # a fingerprint of very many documents is one small row here, and the join on it may be split
    ids = known.select("fp", "component").join(smallest, "component").select("fp", "component_id", F.col("component").alias("group"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(ids, "fp").select("doc_id", digits, "component_id", "group", "content")
