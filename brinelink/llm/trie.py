"""Shared beginnings of conversations, as a z-fast trie in tables.

The prefix of a conversation after d turns is known by a signature: the exclusive or of 128 bits of the SHA-256 of each
turn with its place. Running sums within blocks of turns and over blocks give those of all prefixes, so a conversation of any
length is spread over tasks. A trie is a table of compacted nodes, those where a conversation ends or branches. The edge
into a node covers the depths after its parent's up to its own, and a node is filed under its handle: the depth on its edge that is divisible
by the highest power of two, with the signature there.

Conversations that are equal as a whole are one string. Strings are inserted in batches. A batch finds its exit
nodes by fat binary search: each round probes the handle table at the two-fattest depth that is left, so a string that the
trie holds already costs a lookup for each bit of its length and none of its turns is moved. A binary search gives
the depth where it leaves the edge. Edges are split there, and only the turns behind are grouped, compacted and filed.

Sums over subtrees double the distance that they reach in each round. In the end edges are
expanded to a row for each depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinelink.llm.common import dropped, stored
from brinelink.llm.variants import crc32_sql

#: Turns of one conversation that are numbered and summed in one task at least.
BLOCK = 4096
#: Conversation ids that are joined to one text before they are hashed in order.
IDS = 512
#: Batches in which strings are inserted: the first two alike, each further one as large as all before.
BATCHES = 2
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

ROOT = (0, 0, 0)


def _long(x: int | None) -> Column:
    return F.lit(x).cast("long")


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns in order: conv_id, at (from 0), role, text; nulls become empty, ties go by role and text.

    A turn is numbered within a range of turn numbers and the ranges before are added, so the turns of a long
    conversation are sorted in many tasks.
    """
    empty = F.lit("")
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), _long(-(1 << 62))))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    shift = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), _long(0)).alias("shift"))
    local = turns.withColumn("local", F.row_number().over(order) - 1)
    return local.join(shift, ["conv_id", "block"]).select("conv_id", (F.col("local") + F.col("shift")).alias("at"), "role", "text")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: turns (conv_id, at, role, text, at from 0) and lengths (conv_id, length).

    Conversation c begins with the first h turns of conversation c - c mod ``family`` (all if there are fewer), h being crc32 of its
    decimal id mod ``most``, and goes on with its own turns after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    member = F.pmod("conv_id", _long(family))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", F.when(member == 0, _long(0)).otherwise(h).alias("h"), (F.col("conv_id") - member).alias("base"))
    bases = sizes.where(member == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", _long(0))))
    convs = stored(convs.select("conv_id", "h", "given", (F.col("given") + F.greatest(F.col("n") - F.col("h"), _long(0))).alias("length")), "conversations")
    own = turns.join(convs, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("given")).alias("at"), "role", "text")
    lent = turns.where((member == 0) & (F.col("at") < most - 1))
    lent = lent.select(F.explode(F.sequence(F.col("conv_id") + 1, F.col("conv_id") + family - 1)).alias("conv_id"), "at", "role", "text")
    lent = lent.join(convs.select("conv_id", "h"), "conv_id").where("at < h").select("conv_id", "at", "role", "text")
    return own.union(lent), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """One row per turn (conv_id, at, role, text): conv_id, d = at + 1, signature (a, b) and that without the turn (pa, pb), bytes and their sum so far."""
    framed = F.concat(F.col("at").cast("string"), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    digest = F.sha2(framed.cast("binary"), 256)
    lane = lambda x, i: F.conv(F.substring(x, i, 16), 16, -10).cast("long")
    turns = turns.select("conv_id", "at", F.octet_length("text").cast("long").alias("bytes"), digest.alias("digest"))
    turns = turns.select(
        "conv_id", "at", F.floor(F.col("at") / BLOCK).alias("block"), "bytes", lane(F.col("digest"), 1).alias("a"), lane(F.col("digest"), 17).alias("b")
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("bytes").alias("total"))
    totals = totals.select("conv_id", "block", *[f(x).over(before).alias(n) for f, x, n in ((F.bit_xor, "a", "xa"), (F.bit_xor, "b", "xb"), (F.sum, "total", "xs"))])
    local = turns.select("*", *[f(x).over(upto).alias(n) for f, x, n in ((F.bit_xor, "a", "ya"), (F.bit_xor, "b", "yb"), (F.sum, "bytes", "total"))])
    joined = local.join(totals.where("block > 0"), ["conv_id", "block"], "left")
    zero = lambda c: F.coalesce(c, _long(0))
    a, b = F.col("ya").bitwiseXOR(zero("xa")), F.col("yb").bitwiseXOR(zero("xb"))
    return joined.select(
        "conv_id",
        (F.col("at") + 1).alias("d"),
        a.alias("a"),
        b.alias("b"),
        a.bitwiseXOR(F.col("a")).alias("pa"),
        b.bitwiseXOR(F.col("b")).alias("pb"),
        "bytes",
        (F.col("total") + zero("xs")).alias("total"),
    )


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the highest power of two."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return high.bitwiseAND(F.call_function("shiftleft", _long(-1), bits))


def _at(paths: DataFrame, conv: str, d: str, a: str, b: str) -> DataFrame:
    """Signatures of prefixes under the names of a join: at depth 0 there is none, ask for it elsewhere."""
    return paths.select(F.col("conv_id").alias(conv), F.col("d").alias(d), F.col("a").alias(a), F.col("b").alias(b))


def _settled(state: DataFrame, step) -> DataFrame:
    """Rows searched until none has lo < hi; ``step`` is a round on those that have."""
    state = stored(state, "search")
    while not state.where("lo < hi").isEmpty():
        last, state = state, stored(step(state.where("lo < hi")).unionByName(state.where("lo >= hi")), "search")
        dropped(last)
    return state


def located(strings: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Where strings (x, length) leave the trie: x, length, their exit node (e, a, b) and depth m with signature (ma, mb)."""
    handles = nodes.where("e > 0").select("f", "fa", "fb", *[F.col(c).alias(f"new_{c}") for c in ("e", "a", "b", "rep")])

    def probe(state: DataFrame) -> DataFrame:
        asked = state.withColumn("f", fattest(F.col("lo"), F.col("hi"))).join(_at(paths, "x", "f", "fa", "fb"), ["x", "f"])
        asked = asked.join(handles, ["f", "fa", "fb"], "left")
        hit = F.col("new_e").isNotNull()
        kept = [F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("e", "a", "b", "rep")]
        return asked.select(
            "x",
            "length",
            F.when(hit, F.least("new_e", "hi")).otherwise(F.col("lo")).alias("lo"),
            F.when(hit, F.col("hi")).otherwise(F.col("f") - 1).alias("hi"),
            *kept,
            F.when(hit, F.col("f")).otherwise(F.col("matched")).alias("matched"),
        )

    root = [_long(v).alias(n) for v, n in zip((*ROOT, None, 0), ("e", "a", "b", "rep", "matched"))]
    found = _settled(strings.select("x", "length", _long(0).alias("lo"), F.col("length").alias("hi"), *root), probe)

    # the last hit is the exit node itself or the parent of it
    first = nodes.where("e > 0").select("p", "ca", "cb", *[F.col(c).alias(f"new_{c}") for c in ("e", "a", "b", "rep", "f")])
    whole = (F.col("e") == 0) | ((F.col("sa") == F.col("a")) & (F.col("sb") == F.col("b")))
    found = found.join(_at(paths, "x", "e", "sa", "sb"), ["x", "e"], "left").withColumn("whole", F.coalesce(whole, F.lit(False)))
    found = found.withColumn("next", F.when(F.col("whole"), F.col("e") + 1))
    found = found.join(_at(paths, "x", "next", "ca", "cb"), ["x", "next"], "left").withColumn("p", F.col("next") - 1)
    found = found.join(first, ["p", "ca", "cb"], "left")
    child = F.col("new_e").isNotNull()
    low = F.when(child, F.col("next")).when(F.col("whole"), F.col("e")).otherwise(F.col("matched"))
    high = F.when(child, F.least("new_e", "length", F.col("new_f") - 1)).when(F.col("whole"), F.col("e")).otherwise(F.least(F.col("e") - 1, "length"))
    exits = [F.when(child, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("e", "a", "b", "rep")]
    start = found.select("x", "length", low.alias("lo"), F.greatest(low, high).alias("hi"), *exits)

    def halve(state: DataFrame) -> DataFrame:
        asked = state.withColumn("mid", F.floor((F.col("lo") + F.col("hi") + 1) / 2))
        asked = asked.join(_at(paths, "x", "mid", "xa", "xb"), ["x", "mid"]).join(_at(paths, "rep", "mid", "ra", "rb"), ["rep", "mid"])
        same = (F.col("xa") == F.col("ra")) & (F.col("xb") == F.col("rb"))
        return asked.select(
            "x",
            "length",
            F.when(same, F.col("mid")).otherwise(F.col("lo")).alias("lo"),
            F.when(same, F.col("hi")).otherwise(F.col("mid") - 1).alias("hi"),
            *("e", "a", "b", "rep"),
        )

    left = _settled(start, halve).select("x", "length", "e", "a", "b", F.col("lo").alias("m"))
    left = left.join(_at(paths, "x", "m", "ma", "mb"), ["x", "m"], "left")
    return left.select("x", "length", "e", "a", "b", "m", F.coalesce("ma", _long(0)).alias("ma"), F.coalesce("mb", _long(0)).alias("mb"))


def _filed(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes (e, a, b, p, pa, pb, rep) with handle (f, fa, fb) and the signature at the first depth of the edge (ca, cb)."""
    asked = nodes.withColumn("f", fattest(F.col("p"), F.col("e"))).withColumn("first", F.col("p") + 1)
    asked = asked.join(_at(paths, "rep", "f", "fa", "fb"), ["rep", "f"]).join(_at(paths, "rep", "first", "ca", "cb"), ["rep", "first"])
    return asked.select("e", "a", "b", "p", "pa", "pb", "rep", "f", "fa", "fb", "ca", "cb")


def inserted(strings: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The trie with distinct strings (x, length, a, b) added; a string is the conversation x, which has it in ``paths``."""
    found = stored(located(strings.select("x", "length"), nodes, paths), "exits")
    edges = ["e", "a", "b"]

    # edges are split where strings leave them
    splits = found.where("m < e").select(*edges, "m", "ma", "mb").distinct()
    cut = splits.join(nodes.select(*edges, "p", "pa", "pb", "rep"), edges)
    along = Window.partitionBy(*edges).orderBy("m")
    above = [F.coalesce(F.lag(c).over(along), F.col(d)).alias(d) for c, d in (("m", "p"), ("ma", "pa"), ("mb", "pb"))]
    upper = cut.select(F.col("m").alias("e"), F.col("ma").alias("a"), F.col("mb").alias("b"), *above, "rep")
    lowest = splits.groupBy(*edges).agg(F.max(F.struct("m", "ma", "mb")).alias("x"))
    lower = nodes.join(lowest, edges).select(*edges, F.col("x.m").alias("p"), F.col("x.ma").alias("pa"), F.col("x.mb").alias("pb"), "rep")

    # of what is behind, branching nodes and ends are kept
    behind = found.select(F.col("x").alias("conv_id"), "m", "ma", "mb")
    tails = stored(paths.join(behind, "conv_id").where("d > m").select("conv_id", "d", "a", "b", "pa", "pb", "m", "ma", "mb"), "tails")
    fresh = tails.groupBy("d", "a", "b").agg(F.first("pa").alias("pa"), F.first("pb").alias("pb"))
    kids = fresh.groupBy((F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n")).where("n > 1")
    marked = kids.select("d", "a", "b").union(strings.select(F.col("length").alias("d"), "a", "b")).distinct()
    before = Window.partitionBy("conv_id").orderBy("d")
    above = [F.coalesce(F.lag(c).over(before), F.col(d)).alias(n) for c, d, n in (("d", "m", "p"), ("a", "ma", "pa"), ("b", "mb", "pb"))]
    linked = tails.drop("pa", "pb").join(marked, ["d", "a", "b"]).select("conv_id", F.col("d").alias("e"), "a", "b", *above)
    below = linked.groupBy(*edges).agg(F.min(F.struct("conv_id", "p", "pa", "pb")).alias("x"))
    below = below.select(*edges, "x.p", "x.pa", "x.pb", F.col("x.conv_id").alias("rep"))

    same = nodes.join(splits.select(*edges).distinct(), edges, "left_anti")
    grown = stored(same.unionByName(_filed(upper.unionByName(lower).unionByName(below), paths)), "trie")
    dropped(tails)
    dropped(found)
    return grown


def subtree(nodes: DataFrame, sums: list[str], least: list[str]) -> DataFrame:
    """Nodes (k, up: key of the parent, null at the root) with columns summed, or the least taken, over their subtrees.

    After a round a node has all below it to twice the distance, so chains take log2 of their length.
    """
    state = stored(nodes.select("k", "up", *sums, *least), "subtree")
    while not state.where("up is not null").isEmpty():
        more = [F.sum(c).alias(f"m_{c}") for c in sums] + [F.min(c).alias(f"m_{c}") for c in least]
        give = state.where("up is not null").groupBy(F.col("up").alias("k")).agg(*more)
        # pointers past the root are settled, and only the others are joined
        ahead = state.where("up is not null").select(F.col("k").alias("up"), F.col("up").alias("further"))
        new = [(F.col(c) + F.coalesce(f"m_{c}", _long(0))).alias(c) for c in sums] + [F.least(c, f"m_{c}").alias(c) for c in least]
        grown = state.join(give, "k", "left").join(ahead, "up", "left")
        last, state = state, stored(grown.select("k", F.col("further").alias("up"), *new), "subtree")
        dropped(last)
    return state.select("k", *sums, *least)


def _hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, in order and joined by commas: e, a, b, ends_sha256.

    Ids are joined to texts of ``IDS`` numbers first. A hash is made in order, so the texts of a node pass through one task, one by one.
    """
    block = F.floor(F.col("conv_id") / IDS).alias("block")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = ends.groupBy("e", "a", "b", block).agg(joined.alias("ids"))
    parts = parts.repartition("e", "a", "b").sortWithinPartitions("e", "a", "b", "block").drop("block")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["e", "a", "b", "ends_sha256"]
        key, made = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*[batch.column(c).to_pylist() for c in ("e", "a", "b", "ids")]):
                if k != key:
                    if key is not None:
                        out.append((*key, made.hexdigest()))
                    key, made = k, hashlib.sha256()
                else:
                    made.update(b",")
                made.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, made.hexdigest())], names)

    return parts.mapInArrow(digests, "e long, a long, b long, ends_sha256 string")


def _key(e: str, a: str, b: str) -> Column:
    return F.struct(F.col(e).alias("e"), F.col(a).alias("a"), F.col(b).alias("b"))


def prefix_trie(turns: DataFrame, lengths: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per different beginning of the conversations ``turns`` (conv_id, at, role, text; at from 0 without gaps).

    ``lengths`` (conv_id, length) lists the conversations, also those without turns. Columns, all long but the last: conv_id
    (smallest conversation with the beginning), depth (its turns), parent_conv_id (that of the beginning without its last turn, null at
    depth 0), n_convs, n_children (beginnings a turn longer), n_leaves (beginnings in its subtree, itself
    included, that none goes on from), saved_tokens (over its subtree, each beginning's (n_convs - 1) times the bytes of its last text),
    ends_sha256 (of the ids of conversations that end here, ascending, joined by commas; of the empty text if none does).
    No conversations give no rows.
    """
    paths = stored(prefixes(turns), "paths")
    ends = lengths.join(paths.select("conv_id", F.col("d").alias("length"), "a", "b"), ["conv_id", "length"], "left")
    ends = stored(ends.select("conv_id", F.col("length").alias("e"), F.coalesce("a", _long(0)).alias("a"), F.coalesce("b", _long(0)).alias("b")), "ends")
    if ends.isEmpty():
        return _expanded(paths, *_empty(ends))
    # conversations that are equal as a whole are one string
    strings = ends.where("e > 0").groupBy("e", "a", "b").agg(F.min("conv_id").alias("x"))
    strings = stored(strings.select("x", F.col("e").alias("length"), "a", "b"), "strings")
    root = zip((*ROOT, None, None, None, None, 0, 0, 0, None, None), ("e", "a", "b", "p", "pa", "pb", "rep", "f", "fa", "fb", "ca", "cb"))
    nodes = stored(ends.sparkSession.range(1).select(*[_long(v).alias(n) for v, n in root]), "trie")
    share = F.pmod(F.xxhash64("a", "b"), _long(1 << (batches - 1)))
    for i in range(batches):
        part = strings.where((share >= (1 << i >> 1)) & (share < (1 << i)))
        last, nodes = nodes, inserted(part, nodes, paths)
        dropped(last)
    return _expanded(paths, nodes, ends)


def _empty(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = ("e", "a", "b", "p", "pa", "pb", "rep", "f", "fa", "fb", "ca", "cb")
    return ends.where("false").select(*[_long(None).alias(n) for n in names]), ends


def _expanded(paths: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    here = ends.groupBy("e", "a", "b").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    hashes = _hashes(ends)
    children = nodes.where("p is not null").groupBy(F.col("p").alias("e"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    total = paths.select(F.col("conv_id").alias("rep"), F.col("d").alias("e"), F.col("total").alias("at_end"))
    begin = paths.select(F.col("conv_id").alias("rep"), (F.col("d") - 1).alias("p"), (F.col("total") - F.col("bytes")).alias("at_start"))
    nodes = nodes.select("e", "a", "b", "p", "pa", "pb", "rep")
    known = nodes.join(here, ["e", "a", "b"], "left").join(children, ["e", "a", "b"], "left").join(hashes, ["e", "a", "b"], "left")
    known = known.join(total, ["rep", "e"], "left").join(begin, ["rep", "p"], "left")
    known = known.select(
        _key("e", "a", "b").alias("k"),
        F.when(F.col("p").isNotNull(), _key("p", "pa", "pb")).alias("up"),
        "rep",
        F.coalesce("n_convs", _long(0)).alias("n_convs"),
        "conv_id",
        F.coalesce("n_children", _long(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), _long(1)).otherwise(_long(0)).alias("n_leaves"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        "at_end",
        "at_start",
    )
    known = stored(known, "nodes")
    counted = subtree(known, ["n_convs", "n_leaves"], ["conv_id"])
    known = known.drop("n_convs", "n_leaves", "conv_id").join(counted, "k")
    known = stored(known.withColumn("own", (F.col("n_convs") - 1) * F.coalesce(F.col("at_end") - F.col("at_start"), _long(0))), "nodes")
    saved = subtree(known.withColumn("saved", F.col("own")), ["saved"], [])
    parents = known.select(F.col("k").alias("up"), F.col("conv_id").alias("parent"))
    known = known.join(saved, "k").join(parents, "up", "left")

    top = known.where("up is null").select(
        "conv_id", _long(0).alias("depth"), _long(None).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )
    # a long edge is cut before its depths are listed
    edge = known.where("up is not null").withColumn("from", F.explode(F.sequence(F.col("up.e") + 1, F.col("k.e"), _long(BLOCK))))
    edge = edge.withColumn("depth", F.explode(F.sequence("from", F.least(F.col("from") + BLOCK - 1, "k.e"))))
    step = paths.select(F.col("conv_id").alias("rep"), F.col("d").alias("depth"), (F.col("total") - F.col("bytes")).alias("before"))
    edge = edge.join(step, ["rep", "depth"])
    last = F.col("depth") == F.col("k.e")
    rows = edge.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("up.e") + 1, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(_long(1)).alias("n_children"),
        "n_leaves",
        (F.col("saved") - F.col("own") + (F.col("n_convs") - 1) * (F.col("at_end") - F.col("before"))).alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).otherwise(EMPTY_SHA).alias("ends_sha256"),
    )
    return top.unionByName(rows)


def conversation_trie(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) rebuilt by ``rebuilt``; columns as in ``prefix_trie``.

    Turns go by number, null first, ties by role and text; null role or text is empty. Rows without a
    conversation are passed over, repeated rows are turns of their own, other columns are not read.
    """
    turns, lengths = rebuilt(stored(numbered(conversations), "turns"))
    return prefix_trie(turns, lengths, batches)


SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS n, conv_id - (conv_id % 5 + 5) % 5 AS base FROM turns GROUP BY conv_id
), convs AS (
  SELECT s.conv_id, s.base, s.n, {crc32_sql("s.conv_id::VARCHAR")} % 9 AS h, coalesce(b.n, 0) AS base_n FROM sizes s LEFT JOIN sizes b ON s.base = b.conv_id
), built AS (
  SELECT c.conv_id, t.pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, c.base_n), role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.pos >= c.h
), paths AS (
  SELECT c.conv_id, coalesce(s.turns, []) AS turns, coalesce(s.bytes, []) AS bytes FROM convs c LEFT JOIN (
    SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY pos) AS turns, list(strlen(text) ORDER BY pos) AS bytes FROM built GROUP BY conv_id
  ) s USING (conv_id)
), members AS (
  SELECT conv_id, d, sha256(array_to_string(turns[:d], ',')) AS key, CASE WHEN d > 0 THEN sha256(array_to_string(turns[:d - 1], ',')) END AS up,
    coalesce(bytes[d], 0) AS bytes, d = len(turns) AS ends
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM paths)
), nodes AS (
  SELECT d, key, up, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY d, key, up
), children AS (
  SELECT d - 1 AS d, up AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), sums AS (
  SELECT m.d, m.key, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.bytes) AS saved
  FROM nodes x LEFT JOIN children c ON c.d = x.d AND c.key = x.key JOIN members m ON m.conv_id = x.conv_id AND m.d <= x.d GROUP BY m.d, m.key
)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.d = x.d - 1 AND p.key = x.up LEFT JOIN children c ON c.d = x.d AND c.key = x.key JOIN sums s ON s.d = x.d AND s.key = x.key
"""
