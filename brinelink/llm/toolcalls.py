"""Linking tool calls to their results. Column expressions and joins only.

Calls and results meet by identifier in a hash join, both with one row per identifier, so a
frequent identifier cannot multiply. Calls are put in topological order by the calls they
come after: where each comes after one at most, which is a forest, by pointer doubling in
log2(depth) rounds; otherwise by peeling, a round per level. Arguments are parsed as variants
and joined field by field with the schemas. The canonical form is JSON without blanks, object
keys in order and numbers in their shortest form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelink.llm.common import stored


def _kind(value: Column) -> Column:
    """Schema name of a variant's type."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "STRING", "string")
        .when(t == "BIGINT", "integer")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "VOID", "null")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .when((t == "DOUBLE") | (t == "FLOAT") | t.startswith("DECIMAL"), "number")
    )


def levels(calls: DataFrame) -> DataFrame:
    """Topological level of calls (key, after: array of keys): key, level; null on and behind a cycle.

    A level is the length of the longest chain of calls before it. Keys that are not among
    the calls, the null key and repeated ones are passed over.
    """
    nodes = calls.select("key").where("key is not null").distinct()
    edges = calls.select("key", F.explode("after").alias("dep")).where("key is not null").distinct()
    edges = stored(edges.join(nodes.withColumnRenamed("key", "dep"), "dep").select("key", "dep"), "call-edges")
    nodes = stored(nodes, "calls")
    several = edges.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return _forest(nodes, edges) if several.isEmpty() else _peeled(nodes, edges)


def _forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    # each call points to an ancestor ``steps`` before it; none: its level is known
    state = nodes.join(edges, "key", "left").select(
        "key", F.col("dep").alias("up"), F.when(F.col("dep").isNull(), 0).otherwise(1).cast("long").alias("steps")
    )
    state = stored(state, "levels")
    waiting = state.where("up is not null").count()
    while waiting:
        above = state.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        state = stored(
            state.join(above, "up", "left").select("key", F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")),
            "levels",
        )
        now = state.where("up is not null").count()
        if now == waiting:  # a chain has a call at every depth, so what is left runs in circles
            break
        waiting = now
    return state.select("key", F.when(F.col("up").isNull(), F.col("steps")).alias("level"))


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    done = stored(nodes.join(edges.select("key").distinct(), "key", "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    frontier, rest, level = done, edges, 0
    while not frontier.isEmpty():
        level += 1
        rest = stored(rest.join(frontier.select(F.col("key").alias("dep")), "dep", "left_anti").select("key", "dep"), "call-edges")
        settled = done.select("key").union(rest.select("key"))
        frontier = stored(nodes.join(settled.distinct(), "key", "left_anti").withColumn("level", F.lit(level).cast("long")), "levels")
        done = done.union(frontier)
    return nodes.join(done, "key", "left").select("key", "level")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per different call: call_id, name, level, n_results, status, canonical.

    ``calls`` has call_id, name, arguments (JSON text) and after (array of call_id);
    ``results`` has call_id and content; ``schemas`` has name, field, kind (string, integer,
    number, boolean, array, object) and required. Of several results of a call the smallest
    is linked and ``n_results`` tells how many there were; a null content is a result.

    status is the first that holds of: ``no id``, ``ambiguous id`` (different calls share it;
    they are linked to nothing and no one waits for them), ``cycle``, ``bad arguments`` (null,
    not JSON, not an object), ``unknown tool``, ``invalid arguments`` (a required field is
    missing, or a field is unknown, null or of another kind), ``no result``, ``ok``. A call
    that comes after one that is not there does not wait for it. Repeated rows are one call.
    Other columns are not read. Empty tables are allowed.
    """
    after = F.coalesce("after", F.array().cast("array<string>"))
    calls = calls.select(
        F.col("call_id").cast("string").alias("call_id"),
        "name",
        "arguments",
        F.array_sort(F.array_distinct(F.filter(after, lambda x: x.isNotNull()))).alias("after"),
    ).distinct()
    ids = calls.where("call_id is not null").groupBy("call_id").agg(F.count("*").alias("same"))
    single = calls.join(ids.where("same = 1").select("call_id"), "call_id")
    order = levels(single.select(F.col("call_id").alias("key"), "after")).withColumnRenamed("key", "call_id")

    answered = results.where("call_id is not null").select(F.col("call_id").cast("string").alias("call_id"), "content")
    answered = answered.groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))

    parsed = single.withColumn("parsed", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    parsed = parsed.withColumn("is_object", is_object)
    given = parsed.where("is_object").select(
        "call_id", "name", F.explode(F.from_json("arguments", "map<string, variant>")).alias("field", "value")
    )
    fields = schemas.select("name", "field", F.col("kind").alias("want"), F.coalesce("required", F.lit(False)).alias("required")).distinct()
    checked = given.join(fields, ["name", "field"], "left").withColumn("kind", _kind(F.col("value")))
    fits = F.coalesce((F.col("kind") == F.col("want")) | ((F.col("want") == "number") & (F.col("kind") == "integer")), F.lit(False))
    checked = checked.groupBy("call_id").agg(
        F.count_if(~fits).alias("wrong"), F.count_distinct(F.when(fits & F.col("required"), F.col("field"))).alias("met")
    )
    tools = fields.groupBy("name").agg(F.count_distinct(F.when(F.col("required"), F.col("field"))).alias("needed"))

    linked = parsed.join(order, "call_id").join(answered, "call_id", "left").join(checked, "call_id", "left").join(tools, "name", "left")
    met, wrong = F.coalesce("met", F.lit(0)), F.coalesce("wrong", F.lit(0))
    status = (
        F.when(F.col("level").isNull(), "cycle")
        .when(~F.col("is_object"), "bad arguments")
        .when(F.col("needed").isNull(), "unknown tool")
        .when((wrong > 0) | (met < F.col("needed")), "invalid arguments")
        .when(F.col("n_results").isNull(), "no result")
        .otherwise("ok")
    )
    canonical = F.to_json(
        F.struct(
            "after",
            F.col("parsed").alias("arguments"),
            F.col("call_id").alias("id"),
            "level",
            "name",
            F.col("content").alias("result"),
            status.alias("status"),
        )
    )
    out = linked.select(
        "call_id", "name", "level", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), status.alias("status"), canonical.alias("canonical")
    )
    loose = calls.join(ids.where("same > 1").select("call_id"), "call_id").select("call_id", "name", F.lit("ambiguous id").alias("status"))
    loose = loose.unionByName(calls.where("call_id is null").select("call_id", "name", F.lit("no id").alias("status")))
    loose = loose.select(
        "call_id", "name", F.lit(None).cast("long").alias("level"), F.lit(0).cast("long").alias("n_results"), "status", F.lit(None).cast("string").alias("canonical")
    )
    return out.unionByName(loose)


# fixed values: the tools that stand behind the turns of ``conversations``
TOOLS = [
    ("answer", "text", "string", True),
    ("answer", "turn", "integer", True),
    ("answer", "words", "integer", False),
    ("configure", "text", "string", True),
    ("configure", "turn", "integer", True),
    ("configure", "strict", "boolean", True),
]


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas read off conversations (conv_id, turn, role, text).

    A user turn calls ``answer`` and a system turn ``configure``, with the text, the turn and the
    number of words; an assistant turn is the result of the turn before. A call comes after that of
    the latest earlier turn that may have been one (one or two turns before). Turns without a
    conversation, number or role are neither.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null and role is not null")
    name_of = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    arguments = F.struct("text", "turn", F.size(F.split("text", r"\s+")).alias("words"))
    calls = turns.where("role in ('user', 'system')").select(
        name_of(0).alias("call_id"),
        F.when(F.col("role") == "user", "answer").otherwise("configure").alias("name"),
        F.to_json(F.when(F.col("text").isNotNull(), arguments).otherwise(F.struct(F.lit(None).cast("string").alias("text"), "turn", F.lit(0).alias("words")))).alias("arguments"),
        F.array(F.when(F.col("turn") == 1, name_of(1)).otherwise(name_of(2))).alias("after"),
    )
    results = turns.where("role = 'assistant'").select(name_of(1).alias("call_id"), F.col("text").alias("content"))
    names = ("name", "field", "kind", "required")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, tool)]) for tool in TOOLS])
    return calls, results, conversations.sparkSession.range(1).select(F.inline(rows))


SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL
), calls AS (
  SELECT DISTINCT conv_id || '-' || turn AS call_id, CASE WHEN role = 'user' THEN 'answer' ELSE 'configure' END AS name, text, turn,
    conv_id || '-' || (CASE WHEN turn = 1 THEN 0 ELSE turn - 2 END) AS dep
  FROM turns WHERE role IN ('user', 'system')
), ids AS (
  SELECT call_id, count(*) AS same FROM calls GROUP BY call_id
), single AS (
  SELECT c.* FROM calls c JOIN ids USING (call_id) WHERE same = 1
), answered AS (
  SELECT conv_id || '-' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n FROM turns WHERE role = 'assistant' GROUP BY 1
), leveled AS (
  SELECT call_id, 0 AS level FROM single WHERE dep NOT IN (SELECT call_id FROM single)
  UNION ALL
  SELECT s.call_id, l.level + 1 FROM single s JOIN leveled l ON s.dep = l.call_id
)
SELECT s.call_id, s.name, l.level::BIGINT AS level, coalesce(a.n, 0)::BIGINT AS n_results, t.status,
  '{"after":["' || s.dep || '"],"arguments":{'
    || CASE WHEN s.text IS NULL THEN '"turn":' || s.turn || ',"words":0'
       ELSE '"text":' || to_json(s.text) || ',"turn":' || s.turn || ',"words":' || len(regexp_split_to_array(s.text, '[ \\t\\n\\x0B\\f\\r]+')) END
    || '},"id":"' || s.call_id || '","level":' || l.level || ',"name":"' || s.name || '"'
    || CASE WHEN a.content IS NULL THEN '' ELSE ',"result":' || to_json(a.content) END
    || ',"status":"' || t.status || '"}' AS canonical
FROM single s JOIN leveled l USING (call_id) LEFT JOIN answered a USING (call_id),
LATERAL (SELECT CASE WHEN s.name = 'configure' OR s.text IS NULL THEN 'invalid arguments' WHEN a.n IS NULL THEN 'no result' ELSE 'ok' END AS status) t
UNION ALL
SELECT c.call_id, c.name, NULL, 0, 'ambiguous id', NULL FROM calls c JOIN ids USING (call_id) WHERE same > 1
"""
