import json
import random

import pytest

from brinelink.llm import toolcalls
from brinelink.llm.common import table
from brinelink.llm.queries import ORACLES, QUERIES
from brinelink.llm.toolcalls import levels, link
from checks.compare import compare, connect

SCHEMA = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("ping", "on", "boolean", None)]


def tables(spark, calls, results):
    return (
        spark.createDataFrame([(*c, "x") for c in calls], "call_id string, name string, arguments string, after array<string>, level string"),
        spark.createDataFrame([(*r, "x") for r in results], "call_id string, content string, n_results string"),
        spark.createDataFrame(SCHEMA, "name string, field string, kind string, required boolean"),
    )


def test_statuses_and_canonical_json(spark):
    calls = [
        ("a", "add", '{"b": 2.50, "a":1}', None),
        ("b", "add", '{"a":1,"b":2,"note":"é\\n"}', ["a", "a", None, "gone"]),
        ("c", "add", '{"a":"1","b":2}', ["b"]),
        ("d", "add", '{"a":1}', []),
        ("e", "add", '{"a":1,"b":1,"z":1}', []),
        ("f", "add", '{"a":1,"b":1,"note":null}', []),
        ("g", "none", "{}", []),
        ("h", "ping", "{}", []),
        ("i", "ping", "{bad", []),
        ("j", "ping", "[1]", []),
        ("k", "ping", None, []),
        ("l", "ping", "{}", ["m"]),
        ("m", "ping", "{}", ["l"]),
        ("n", "ping", "{}", ["l"]),
        ("o", "ping", "{}", ["o"]),
        ("p", "ping", "{}", []),
        ("p", "ping", '{"on":true}', []),
        ("q", "ping", "{}", ["p"]),
        (None, "ping", "{}", []),
        ("r", "ping", '{"on":true}', []),
        ("r", "ping", '{"on":true}', []),
    ]
    results = [("a", "3"), ("b", "x"), ("b", "3"), ("h", None), ("r", "ok"), (None, "lost"), ("p", "never"), ("zz", "nobody's")]
    got = {}
    for r in link(*tables(spark, calls, results)).collect():
        got.setdefault(r.call_id, []).append(r)
    status = {k: sorted(x.status for x in v) for k, v in got.items()}
    assert status == {
        "a": ["ok"], "b": ["ok"], "c": ["invalid arguments"], "d": ["invalid arguments"], "e": ["invalid arguments"],
        "f": ["invalid arguments"], "g": ["unknown tool"], "h": ["ok"], "i": ["bad arguments"], "j": ["bad arguments"],
        "k": ["bad arguments"], "l": ["cycle"], "m": ["cycle"], "n": ["cycle"], "o": ["cycle"],
        "p": ["ambiguous id"] * 2, "q": ["no result"], None: ["no id"], "r": ["ok"],
    }
    assert got["a"][0].canonical == '{"after":[],"arguments":{"a":1,"b":2.5},"id":"a","level":0,"name":"add","result":"3","status":"ok"}'
    assert (got["b"][0].level, got["c"][0].level, got["b"][0].n_results) == (1, 2, 2)
    assert json.loads(got["b"][0].canonical)["arguments"]["note"] == "é\n"
    assert link(*(t.where("false") for t in tables(spark, calls, results))).count() == 0


def brute(graph):
    out = {}

    def level(k, path):
        if k in path:
            return None
        deps = [level(d, path | {k}) for d in graph[k] if d in graph]
        return None if None in deps else max([d + 1 for d in deps], default=0)

    for k in graph:
        out[k] = level(k, frozenset())
    return out


@pytest.mark.parametrize("most", [1, 3])
def test_levels_are_longest_chains(spark, most):
    rnd = random.Random(most)
    graph = {f"k{i}": [f"k{rnd.randrange(i)}" for _ in range(rnd.randrange(most + 1))] if i else [] for i in range(60)}
    graph |= {f"c{i}": [f"c{i - 1}"] for i in range(1, 40)} | {"c0": []}
    graph |= {"x": ["y"], "y": ["x"], "z": ["y"]}
    df = spark.createDataFrame(list(graph.items()), "key string, after array<string>")
    assert {r.key: r.level for r in levels(df).collect()} == brute(graph)


def test_query_equals_sql(spark, sf):
    assert compare(spark, connect(sf), QUERIES["op2_tool_calls"], ORACLES["op2_tool_calls"], sf) == ""


def test_no_python_in_the_plan(spark, sf):
    plan = link(*toolcalls.turns_as_calls(table(spark, sf, "conversations")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, None, "x"), (4, 1, "assistant", "alone")]
    rows += [(5, 0, "user", "one"), (5, 0, "user", "two"), (6, 0, "user", "same"), (6, 0, "user", "same"), (7, 0, "system", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = sorted((r.call_id, r.status, r.n_results) for r in link(*toolcalls.turns_as_calls(df)).collect())
    assert got == [("1-0", "invalid arguments", 1), ("5-0", "ambiguous id", 0), ("5-0", "ambiguous id", 0), ("6-0", "no result", 0), ("7-0", "invalid arguments", 0)]
