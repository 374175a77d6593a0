import json

import pytest
from support import SF, same

from pixelframe.llm import toolcalls as t
from pixelframe.llm.queries import ORACLE_SQL, op10_tool_calls

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "look": {"where": ("object", True), "tags": ("array", False), "deep": ("boolean", False)}}
DDL = "conv_id bigint, turn bigint, role string, text string, kind string, status string"


def talk(spark, rows):
    return spark.createDataFrame([(c, n, r, x if x is None or isinstance(x, str) else json.dumps(x), "x", "y") for c, n, r, x in rows], DDL)


def calls(*items, **more):
    return {"tool_calls": [{"id": i, "name": n, "arguments": a, **({"after": d[0]} if d else {})} for i, n, a, *d in items], **more}


def told(call, content="ok"):
    return {"tool_call_id": call, "content": content}


def by(df):
    return {(r.conv_id, r.turn, r.idx): r for r in df.collect()}


def test_links(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", calls(("a", "add", {"a": 1, "b": 2}), ("b", "add", {"b": 1.5, "a": 2}), content="two calls")), (1, 2, "tool", told("b")), (1, 3, "tool", told("a")),
        (1, 4, "tool", told("a", "again")), (1, 5, "tool", told("zz")), (1, 6, "assistant", calls(("a", "add", {"a": 1, "b": 2}), ("c", "look", {"where": {}}))), (2, 0, "tool", told("a")),
        (None, 0, "assistant", calls(("n", "add", {"a": 1, "b": 2}))), (None, 1, "tool", told("n")), (3, None, "user", None), (3, 1, None, "{not json"), (3, 2, "assistant", ""), (3, 3, "user", "x" * 300_000),
    ]
    got = by(t.link_tool_calls(talk(spark, rows), SCHEMAS))
    status = {k: (r.kind, r.status, r.linked_turn) for k, r in got.items()}
    assert status[1, 1, 0] == ("message", "message", None) and status[1, 1, 1] == ("call", "linked", 3) and status[1, 1, 2] == ("call", "linked", 2)
    assert status[1, 2, 0] == ("result", "linked", 1) and status[1, 4, 0] == ("result", "duplicate", None) and status[1, 5, 0] == ("result", "orphan", None)
    assert status[1, 6, 1] == ("call", "duplicate", None) and status[1, 6, 2] == ("call", "unanswered", None) and status[2, 0, 0] == ("result", "orphan", None)
    assert status[None, 0, 1] == ("call", "unanswered", None) and status[None, 1, 0] == ("result", "orphan", None)
    assert len(got) == 17 and json.loads(got[3, 3, 0].json)["content"] == "x" * 300_000
    assert t.link_tool_calls(talk(spark, []), SCHEMAS).count() == 0


def test_arguments_are_validated(spark):
    bad = [
        (("1", "add", {"a": 1, "b": 2.5}), []), (("2", "add", {"b": 2}), ["missing: a"]), (("3", "add", {"a": "1", "b": None, "zz": 1}), ["type: a", "type: b", "unknown: zz"]),
        (("4", "nope", {}), ["unknown tool"]), (("5", "add", [1]), ["no object"]), (("6", "look", {"where": {"x": [1]}, "tags": ["a"], "deep": True}), []),
        (("7", "look", {"where": [], "tags": {}, "deep": 1}), ["type: deep", "type: tags", "type: where"]), (("8", "add", None), ["no object"]),
        (("9", "add", '{"b": 1, "a": 12345678901234567890123}'), []), (("10", "add", "{broken"), ["no object"]), (("11", None, {}), ["unknown tool"]),
    ]
    rows = [(1, k, "assistant", calls(c)) for k, (c, _) in enumerate(bad)]
    got = by(t.link_tool_calls(talk(spark, rows), SCHEMAS))
    assert [got[1, k, 1].errors for k in range(len(bad))] == [e for _, e in bad]


def test_canonical_json(spark):
    arguments = {"z": 1, "a": {"y": [3, {"d": 1, "b": "é\n\"/"}], "c": None}, "b": 1.5}
    got = by(t.link_tool_calls(talk(spark, [(1, 0, "assistant", calls(("i", "t", arguments)))]), SCHEMAS))[1, 0, 1].json
    want = json.dumps({"arguments": arguments, "id": "i", "name": "t", "role": "assistant", "type": "call"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got == want


def order(df, conv):
    rows = [r for r in df.collect() if r.conv_id == conv]
    return [f"{r.kind[0]}{r.call_id or r.turn}" for r in sorted(rows, key=lambda r: (r.order_turn, r.order_idx, r.order_rank))]


def test_topological_order(spark):
    rows = [
        (1, 0, "tool", told("a")), (1, 1, "user", "x"), (1, 2, "assistant", calls(("a", "add", {}, ["b"]))), (1, 3, "tool", told("b")), (1, 4, "assistant", calls(("b", "add", {}))),
        (2, 0, "assistant", calls(("p", "add", {}, ["q"]))), (2, 1, "assistant", calls(("q", "add", {}, ["p"]))), (2, 2, "user", "y"), (2, 3, "assistant", calls(("r", "add", {}, ["self", "r"]))),
        (3, 0, "user", "a"), (3, 1, "assistant", calls(("k", "add", {}))), (3, 2, "tool", told("k")),
    ]
    out = t.link_tool_calls(talk(spark, rows), SCHEMAS)
    assert order(out, 1) == ["m1", "cb", "rb", "ca", "ra"]
    assert order(out, 3) == ["m0", "ck", "rk"]
    assert {r.call_id: r.status for r in out.collect() if r.conv_id == 2 and r.kind == "call"} == {"p": "cycle", "q": "cycle", "r": "cycle"}


@pytest.mark.parametrize("folded", [64, 2])
def test_places_against_a_brute_force_version(spark, monkeypatch, folded):
    """Random waits, forward, backward and in rings: the longest way from the last row that a row waits for."""
    import random

    monkeypatch.setattr(t, "FOLDED", folded)
    r = random.Random(9)
    rows, waits = [], {}
    for conv in range(25 if folded > 2 else 3):
        n = r.randrange(1, 9) if folded > 2 else 3
        for turn in range(n):
            names = [f"{x}" for x in r.sample(range(n + 1), min(n, r.choice([0, 0, 1, 2]))) if r.random() < 0.9 or x != turn]
            rows.append((conv, 2 * turn + r.randrange(2) * 20, "assistant", calls((f"{turn}", "add", {}, names))))
            if r.random() < 0.7:
                rows.append((conv, r.randrange(30) * 2 + 1, "tool", told(f"{turn}")))
            waits[conv, f"{turn}"] = names
    own = {}
    for conv, turn, _, x in sorted(rows, key=lambda x: x[:2]):
        key = (conv, x["tool_calls"][0]["id"], "call") if "tool_calls" in x else (conv, x["tool_call_id"], "result")
        own.setdefault(key, (turn, int(key[2] == "call")))
    edges = [((c, i, "call"), (c, i, "result")) for c, i, k in own if k == "result"]
    edges += [((c, w, k), (c, i, "call")) for (c, i), names in waits.items() for w in names for k in ("call", "result")]
    edges = [(a, b) for a, b in edges if a in own and b in own]
    at = {k: (*v, 0) for k, v in own.items()}
    for _ in range(60):
        at = {k: max([v, *((*at[a][:2], at[a][2] + 1) for a, b in edges if b == k)]) for k, v in at.items()}
    way = dict.fromkeys(own, 0)
    for _ in range(120):
        way = {k: max([0, *(way[a] + 1 for a, b in edges if b == k)]) for k in way}
    cyclic = {k for k, v in way.items() if v >= 60}
    got = [x for x in t.link_tool_calls(talk(spark, rows), SCHEMAS).collect() if x.kind != "message" and x.status != "duplicate"]
    assert {(x.conv_id, x.call_id, x.kind): (x.order_turn, x.order_idx, x.order_rank) for x in got} == {k: (*own[k], 0) if k in cyclic else v for k, v in at.items()}
    assert {(x.conv_id, x.call_id, x.kind) for x in got if x.status == "cycle"} == cyclic and (len(cyclic) > 5 or folded == 2)


@pytest.mark.parametrize("folded", [64, 2])
def test_long_chain_out_of_order(spark, monkeypatch, folded):
    monkeypatch.setattr(t, "FOLDED", folded)
    n = 12 if folded > 2 else 4
    rows = [(1, n - k, "assistant", calls((f"{k}", "add", {}, [f"{k - 1}"] if k else []))) for k in range(n)]
    assert order(t.link_tool_calls(talk(spark, rows), SCHEMAS), 1) == [f"c{k}" for k in range(n)]


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query(spark, duck):
    same(op10_tool_calls(spark, str(SF)), duck, ORACLE_SQL["op10_tool_calls"])


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query_has_hard_rows(spark):
    got = op10_tool_calls(spark, str(SF.parent / "sf0.01")).groupBy("status", (t.F.col("errors") != "").alias("wrong"), (t.F.col("order_rank") > 0).alias("moved")).count().collect()
    assert {r.status for r in got} == {"message", "linked", "unanswered", "duplicate", "orphan", "cycle"}
    assert any(r.wrong for r in got) and any(r.moved for r in got)
