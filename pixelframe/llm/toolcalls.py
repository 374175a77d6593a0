"""Tool-call linking for chat formatting.

Calls and results of a conversation are linked by identifier with a hash join on (conversation, identifier);
the first call and the first result of an identifier count. Every row gets a place in a topological order, in which a
result comes after its call and a call after those that it names: rows stand where their turn puts them, and only those
that would come too early are moved behind what they wait for. Calls that wait for one another, directly or not, are a
group; groups in which something comes too early are put in order each in its row, if they are small (:data:`FOLDED`),
and else all together in rounds. Arguments are validated against the schema of their
tool, and every row is serialised as canonical JSON: keys sorted at every level, no white space, absent values left out.

All of it is DataFrame functions; JSON is parsed to variants. The result has one row for each message, call
and result, so a conversation of any length is never one row or one group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, staged
from .components import components

#: Most calls and results of a group that is put in order in one row.
FOLDED = 64
#: tool: property: (JSON type, required)
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
_KINDS = {"string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DECIMAL.*|DOUBLE)$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT<", "array": r"^ARRAY<", "null": r"^VOID$"}


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def errors_of(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments (a variant), as an array: missing, of a wrong type, or not in the schema."""
    none = F.array().cast("array<string>")
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT<"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for tool, properties in schemas.items():
        found = [none]
        for prop, (kind, required) in sorted(properties.items()):
            value = _at(arguments, f"$['{prop}']", "variant")
            missing = F.array(F.lit(f"missing: {prop}")) if required else none
            found.append(F.when(value.isNull(), missing).when(F.schema_of_variant(value).rlike(_KINDS[kind]), none).otherwise(F.array(F.lit(f"type: {prop}"))))
        keys = F.map_keys(_at(arguments, "$", "map<string,variant>"))
        strange = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, properties)).cast("array<string>"))), lambda k: F.concat(F.lit("unknown: "), k))
        out = F.when(name == tool, F.when(is_object, F.concat(*found, F.coalesce(strange, none))).otherwise(F.array(F.lit("no object")))).otherwise(out)
    return out


def rows_of(messages: DataFrame) -> DataFrame:
    """Messages, calls and results, one row each, from ``messages`` (conv_id, turn, role, text).

    An assistant's text that is a JSON object with ``tool_calls`` holds calls (id, name, arguments, after), and a
    message too if it has ``content``; a tool's text that is an object with ``tool_call_id`` is a result. All else
    is a message with its text as content.
    """
    seen = messages.select("conv_id", "turn", "role", "text").withColumn("v", F.when(F.startswith(F.col("text"), F.lit("{")), F.try_parse_json("text")))
    calls = F.when(F.col("role") == "assistant", _at(F.col("v"), "$.tool_calls", "array<variant>"))
    answers = F.when(F.col("role") == "tool", _at(F.col("v"), "$.tool_call_id", "string"))
    seen = seen.select("*", calls.alias("calls"), answers.alias("answers"))
    kind = "struct<idx:int,kind:string,call_id:string,name:string,arguments:variant,after:array<string>,content:string>"
    nothing = F.lit(None)

    def call(x: Column, i: Column) -> Column:
        given = F.coalesce(_at(x, "$.function.arguments", "variant"), _at(x, "$.arguments", "variant"))
        as_text = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(_at(given, "$", "string")))
        named = F.coalesce(_at(x, "$.function.name", "string"), _at(x, "$.name", "string"))
        return F.struct((i + 1).alias("idx"), F.lit("call").alias("kind"), _at(x, "$.id", "string").alias("call_id"), named.alias("name"), F.when(F.schema_of_variant(given) == "STRING", as_text).otherwise(given).alias("arguments"), _at(x, "$.after", "array<string>").alias("after"), nothing.cast("string").alias("content"))

    def other(name: str, call_id: Column, content: Column) -> Column:
        return F.struct(F.lit(0).alias("idx"), F.lit(name).alias("kind"), call_id.alias("call_id"), nothing.cast("string").alias("name"), nothing.cast("variant").alias("arguments"), nothing.cast("array<string>").alias("after"), content.alias("content"))

    empty = F.array().cast(f"array<{kind}>")
    said = F.when(F.col("calls").isNotNull() & _at(F.col("v"), "$.content", "string").isNull(), empty).when(F.col("calls").isNotNull(), F.array(other("message", nothing.cast("string"), _at(F.col("v"), "$.content", "string"))))
    said = said.when(F.col("answers").isNotNull(), F.array(other("result", F.col("answers"), _at(F.col("v"), "$.content", "string")))).otherwise(F.array(other("message", nothing.cast("string"), F.col("text"))))
    parts = F.concat(said, F.coalesce(F.transform("calls", call), empty))
    return seen.select("conv_id", "turn", "role", F.explode(parts).alias("p")).select("conv_id", "turn", "role", "p.*")


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each message, call and result of ``messages`` (conv_id, turn, role, text).

    Returns conv_id, turn, idx (0, or a call's number in its message), kind, call_id, linked_turn (the other side's turn),
    status, errors, order_turn, order_idx, order_rank and json. Sorted by the three order columns a conversation is in topological
    order. status: ``message``; for calls ``linked``, ``unanswered`` or ``duplicate``; for results ``linked``, ``orphan`` or
    ``duplicate``; ``cycle`` for those that wait for themselves or for such a one: they stay at their own place. errors: see :func:`errors_of`; empty for all but calls.

    Nulls: rows with a null conv_id, turn or identifier are returned and link to nothing; a null text is a message
    without content; a null role is left out of the JSON. Text that is no JSON is a message. Of calls (results) with one
    identifier the first by turn and number is linked; of repeated rows all count as the first. Other columns are not read.
    An empty table gives an empty result.
    """
    rows = rows_of(messages)
    named = rows.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    # One row for each identifier: what is hashed is bounded by the partition.
    first = named.groupBy("conv_id", "call_id").agg(F.min(F.when(F.col("kind") == "call", F.struct("turn", "idx"))).alias("asked"), F.min(F.when(F.col("kind") == "result", F.struct("turn", "idx"))).alias("told"))
    first = first.select(F.col("conv_id").alias("at_conv"), F.col("call_id").alias("at_call"), "asked", "told")
    linked = rows.join(first.hint("shuffle_hash"), (F.col("conv_id") == F.col("at_conv")) & (F.col("call_id") == F.col("at_call")), "left")
    here = F.struct("turn", "idx")
    lone = F.when(F.col("kind") == "call", F.when(here != F.col("asked"), "duplicate").when(F.col("told").isNull(), "unanswered").otherwise("linked"))
    lone = lone.when(F.col("kind") == "result", F.when(here != F.col("told"), "duplicate").when(F.col("asked").isNull(), "orphan").otherwise("linked")).otherwise("message")
    missing = F.col("at_call").isNull() & (F.col("kind") != "message")
    status = F.when(missing, F.when(F.col("kind") == "call", "unanswered").otherwise("orphan")).otherwise(lone)
    other = F.when(F.col("kind") == "call", F.col("told.turn")).when(F.col("kind") == "result", F.col("asked.turn"))
    moved = _moved(named, first)
    linked = linked.withColumn("status", status).withColumn("linked_turn", F.when(F.col("status") == "linked", other))
    if moved is not None:
        linked = linked.join(moved, (F.col("conv_id") == F.col("m_conv")) & (F.col("call_id") == F.col("m_call")) & (F.col("kind") == F.col("m_kind")), "left")
        cycle = F.coalesce(F.col("cyclic") & (F.col("status") != "duplicate"), F.lit(False))
        place = F.when((F.col("status") != "duplicate") & F.col("at").isNotNull() & ~F.col("cyclic"), F.col("at"))
        linked = linked.withColumn("status", F.when(cycle, "cycle").otherwise(F.col("status")))
    else:
        place = F.lit(None).cast("struct<turn:bigint,idx:int,rank:int>")
    errors = F.when(F.col("kind") == "call", errors_of(F.coalesce("name", F.lit("")), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    json = F.to_json(F.struct("arguments", "content", F.col("call_id").alias("id"), "name", "role", F.col("kind").alias("type")))
    ordered = [F.coalesce(place["turn"], F.col("turn")).alias("order_turn"), F.coalesce(place["idx"], F.col("idx")).alias("order_idx"), F.coalesce(place["rank"], F.lit(0)).alias("order_rank")]
    return linked.select("conv_id", "turn", "idx", "kind", "call_id", "linked_turn", "status", errors.alias("errors"), *ordered, json.alias("json"))


def _moved(named: DataFrame, first: DataFrame) -> DataFrame | None:
    """Places of the calls and results of groups in which any comes before what it waits for; None if all are in order.

    A place is (turn, idx, rank): a row that would be too early stands behind the last it waits for, with one more in
    rank. A group is a connected component of the calls of a conversation, so a long conversation has many small ones.
    """
    sides = first.select("at_conv", "at_call", F.explode(F.array(F.struct(F.lit("call").alias("kind"), F.col("asked").alias("p")), F.struct(F.lit("result").alias("kind"), F.col("told").alias("p")))).alias("s")).where(F.col("s.p").isNotNull())
    start = F.struct(F.col("s.p.turn").cast("bigint").alias("turn"), F.col("s.p.idx").alias("idx"), F.lit(0).alias("rank"))
    unit = lambda call: F.concat_ws("\x01", F.col("at_conv").cast("string"), call)
    nodes = sides.select("at_conv", F.col("at_call").alias("node_call"), F.col("s.kind").alias("node_kind"), start.alias("at"), unit("at_call").alias("unit"))
    own = first.where(F.col("asked").isNotNull() & F.col("told").isNotNull()).select("at_conv", F.col("at_call").alias("src_call"), F.lit("call").alias("src_kind"), F.col("at_call").alias("dst_call"), F.lit("result").alias("dst_kind"))
    waits = named.where((F.col("kind") == "call") & F.col("after").isNotNull()).select(F.col("conv_id").alias("at_conv"), F.explode("after").alias("src_call"), F.col("call_id").alias("dst_call"))
    waits = waits.select("at_conv", "src_call", F.explode(F.array(F.lit("call"), F.lit("result"))).alias("src_kind"), "dst_call", F.lit("call").alias("dst_kind"))
    edges = own.unionByName(waits).distinct().withColumn("unit", unit("dst_call"))
    late = staged(_early(nodes, edges).select(F.col("unit").alias("late")).distinct(), "calls-late")
    if late.isEmpty():
        return None
    known = first.select(F.concat_ws("\x01", F.col("at_conv").cast("string"), "at_call").alias("known"))
    links = waits.select(unit("src_call").alias("a"), unit("dst_call").alias("b")).distinct()
    groups = staged(components(links.join(known, F.col("a") == F.col("known"), "left_semi")).select(F.col("node").alias("member"), "root"), "calls-groups")
    in_group = lambda df, key: df.join(groups, F.col(key) == F.col("member"), "left").withColumn("root", F.coalesce("root", key)).drop("member")
    wanted = staged(in_group(late, "late").select(F.col("root").alias("wanted")).distinct(), "calls-wanted")
    nodes, edges = (staged(in_group(df, "unit").join(wanted, F.col("root") == F.col("wanted"), "left_semi").drop("unit"), "calls-moved") for df in (nodes, edges))
    sizes = staged(nodes.groupBy("root").agg(F.count("*").alias("size")).withColumnRenamed("root", "sized"), "calls-sizes")
    of_size = lambda df, test: df.join(sizes.where(test), F.col("root") == F.col("sized"), "left_semi")
    small = F.col("size") <= FOLDED
    done = _folded(of_size(nodes, small), of_size(edges, small))
    if sizes.where(~small).isEmpty():
        return done
    return done.unionByName(_in_rounds(of_size(nodes, ~small).drop("root"), of_size(edges, ~small).drop("root")))


def _early(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` whose later side does not stand after the earlier one, with both places."""
    src = nodes.select(F.col("at_conv").alias("c1"), F.col("node_call").alias("n1"), F.col("node_kind").alias("k1"), F.col("at").alias("src_at"))
    dst = nodes.select(F.col("at_conv").alias("c2"), F.col("node_call").alias("n2"), F.col("node_kind").alias("k2"), F.col("at").alias("dst_at"))
    found = edges.join(src, (F.col("at_conv") == F.col("c1")) & (F.col("src_call") == F.col("n1")) & (F.col("src_kind") == F.col("k1")))
    found = found.join(dst, (F.col("at_conv") == F.col("c2")) & (F.col("dst_call") == F.col("n2")) & (F.col("dst_kind") == F.col("k2")))
    return found.where(F.col("dst_at") <= F.col("src_at"))


def _folded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The places of small groups, each a row of at most FOLDED nodes: all edges are followed as often as it takes.

    The longest way to a row that is not in or behind a cycle is shorter than the number of rows; so a longer one tells a cycle.
    """
    listed = nodes.groupBy("root").agg(F.first("at_conv").alias("at_conv"), F.sort_array(F.collect_list(F.struct(F.col("node_call").alias("call"), F.col("node_kind").alias("kind"), "at"))).alias("n"))
    arrows = edges.groupBy(F.col("root").alias("of")).agg(F.collect_list(F.struct("src_call", "src_kind", "dst_call", "dst_kind")).alias("e"))
    rows = listed.join(arrows, F.col("root") == F.col("of"))
    names = F.transform("n", lambda x: F.struct(x["call"].alias("call"), x["kind"].alias("kind")))
    rows = rows.select("at_conv", names.alias("names"), F.transform("n", lambda x: F.struct(x["at"].alias("at"), F.lit(0).alias("way"))).alias("start"), "e")
    place = lambda call, kind: F.array_position("names", F.struct(call.alias("call"), kind.alias("kind"))).cast("int")
    numbered = F.transform("e", lambda x: F.struct(place(x["src_call"], x["src_kind"]).alias("src"), place(x["dst_call"], x["dst_kind"]).alias("dst")))
    rows = rows.withColumn("e", F.filter(numbered, lambda x: (x["src"] > 0) & (x["dst"] > 0)))

    def followed(places: Column) -> Column:
        def moved(at: Column, i: Column) -> Column:
            before = F.transform(F.filter("e", lambda x: x["dst"] == i + 1), lambda x: F.element_at(places, x["src"]))
            place = F.greatest(at["at"], F.array_max(F.transform(before, lambda x: _behind(x["at"]))))
            return F.struct(place.alias("at"), F.coalesce(F.array_max(F.transform(before, lambda x: x["way"])) + 1, F.lit(0)).alias("way"))

        return F.transform(places, moved)

    rounds = F.sequence(F.lit(1), 2 * F.size("names"))
    rows = rows.withColumn("places", F.aggregate(rounds, F.col("start"), lambda places, _: followed(places)))
    each = rows.select("at_conv", F.size("names").alias("size"), F.explode(F.arrays_zip("names", "places")).alias("x"))
    return each.select(F.col("at_conv").alias("m_conv"), F.col("x.names.call").alias("m_call"), F.col("x.names.kind").alias("m_kind"), F.col("x.places.at").alias("at"), (F.col("x.places.way") >= F.col("size")).alias("cyclic"))


def _behind(at: Column) -> Column:
    return F.struct(at["turn"].alias("turn"), at["idx"].alias("idx"), (at["rank"] + 1).alias("rank"))


def _in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The places of groups of any size: a round places every row that waits for nothing any more, and moves what waits for it.

    Rounds are as many as the longest way; what is left when nothing can be placed is in a cycle or behind one.
    """
    open_, edges = cut(nodes.select("at_conv", "node_call", "node_kind", "at")), cut(edges.select("at_conv", "src_call", "src_kind", "dst_call", "dst_kind"))
    same = lambda conv, call, kind: (F.col("at_conv") == F.col(conv)) & (F.col("node_call") == F.col(call)) & (F.col("node_kind") == F.col(kind))
    there = open_.select(F.col("at_conv").alias("c"), F.col("node_call").alias("n"), F.col("node_kind").alias("k"))
    edges = cut(edges.join(there, (F.col("at_conv") == F.col("c")) & (F.col("src_call") == F.col("n")) & (F.col("src_kind") == F.col("k")), "left_semi"))
    done = None
    while True:
        ends = edges.select(F.col("at_conv").alias("c"), F.col("dst_call").alias("n"), F.col("dst_kind").alias("k")).distinct()
        ready = cut(open_.join(ends, same("c", "n", "k"), "left_anti"))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        named = ready.select(F.col("at_conv").alias("c1"), F.col("node_call").alias("n1"), F.col("node_kind").alias("k1"), F.col("at").alias("src_at"))
        met = (F.col("at_conv") == F.col("c1")) & (F.col("src_call") == F.col("n1")) & (F.col("src_kind") == F.col("k1"))
        pushed = edges.join(named, met).groupBy(F.col("at_conv").alias("c2"), F.col("dst_call").alias("n2"), F.col("dst_kind").alias("k2")).agg(F.max(_behind(F.col("src_at"))).alias("behind"))
        rest = open_.join(named, same("c1", "n1", "k1"), "left_anti").join(pushed, same("c2", "n2", "k2"), "left")
        open_ = cut(rest.select("at_conv", "node_call", "node_kind", F.greatest("at", F.coalesce("behind", "at")).alias("at")))
        edges = cut(edges.join(named, met, "left_anti"))
    result = open_.withColumn("cyclic", F.lit(True))
    result = result if done is None else done.withColumn("cyclic", F.lit(False)).unionByName(result)
    return result.select(F.col("at_conv").alias("m_conv"), F.col("node_call").alias("m_call"), F.col("node_kind").alias("m_kind"), "at", "cyclic")


#: The schema of the query: each user turn is a call of ``reply``, the assistant turn after it the result.
REPLY: Schemas = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with user turns as calls of the tool ``reply`` and assistant turns as their results.

    By the number s = conv_id + turn some rows are given what goes wrong in logs: arguments of a wrong type (s mod 7 is
    3), without text (s mod 11 is 5) or with one more (s mod 13 is 6), an unknown tool (s mod 17 is 8), a call that waits
    for that of the next user turn (s mod 5 is 2), results that answer the call before (s mod 9 is 4); in one conversation of ten
    the calls of turns 0 and 2 wait for each other.
    """
    s = F.col("conv_id") + F.col("turn")
    at = lambda n, k: F.coalesce(F.pmod(s, F.lit(n)) == k, F.lit(False))
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    ring = F.coalesce((F.pmod("conv_id", F.lit(10)) == 4) & turn.isin(0, 2), F.lit(False))
    after = F.when(ring, F.array(name(2 - turn))).when(at(5, 2), F.array(name(turn + 2)))
    text = F.when(~at(11, 5), F.col("text")).alias("text")

    def asked(turn_given: Column) -> Column:
        arguments = F.struct(F.when(at(13, 6), F.lit("x")).alias("note"), text, turn_given.alias("turn"))
        call = F.struct(name(turn).alias("id"), F.when(at(17, 8), F.lit("shout")).otherwise(F.lit("reply")).alias("name"), arguments.alias("arguments"), after.alias("after"))
        return F.to_json(F.struct(F.array(call).alias("tool_calls")))

    answered = F.when(at(9, 4), turn - 3).otherwise(turn - 1)
    told = F.to_json(F.struct(name(answered).alias("tool_call_id"), F.col("text").alias("content")))
    said = F.when(F.col("role") == "user", F.when(at(7, 3), asked(turn.cast("string"))).otherwise(asked(turn))).when(F.col("role") == "assistant", told).otherwise(F.col("text"))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), said.alias("text"))


ORACLE = """
WITH RECURSIVE given AS (SELECT conv_id, turn, role, text, conv_id + turn AS s, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind FROM conversations),
rows AS MATERIALIZED (
  SELECT *, CASE kind WHEN 'call' THEN 1 ELSE 0 END AS idx,
         CASE kind WHEN 'call' THEN conv_id || '-' || turn WHEN 'result' THEN conv_id || '-' || (CASE WHEN s % 9 = 4 THEN turn - 3 ELSE turn - 1 END) END AS call_id,
         CASE WHEN s % 17 = 8 THEN 'shout' ELSE 'reply' END AS name, CASE WHEN s % 11 = 5 THEN NULL ELSE text END AS given_text,
         CASE WHEN kind <> 'call' THEN NULL WHEN conv_id % 10 = 4 AND turn IN (0, 2) THEN conv_id || '-' || (2 - turn) WHEN s % 5 = 2 THEN conv_id || '-' || (turn + 2) END AS after
  FROM given),
firsts AS MATERIALIZED (SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS asked, min(turn) FILTER (kind = 'result') AS told FROM rows WHERE call_id IS NOT NULL GROUP BY ALL),
nodes AS MATERIALIZED (SELECT conv_id, call_id, 'call' AS kind, asked AS turn, 1 AS idx FROM firsts WHERE asked IS NOT NULL UNION ALL SELECT conv_id, call_id, 'result', told, 0 FROM firsts WHERE told IS NOT NULL),
sizes AS MATERIALIZED (SELECT conv_id, count(*) AS n FROM nodes GROUP BY conv_id),
edges AS MATERIALIZED (
  SELECT conv_id, call_id AS src, 'call' AS src_kind, call_id AS dst, 'result' AS dst_kind FROM firsts WHERE asked IS NOT NULL AND told IS NOT NULL
  UNION SELECT conv_id, after, k, call_id, 'call' FROM rows, (VALUES ('call'), ('result')) AS v(k) WHERE after IS NOT NULL),
ways(conv_id, call_id, kind, turn, idx, rank) AS (
  SELECT conv_id, call_id, kind, turn, idx, 0 FROM nodes
  UNION SELECT w.conv_id, e.dst, e.dst_kind, w.turn, w.idx, w.rank + 1 FROM ways w JOIN edges e ON w.conv_id = e.conv_id AND w.call_id = e.src AND w.kind = e.src_kind
    JOIN nodes d ON d.conv_id = e.conv_id AND d.call_id = e.dst AND d.kind = e.dst_kind JOIN sizes z ON z.conv_id = w.conv_id WHERE w.rank < 2 * z.n),
places AS (SELECT conv_id, call_id, kind, max(rank) >= any_value(n) AS cyclic, max(struct_pack(turn := turn, idx := idx, rank := rank)) AS spot FROM ways JOIN sizes USING (conv_id) GROUP BY ALL),
stated AS (
  SELECT r.*, f.asked, f.told, p.spot, coalesce(p.cyclic, false) AS cyclic,
    CASE kind WHEN 'message' THEN 'message' WHEN 'call' THEN CASE WHEN r.turn <> f.asked THEN 'duplicate' WHEN f.told IS NULL THEN 'unanswered' ELSE 'linked' END
         ELSE CASE WHEN r.turn <> f.told THEN 'duplicate' WHEN f.asked IS NULL THEN 'orphan' ELSE 'linked' END END AS lone
  FROM rows r LEFT JOIN firsts f ON r.conv_id = f.conv_id AND r.call_id = f.call_id LEFT JOIN (SELECT * RENAME (kind AS of_kind) FROM places) p ON r.conv_id = p.conv_id AND r.call_id = p.call_id AND r.kind = p.of_kind),
placed AS (SELECT *, kind <> 'message' AND lone <> 'duplicate' AND NOT cyclic AS moves FROM stated)
SELECT conv_id, turn, idx::INTEGER AS idx, kind, call_id,
  CASE WHEN lone = 'linked' THEN CASE kind WHEN 'call' THEN told ELSE asked END END AS linked_turn,
  CASE WHEN cyclic AND lone <> 'duplicate' THEN 'cycle' ELSE lone END AS status,
  CASE WHEN kind <> 'call' THEN '' WHEN name = 'shout' THEN 'unknown tool' ELSE concat_ws('; ', CASE WHEN given_text IS NULL THEN 'missing: text' END, CASE WHEN s % 7 = 3 THEN 'type: turn' END, CASE WHEN s % 13 = 6 THEN 'unknown: note' END) END AS errors,
  CASE WHEN moves THEN spot.turn ELSE turn END AS order_turn, (CASE WHEN moves THEN spot.idx ELSE idx END)::INTEGER AS order_idx, (CASE WHEN moves THEN spot.rank ELSE 0 END)::INTEGER AS order_rank,
  CASE kind WHEN 'call' THEN '{"arguments":{' || concat_ws(',', CASE WHEN s % 13 = 6 THEN '"note":"x"' END, '"text":' || to_json(given_text)::VARCHAR, CASE WHEN s % 7 = 3 THEN '"turn":"' || turn || '"' ELSE '"turn":' || turn END)
                 || '},"id":"' || call_id || '","name":"' || name || '","role":"assistant","type":"call"}'
            WHEN 'result' THEN to_json({'content': text, 'id': call_id, 'role': 'tool', 'type': 'result'})::VARCHAR
            ELSE to_json({'content': text, 'role': role, 'type': 'message'})::VARCHAR END AS json
FROM placed
"""
