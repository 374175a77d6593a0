"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of the document id. A source's share of the mix is a number of
passes over its blocks (each pass in an order of its own, drawn from the seed and the source) and a last,
partial pass that ends inside one block. That block is cut again by the hash, and what is still
wanted then is filled with the largest documents that fit, one at a time (:data:`FILLS`); so a source is met to
within half of the smallest of its documents that are left, or nearly. The blocks of a source, numbered along its passes, are its *quota*.

The output has ``shards`` shards, a power of two. A binary tree splits the quotas of all sources
among them: at each node half of the node's blocks go left, and how many of each source go left
is a draw from the multivariate hypergeometric distribution, exactly as if all blocks had been
shuffled together; no data moves for it. The leaf counts give every shard a run of consecutive
blocks of each permuted source, disjoint from all others, and the shard is shuffled locally.

All of it is DataFrame functions. Whether and where a document goes follows from its own hash and the
row of its source, so documents are neither ordered nor gathered; the tables of sources and tree nodes have a
row for each source and node, and a node has one number for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, whole_row

#: Most passes, parts of a block, documents that fill up at most.
MOST, PARTS, FILLS = 3, 1024, 3
#: Least shards and words of one beyond that; blocks of a source: at least so many, and so many a shard.
LEAST_SHARDS, SHARD_WORDS, LEAST_BLOCKS, SHARD_BLOCKS = 64, 1 << 28, 1024, 16


def word_count(text: str | Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(*parts: Column) -> Column:
    """32 hex digits from ``parts``, none of them null."""
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def digits(key: Column, start: int, n: int = 8) -> Column:
    return F.conv(F.substring(key, start, n), 16, 10).cast("long")


def source_key(source: str | Column = "source") -> Column:
    """Tells sources apart, null included."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def shards_for(words: int) -> int:
    """The power of two of shards with at most SHARD_WORDS words on average, LEAST_SHARDS at least."""
    return max(LEAST_SHARDS, 1 << max(0, -(-words // SHARD_WORDS) - 1).bit_length())


def blocks_for(shards: int) -> int:
    return max(LEAST_BLOCKS, SHARD_BLOCKS * shards)


def orders(seed: str) -> Column:
    """The numbers that permute the blocks in each pass of a source (column ``source_key``)."""
    out = []
    for k in range(MOST):
        h = digest(F.lit(seed), F.col("source_key"), F.lit(k))
        out.append(F.struct((digits(h, 1, 6) * 2 + 1).alias("f"), digits(h, 7, 6).alias("o"), (digits(h, 13, 6) * 2 + 1).alias("g"), digits(h, 19, 6).alias("p")))
    return F.array(*out)


def place(block: Column, order: Column, blocks: int) -> Column:
    """Where a block stands in a pass: two odd multiplications modulo the power of two, with a shift between them; one to one."""
    one = (block * order["f"] + order["o"]) % blocks
    two = one.bitwiseXOR(F.shiftright(one, blocks.bit_length() // 2))
    return (two * order["g"] + order["p"]) % blocks


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with ``rank``, ``weight`` and ``target``.

    Sources rank by code point, null last, and weigh 1, 2, 3, repeating. The targets share the sum
    of all sizes by weight; a target stops at ``MOST`` times its source's size and what is over is
    shared again. With sources in the order of the weight at which they are full, those before some
    place are full and the others share the rest, so one running sum finds the fixed point.

    The windows run over one row for each source.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", (F.col("rank") % 3 + 1).cast("long"))
    cap = F.col("source_size") * MOST
    full_at = cap / F.col("weight")
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = ranked.withColumn("full_at", full_at).withColumn("full", share > F.col("full_at"))
    in_full = lambda c: F.coalesce(F.sum(F.when(F.col("full"), c)).over(every), F.lit(0))
    rate = F.try_divide(F.sum("source_size").over(every) - in_full(cap), F.sum("weight").over(every) - in_full(F.col("weight")))
    target = F.when(F.col("full"), cap.cast("double")).otherwise(rate * F.col("weight"))
    return filled.withColumn("target", target).select("source", "source_size", "rank", "weight", "target")


def base_rows(docs: DataFrame, seed: str, blocks: int) -> list[Column]:
    """What a document's place in the mix follows from: source_key, size, mix_key, block and part."""
    key = digest(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return [source_key().alias("source_key"), word_count(F.col("text")).alias("size"), key.alias("mix_key"), (digits(key, 1) % blocks).alias("block"), (digits(key, 9) % PARTS).alias("part")]


def _first_over(sums: DataFrame, at: str, room: str) -> DataFrame:
    """(of, at, left): the first ``at`` of a source whose running sum of ``words`` is over ``room``, and the room left before it."""
    upto = Window.partitionBy("of").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("words").over(upto))
    ends = ends.where((F.col(room) < F.col("upto")) & (F.col(room) >= F.col("upto") - F.col("words")))
    return ends.select("of", at, (F.col(room) - F.col("upto") + F.col("words")).alias("left"))


def _in_partial(blocks: int) -> tuple[Column, Column]:
    """Where a row stands in the partial pass of its source, and whether it is before its end."""
    stands = place(F.col("block"), F.element_at("orders", F.least(F.col("whole"), F.lit(MOST - 1)) + 1), blocks)
    taken = (stands < F.col("stop")) | ((stands == F.col("stop")) & (F.col("part") < F.col("part_stop")))
    return stands, taken


def passes(base: DataFrame, planned: DataFrame, seed: str, blocks: int) -> DataFrame:
    """Adds to ``planned`` the whole passes, where the partial pass ends, and what fills it up.

    ``base``: see :func:`base_rows`. ``stop`` is the block that is taken in part, ``part_stop`` the first part of it that is
    not taken; ``fills`` are documents (size, mix_key) after that; ``room`` is what the mix stays under the target. Last, the
    smallest document that is too large is taken if the mix is nearer its target with it.
    A key that repeats among the rows fills up with all of them or not at all.
    """
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(F.lit(0)).cast("int")
    planned = planned.withColumn("source_key", source_key()).withColumn("orders", orders(seed)).withColumn("whole", whole)
    planned = planned.withColumn("rest", F.when((F.col("whole") < MOST) & (F.col("source_size") > 0), F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))))
    planned = staged(planned, "mix-sources")

    def joined(state: DataFrame, *columns: str) -> DataFrame:
        return base.join(state.where(F.col("rest").isNotNull()).select(F.col("source_key").alias("of"), "orders", "whole", *columns), F.col("source_key") == F.col("of"))

    def with_found(state: DataFrame, found: DataFrame) -> DataFrame:
        return state.join(found, F.col("source_key") == F.col("of"), "left").drop("of")

    stands, taken = _in_partial(blocks)
    sums = joined(planned, "rest").groupBy("of", "rest", stands.alias("stop")).agg(F.sum("size").alias("words"))
    state = staged(with_found(planned, _first_over(sums, "stop", "rest")).withColumnRenamed("left", "room"), "mix-blocks")
    sums = joined(state, "stop", "room").where(stands == F.col("stop")).groupBy("of", "room", F.col("part").alias("part_stop")).agg(F.sum("size").alias("words"))
    state = with_found(state, _first_over(sums, "part_stop", "room")).withColumn("room", F.coalesce("left", "room")).drop("left")
    kind = "struct<size:bigint,mix_key:string>"
    state = staged(state.withColumn("fills", F.array().cast(f"array<{kind}>")).withColumn("below", F.lit(None).cast(kind)), "mix-parts")
    own = F.struct("size", "mix_key")
    for k in range(FILLS + 1):
        over = k == FILLS
        free = joined(state, "stop", "part_stop", "room", "below", "fills").where(~taken & (F.col("size") > 0))
        if over:
            best = free.where((F.col("size") > F.col("room")) & ~F.array_contains("fills", own)).groupBy("of").agg(F.min(own).alias("best"))
        else:
            best = free.where((F.col("size") <= F.col("room")) & (F.col("below").isNull() | (own < F.col("below")))).groupBy("of").agg(F.max(own).alias("best"))
        picked = best.select(F.col("of").alias("in"), "best")
        often = free.join(picked, (F.col("of") == F.col("in")) & (F.col("size") == F.col("best.size")) & (F.col("mix_key") == F.col("best.mix_key"))).groupBy("of", "best").agg(F.count("*").alias("times"))
        need = F.col("best.size") * F.col("times")
        fits = F.coalesce(need - F.col("room") < F.col("room") if over else need <= F.col("room"), F.lit(False))
        state = with_found(state, often).withColumn("fills", F.when(fits, F.concat("fills", F.array("best"))).otherwise(F.col("fills"))).withColumn("room", F.when(fits, F.col("room") - need).otherwise(F.col("room")))
        state = staged(state.withColumn("below", F.coalesce("best", "below")).drop("best", "times"), f"mix-fill-{k}")
    quota = F.col("whole").cast("long") * blocks + F.coalesce(F.col("stop") + 1, F.lit(0))
    return state.drop("below").withColumn("quota", quota)


def _goes_left(state_hits: Column, at: Column, half: Column, total: Column, *seeds: Column) -> Column:
    """Whether block ``at`` of ``total`` (from 1) is among the ``half`` that go left, after as many hits: selection sampling."""
    return digits(digest(*seeds, at), 1) * (total - at + 1) < (half - state_hits) * F.lit(1 << 32)


def drawn(quotas: Column, half: Column, total: Column, *seeds: Column) -> Column:
    """How many blocks of each source are among ``half`` of all: a draw from the multivariate hypergeometric distribution."""
    start = F.struct(F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def one(state: Column, q: Column) -> Column:
        steps = F.when(q > 0, F.sequence(state["at"] + 1, state["at"] + q)).otherwise(F.array().cast("array<bigint>"))
        hits = F.aggregate(steps, state["hits"], lambda h, at: h + F.when(_goes_left(h, at, half, total, *seeds), F.lit(1)).otherwise(F.lit(0)).cast("long"))
        return F.transform(F.array(hits), lambda h: F.struct(h.alias("hits"), (state["at"] + q).alias("at"), F.concat(state["out"], F.array(h - state["hits"])).alias("out")))[0]

    return F.aggregate(quotas, start, one, lambda s: s["out"])


def split_tree(planned: DataFrame, shards: int, seed: str) -> DataFrame:
    """(rank, ends): for each source the block number at which each shard's run ends, in the order of the shards.

    A node is a row with the quotas of all sources; each of the log2(shards) levels splits every
    node in two. The number of rows is that of the nodes, whatever the data.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "quota")))
    nodes = planned.agg(ordered.alias("q")).select(F.lit(0).cast("long").alias("node"), F.transform("q", lambda x: x["rank"]).alias("ranks"), F.transform("q", lambda x: x["quota"]).alias("q"))
    for level in range(shards.bit_length() - 1):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        # Of an odd number of blocks, the side that gets one more is drawn too.
        odd = digits(digest(F.lit(seed), F.lit(level), F.col("node"), F.lit(0)), 1) % 2
        nodes = nodes.withColumn("total", total).withColumn("half", F.shiftright(F.col("total") + odd, 1))
        nodes = nodes.withColumn("lefts", drawn(F.col("q"), F.col("half"), F.col("total"), F.lit(seed), F.lit(level), F.col("node")))
        rights = F.zip_with("q", "lefts", lambda a, b: a - b)
        nodes = nodes.select("ranks", F.posexplode(F.array("lefts", rights)).alias("side", "child"), "node").select((F.col("node") * 2 + F.col("side")).alias("node"), "ranks", F.col("child").alias("q"))
    leaves = nodes.select("node", F.explode(F.arrays_zip("ranks", "q")).alias("x")).select("node", F.col("x.ranks").alias("rank"), F.col("x.q").alias("q"))
    by = leaves.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("node", "q"))).alias("runs"))
    running = F.aggregate("runs", F.array().cast("array<bigint>"), lambda out, x: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + x["q"])))
    return by.select("rank", running.alias("ends"))


def shard_of(number: Column, ends: str, shards: int) -> Column:
    """The shard whose run holds block ``number``: a walk down the tree, one comparison a level."""
    steps = [1 << k for k in range(shards.bit_length() - 2, -1, -1)]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.element_at(ends, low + step) <= number, low + step).otherwise(low))


def plan(base: DataFrame, sizes: DataFrame, shards: int, seed: str) -> DataFrame:
    """One row for each source of ``sizes`` (source, source_size): its target, passes, fills and shard ends."""
    blocks = blocks_for(shards)
    planned = staged(passes(base, targets(sizes), seed, blocks), "mix-passes")
    return staged(planned.join(split_tree(planned, shards, seed), "rank"), "mix-plan")


def assigned(rows: DataFrame, planned: DataFrame, shards: int, seed: str) -> DataFrame:
    """``rows`` (see :func:`base_rows`) with source_size, target and ``copies``: an array of (copy, shard, place)."""
    blocks = blocks_for(shards)
    named = planned.select(F.col("source_key").alias("mix_source"), "source_size", "target", "orders", "whole", "stop", "part_stop", "fills", "quota", "ends")
    joined = rows.join(named, F.col("source_key") == F.col("mix_source"))
    stands, taken = _in_partial(blocks)
    fills = F.array_contains("fills", F.struct("size", "mix_key"))
    joined = joined.withColumn("fill", F.coalesce(~taken & fills, F.lit(False))).withColumn("again", (F.coalesce(taken, F.lit(False)) | F.col("fill")).cast("int"))
    joined = joined.withColumn("again", F.when(F.col("whole") < MOST, F.col("again")).otherwise(F.lit(0)))

    def number(k: Column) -> Column:
        # What fills up stands in a block after the quota; it goes to some block of it.
        strange = F.pmod(digits(F.col("mix_key"), 17), F.greatest(F.col("quota"), F.lit(1)))
        plain = k.cast("long") * blocks + place(F.col("block"), F.element_at("orders", k + 1), blocks)
        return F.when(F.col("fill") & (k == F.col("whole")), strange).otherwise(plain)

    passes_of = F.when(F.col("whole") + F.col("again") > 0, F.sequence(F.lit(0), F.col("whole") + F.col("again") - 1)).otherwise(F.array().cast("array<int>"))
    copies = F.transform(passes_of, lambda k: F.struct(k.alias("copy"), shard_of(number(k), "ends", shards).cast("int").alias("shard"), digits(digest(F.lit(seed), F.col("mix_key"), k), 1, 15).alias("place")))
    return joined.withColumn("copies", copies).drop("mix_source", "orders", "whole", "stop", "part_stop", "fills", "quota", "ends", "fill", "again")


def _planned(docs: DataFrame, shards: int | None, seed: str) -> tuple[DataFrame, DataFrame, int]:
    """The narrow rows of all documents with their ids, the plan, and the number of shards."""
    words = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-words")
    sizes = words.groupBy("source").agg(F.sum("size").alias("source_size"))
    if shards is None:
        shards = shards_for(words.agg(F.sum("size")).first()[0] or 0)
    _, _, *parts = base_rows(docs, seed, blocks_for(shards))
    base = words.select("doc_id", "source", source_key().alias("source_key"), "size", *parts)
    return base, plan(base, sizes, shards, seed), shards


def assignments(docs: DataFrame, shards: int | None = None, seed: str = "mix") -> DataFrame:
    """What the mix takes from each row of ``docs`` (doc_id, text, source), without the texts.

    Returns doc_id, source, size, source_size, target and ``copies``, an array of (copy, shard,
    place) with one entry for each time the document is in the mix (at most ``MOST``). ``shards``: a power of two, or by
    the number of words (:func:`shards_for`).

    Nulls: a null source is a source of its own, ranked last; a null text has no words; a null id
    hashes as the empty string. Texts without words have size 0 and go along with their block.
    Repeated rows are rows of their own and taken alike, so a source of which one id is a large part may end as far from its
    target. Ties of weight end at the lower code point; of documents of one
    size the one of the greatest hash fills up first. Other columns are not read. An empty
    table gives an empty result. Reruns agree: all draws are hashes of ``seed`` and ids.
    """
    base, planned, shards = _planned(docs, shards, seed)
    return assigned(base, planned, shards, seed).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, shards: int | None = None, seed: str = "mix") -> DataFrame:
    """The mixed documents: every column of ``docs`` and mix_shard, mix_copy, mix_place; repeats are rows.

    Shards are partitions, shuffled locally by ``mix_place``. A column of ``docs`` with one of these
    three names is replaced. Otherwise as :func:`assignments`.
    """
    _, planned, shards = _planned(docs, shards, seed)
    document = whole_row(docs.drop("mix_shard", "mix_copy", "mix_place"), "document")
    rows = docs.select(*base_rows(docs, seed, blocks_for(shards)), document)
    taken = assigned(rows, planned, shards, seed).select("document", F.explode("copies").alias("c"))
    out = taken.select("document.*", F.col("c.shard").alias("mix_shard"), F.col("c.copy").alias("mix_copy"), F.col("c.place").alias("mix_place"))
    return out.repartitionById(shards, F.col("mix_shard")).sortWithinPartitions("mix_place")


def _oracle(seed: str = "mix", shards: int = LEAST_SHARDS) -> str:
    """DuckDB: the whole mix, tree included, for a corpus of at most LEAST_SHARDS * SHARD_WORDS words."""
    blocks = blocks_for(shards)
    hexed = lambda h, at, n=8: f"('0x' || substr({h}, {at}, {n}))::BIGINT"
    half = blocks.bit_length() // 2

    def placed(block: str, order: str) -> str:
        one = f"(({block} * {order}.f + {order}.o) % {blocks})"
        return f"((xor({one}, {one} >> {half}) * {order}.g + {order}.p) % {blocks})"

    def over(name: str, sums: str, at: str, room: str) -> str:
        return f"""{name} AS (SELECT source_key, {at}, {room} - upto + words AS left_ FROM (SELECT *, sum(words) OVER (PARTITION BY source_key ORDER BY {at} ROWS UNBOUNDED PRECEDING) AS upto FROM {sums})
          WHERE {room} < upto AND {room} >= upto - words)"""

    order = lambda k: f"{{'f': {hexed(f'h{k}', 1, 6)} * 2 + 1, 'o': {hexed(f'h{k}', 7, 6)}, 'g': {hexed(f'h{k}', 13, 6)} * 2 + 1, 'p': {hexed(f'h{k}', 19, 6)}}}"
    fills, state = [], "parts0"
    for k in range(FILLS + 1):
        over_ = k == FILLS
        which = "s.size > p.room AND NOT list_contains(p.fills, {'size': s.size, 'mix_key': s.mix_key})" if over_ else "s.size <= p.room AND (p.below IS NULL OR s.size < p.below.size OR (s.size = p.below.size AND s.mix_key < p.below.mix_key))"
        down, fit = ("ASC", "bs * times - room < room") if over_ else ("DESC", "bs * times <= room")
        fills.append(f"""free{k} AS (SELECT s.source_key, s.size, s.mix_key FROM stood s JOIN {state} p USING (source_key) WHERE p.rest IS NOT NULL AND NOT (s.stands < p.stop OR (s.stands = p.stop AND s.part < p.part_stop))
            AND s.size > 0 AND {which}),
          best{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY bs {down}, bk {down}) AS n FROM (SELECT source_key, size AS bs, mix_key AS bk, count(*) AS times FROM free{k} GROUP BY source_key, size, mix_key)) WHERE n = 1),
          fill{k} AS (SELECT p.* REPLACE (CASE WHEN {fit} THEN list_append(fills, {{'size': bs, 'mix_key': bk}}) ELSE fills END AS fills, CASE WHEN {fit} THEN room - bs * times ELSE room END AS room,
            CASE WHEN bs IS NULL THEN below ELSE {{'size': bs, 'mix_key': bk}} END AS below) FROM {state} p LEFT JOIN best{k} USING (source_key))""")
        state = f"fill{k}"
    levels, nodes = [], "node0"
    for level in range(shards.bit_length() - 1):
        here = f"concat_ws(':', '{seed}', {level}, node, x)"
        hit = f"{hexed(f'md5({here})', 1)} * (total - x + 1) < (half - h) * 4294967296"
        levels.append(f"""half{level} AS MATERIALIZED (SELECT *, (total + {hexed(f"md5(concat_ws(':', '{seed}', {level}, node, 0))", 1)} % 2) >> 1 AS half FROM (SELECT *, list_sum(q)::BIGINT AS total FROM {nodes})),
          hits{level} AS MATERIALIZED (SELECT node, q, i, list_reduce(list_concat([0::BIGINT], range(1, (list_sum(q[1:i]) + 1)::BIGINT)), lambda h, x: h + CASE WHEN {hit} THEN 1 ELSE 0 END) AS hits FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM half{level})),
          left{level} AS MATERIALIZED (SELECT node, q, list(hits - before ORDER BY i) AS lefts FROM (SELECT *, lag(hits, 1, 0) OVER (PARTITION BY node ORDER BY i) AS before FROM hits{level}) GROUP BY node, q),
          node{level + 1} AS MATERIALIZED (SELECT node * 2 AS node, lefts AS q FROM left{level} UNION ALL SELECT node * 2 + 1, list_transform(list_zip(q, lefts), lambda z: z[1] - z[2]) FROM left{level})""")
        nodes = f"node{level + 1}"
    return rf"""
WITH base AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS mix_key FROM documents),
blocked AS (SELECT *, {hexed("mix_key", 1)} % {blocks} AS block, {hexed("mix_key", 9)} % {PARTS} AS part FROM base),
sources AS (SELECT source, source_key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM base GROUP BY source, source_key),
weighed AS (SELECT *, (rank % 3 + 1)::BIGINT AS weight, (source_size * {MOST}) / (rank % 3 + 1)::DOUBLE AS full_at FROM sources),
ordered AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * {MOST}) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE > full_at AS is_full
  FROM weighed WINDOW before AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rated AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * {MOST}) FILTER (is_full) OVER (), 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) FILTER (is_full) OVER (), 0))::DOUBLE AS rate FROM ordered),
planned AS (SELECT source_key, source_size, rank, CASE WHEN is_full THEN (source_size * {MOST})::DOUBLE ELSE rate * weight END AS target FROM rated),
hashed AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MOST}) ELSE 0 END::INT AS whole, {", ".join(f"md5(concat_ws(':', '{seed}', source_key, {k})) AS h{k}" for k in range(MOST))} FROM planned),
state0 AS (SELECT source_key, source_size, rank, target, whole, [{", ".join(map(order, range(MOST)))}] AS orders,
  CASE WHEN whole < {MOST} AND source_size > 0 THEN greatest(target - whole * source_size, 0) END AS rest FROM hashed),
stood AS MATERIALIZED (SELECT b.*, {placed("b.block", f"s.orders[least(s.whole, {MOST - 1}) + 1]")} AS stands FROM blocked b JOIN state0 s USING (source_key)),
sums1 AS (SELECT source_key, rest, stands AS stop, sum(size)::BIGINT AS words FROM stood JOIN state0 USING (source_key) WHERE rest IS NOT NULL GROUP BY ALL),
{over("ends1", "sums1", "stop", "rest")},
state1 AS MATERIALIZED (SELECT s.*, e.stop, e.left_ AS room FROM state0 s LEFT JOIN ends1 e USING (source_key)),
sums2 AS (SELECT source_key, room, part AS part_stop, sum(size)::BIGINT AS words FROM stood JOIN state1 USING (source_key) WHERE rest IS NOT NULL AND stands = stop GROUP BY ALL),
{over("ends2", "sums2", "part_stop", "room")},
parts0 AS MATERIALIZED (SELECT s.* REPLACE (coalesce(e.left_, room) AS room), e.part_stop, []::STRUCT(size BIGINT, mix_key VARCHAR)[] AS fills, NULL::STRUCT(size BIGINT, mix_key VARCHAR) AS below FROM state1 s LEFT JOIN ends2 e USING (source_key)),
{", ".join(fills)},
quotas AS MATERIALIZED (SELECT *, whole::BIGINT * {blocks} + coalesce(stop + 1, 0) AS quota FROM {state}),
node0 AS (SELECT 0::BIGINT AS node, list(quota ORDER BY rank) AS q FROM quotas),
{", ".join(levels)},
ends AS (SELECT (i - 1)::BIGINT AS rank, list(ending ORDER BY node) AS ends FROM (SELECT node, i, sum(q[i]) OVER (PARTITION BY i ORDER BY node ROWS UNBOUNDED PRECEDING)::BIGINT AS ending FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM {nodes})) GROUP BY i),
judged AS (SELECT s.doc_id, s.size, s.mix_key, s.block, p.source_size, p.target, p.orders, p.whole, p.quota, e.ends, p.whole < {MOST} AND coalesce(s.stands < p.stop OR (s.stands = p.stop AND s.part < p.part_stop), false) AS taken,
  p.whole < {MOST} AND list_contains(p.fills, {{'size': s.size, 'mix_key': s.mix_key}}) AS fills FROM stood s JOIN quotas p USING (source_key) JOIN ends e USING (rank)),
filled AS (SELECT *, fills AND NOT taken AS fill, whole + (taken OR fills)::INT AS n FROM judged)
SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken,
  array_to_string(list_transform(range(0, n), lambda k: len(list_filter(ends, lambda e: e <= CASE WHEN fill AND k = whole THEN {hexed("mix_key", 17)} % greatest(quota, 1) ELSE k * {blocks} + {placed("block", "orders[k + 1]")} END))::VARCHAR), ',') AS shards,
  array_to_string(list_transform(range(0, n), lambda k: {hexed(f"md5(concat_ws(':', '{seed}', mix_key, k))", 1, 15)}::VARCHAR), ',') AS places
FROM filled
"""


ORACLE = _oracle()
