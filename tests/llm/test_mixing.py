from collections import Counter, defaultdict

import pytest
from support import SF, same
from llm_data import ODD
from pyspark.sql import functions as F

from pixelframe.llm import mixing as m
from pixelframe.llm.queries import ORACLE_SQL, op2_mixing


def filled(sizes: dict) -> dict:
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        rest, w = total - sum(full.values()), sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / w for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


def check(rows, docs):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * len(r.copies)
        largest[r.source] = max(largest[r.source], r.size)
        assert len(r.copies) <= 3 and [c.copy for c in r.copies] == list(range(len(r.copies)))
    want = filled(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(want[s] - taken[s]) <= largest[s] and taken[s] <= 3 * sizes[s]


def texts(n, source, words, start=0):
    return [(start + i, " ".join(["w"] * (words + i % 5)), source) for i in range(n)]


def test_odd_rows_and_targets(spark, docs_of):
    rows = [*ODD, *texts(40, "a", 3, 100), *texts(900, "z", 20, 1000), *texts(3, "tiny", 2, 5000)]
    got = m.assignments(docs_of(rows), shards=8).collect()
    assert len(got) == len(rows)
    check(got, rows)
    again = m.assignments(docs_of(rows), shards=8).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.copies))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert m.assignments(docs_of([])).count() == 0
    assert m.assignments(docs_of([(1, None, None), (2, "", None)])).where(F.size("copies") > 0).count() == 0


def test_small_sources_are_met_closely(spark, docs_of):
    import random

    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(1, 400)), f"s{i % 7}") for i in range(420)]
    got = m.assignments(docs_of(rows)).collect()
    check(got, rows)
    by = defaultdict(lambda: [0, 0.0])
    for x in got:
        by[x.source][0] += x.size * len(x.copies)
        by[x.source][1] = x.target
    assert all(abs(taken - target) <= 0.02 * target for taken, target in by.values())


def test_rows_that_repeat_an_id_are_taken_alike(spark, docs_of):
    rows = [*texts(30, "a", 5), *texts(60, "b", 7, 100), *[(7, "same words here", "a")] * 40]
    got = m.assignments(docs_of(rows)).collect()
    assert len(got) == len(rows) and all(len(x.copies) <= 3 for x in got)
    assert len({str(x.copies) for x in got if x.doc_id == 7 and x.size == 3}) == 1


def test_tree_deals_every_block_once(spark, docs_of):
    docs = docs_of([*texts(1500, "a", 9), *texts(1500, "b", 9, 2000), *texts(700, "c", 9, 5000)], clash=False)
    _, planned, _ = m._planned(docs, 16, "s")
    plan = planned.collect()
    total = [0] * 16
    for p in plan:
        counts = [b - a for a, b in zip([0, *p.ends], p.ends)]
        assert p.ends[-1] == p.quota and min(counts) >= 0
        total = [x + y for x, y in zip(total, counts)]
        # A hypergeometric count stays near its share.
        assert max(abs(c - p.quota / 16) for c in counts) < 6 * (p.quota / 16) ** 0.5 + 3
    assert max(total) - min(total) <= 4
    assert m.assignments(docs, 16, "s").select(F.explode("copies.shard").alias("x")).agg(F.countDistinct("x")).first()[0] == 16


def test_tree_against_selection_sampling_by_hand(spark):
    """The leaves' counts, by dealing single blocks from the hashes themselves."""
    from hashlib import md5

    quotas = [37, 0, 101, 64]
    planned = spark.createDataFrame(list(enumerate(quotas)), "rank bigint, quota bigint")
    got = {r.rank: list(r.ends) for r in m.split_tree(planned, 8, "x").collect()}
    number = lambda *parts: int(md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    nodes = {0: [i for i, q in enumerate(quotas) for _ in range(q)]}
    for level in range(3):
        below = {}
        for node, dealt in nodes.items():
            half = (len(dealt) + number("x", level, node, 0) % 2) // 2
            sides = [[], []]
            for at, source in enumerate(dealt, 1):
                left = number("x", level, node, at) * (len(dealt) - at + 1) < (half - len(sides[0])) << 32
                sides[not left].append(source)
            assert len(sides[0]) == half
            below |= {2 * node: sides[0], 2 * node + 1: sides[1]}
        nodes = below
    for i in range(4):
        ends, at = [], 0
        for node in range(8):
            at += nodes[node].count(i)
            ends.append(at)
        assert got[i] == ends


def test_draws_have_the_right_distribution(spark):
    n = 4000
    long = lambda v: F.lit(v).cast("long")
    rows = spark.range(n).select(m.drawn(F.array(long(4), long(6), long(5)), long(5), long(15), F.col("id"))[1].alias("x"))
    got = Counter(r.x for r in rows.collect())
    from math import comb

    for k in range(6):
        p = comb(6, k) * comb(9, 5 - k) / comb(15, 5)
        assert abs(got[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_passes_are_permutations_of_their_own(spark):
    for blocks in (1024, 2048):
        sources = spark.createDataFrame([("sa",), ("sb",), ("n",)], "source_key string").withColumn("orders", m.orders("s"))
        rows = sources.select("source_key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "orders")
        kinds = [m.place(F.col("b").cast("long"), F.col("orders")[k], blocks).alias(f"p{k}") for k in range(3)]
        seen = set()
        for key in ("sa", "sb", "n"):
            got = rows.where(F.col("source_key") == key).orderBy("b").select(*kinds).collect()
            for k in range(3):
                order = tuple(r[k] for r in got)
                assert sorted(order) == list(range(blocks)) and order != tuple(range(blocks))
                seen.add(order)
        assert len(seen) == 9


def test_shards_grow_with_the_words():
    assert m.shards_for(0) == m.shards_for(m.LEAST_SHARDS * m.SHARD_WORDS) == m.LEAST_SHARDS
    assert m.shards_for(m.LEAST_SHARDS * m.SHARD_WORDS + 1) == 2 * m.LEAST_SHARDS and m.blocks_for(256) == 4096


def test_mix_holds_what_is_assigned(spark, docs_of):
    rows = [*ODD, *texts(300, "z", 20, 1000)]
    docs = docs_of(rows)
    mixed = m.mix(docs, shards=4)
    assert mixed.columns == [c for c in docs.columns if c != "mix_shard"] + ["mix_shard", "mix_copy", "mix_place"]
    got = Counter((r.doc_id, r.mix_shard, r.mix_copy) for r in mixed.collect())
    want = Counter((r.doc_id, c.shard, c.copy) for r in m.assignments(docs, shards=4).collect() for c in r.copies)
    assert {k: v for k, v in got.items() if k[0] != 7} == {k: v for k, v in want.items() if k[0] != 7} and sum(got.values()) == sum(want.values())
    placed = mixed.select(F.spark_partition_id().alias("p"), "mix_shard", "mix_place").collect()
    assert all(r.p == r.mix_shard for r in placed)
    assert m.mix(docs_of([])).count() == 0


def test_shards_must_be_a_power_of_two(spark, docs_of):
    with pytest.raises(ValueError):
        m.assignments(docs_of(texts(3, "a", 2)), shards=6)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query(spark, duck):
    same(op2_mixing(spark, str(SF)), duck, ORACLE_SQL["op2_mixing"])
