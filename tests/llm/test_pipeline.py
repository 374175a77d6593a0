import pytest
from support import SF
from llm_data import ODD

import corpus_pipeline as p
from pixelframe.llm import mixing, pu, simhash, tiling


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    d, columns = str(SF), docs.columns
    labels, items = (spark.read.parquet(str(SF / f"{t}.parquet")) for t in ("labels", "benchmark"))
    kept, described = p.quality(spark, docs, d).cache(), pu.features(docs)
    good = {r.doc_id for r in pu.score(described, pu.train(described, labels)).where("predicted = 1").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good
    one = p.near_duplicates(spark, kept, d).cache()
    ids = {r.doc_id for r in simhash.similar_documents(kept).where("keeper").collect()}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == ids
    texts = [r.text for r in one.collect()]
    assert len(set(texts)) == len(texts)
    clean = p.decontamination(spark, one, d).cache()
    leaks = {r.doc_id for r in tiling.find_leaks(one, items).collect()}
    assert {r.doc_id for r in clean.collect()} == ids - leaks
    safe = p.secrets(spark, clean, d).cache()
    assert safe.columns == columns and safe.count() == clean.count()
    mixed = p.mixing_stage(spark, safe, d)
    want = sum(len(r.copies) for r in mixing.assignments(safe).collect())
    assert mixed.count() == want and mixed.columns[: len(columns)] == columns


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_stand_odd_rows(spark, docs_of, rows):
    docs = docs_of(rows)
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(SF))
        assert out.count() <= 3 * len(rows), name
        if stage is not p.mixing_stage:
            assert out.columns == docs.columns, name


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_run(spark):
    out = p.run(spark, str(SF))
    assert out.count() > 0 and {"doc_id", "text", "mix_shard", "mix_copy", "mix_place"} <= set(out.columns)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_stages_against_brute_force_versions(spark):
    """What stays after each filtering stage, and what the texts become, by the plain versions of the operators' tests."""
    from test_ledger import by_hand, versions
    from test_simhash import components_of
    from test_tiling import leaks_by_hand

    from pixelframe.llm import ledger

    d = str(SF)
    docs = spark.read.parquet(str(SF / "documents.parquet")).cache()
    rows = {r.doc_id: r.text for r in docs.orderBy("doc_id").collect()}
    ids = sorted(rows)
    roots = components_of([rows[i] or "" for i in ids])
    assert {r.doc_id for r in p.near_duplicates(spark, docs, d).select("doc_id").collect()} == {ids[v] for v in set(roots.values())}
    items = [(r.item_id, r.text) for r in spark.read.parquet(str(SF / "benchmark.parquet")).collect()]
    runs = lambda text: {tuple(w[i : i + 5]) for w in [tiling.words_of((text or "").encode())] for i in range(len(w) - 4)}
    near = {i: runs(t) for i, t in items}
    leaks = set()
    for i in ids:
        own = runs(rows[i])
        some = [x for x in items if own & near[x[0]]]
        leaks |= {a for a, _ in leaks_by_hand([(i, rows[i])], some)} if some else set()
    assert {r.doc_id for r in p.decontamination(spark, docs, d).select("doc_id").collect()} == set(ids) - leaks
    spans = {r.path: [(s.start, s.end) for s in r.spans] for r in ledger.scan(versions(docs))[0].collect()}
    for r in p.secrets(spark, docs, d).collect():
        assert {s[1:] for s in by_hand(rows[r.doc_id])} <= set(spans[r.doc_id])
        hidden = set().union(*(range(a, b) for a, b in spans[r.doc_id])) if spans[r.doc_id] else set()
        want, at, text = "", 0, rows[r.doc_id] or ""
        while at < len(text):
            if at in hidden and (at - 1 not in hidden or any(a == at and not any(x < a < y for x, y in spans[r.doc_id]) for a, _ in spans[r.doc_id])):
                want += "[SECRET]"
            if at not in hidden:
                want += text[at]
            at += 1
        assert r.text == (want if rows[r.doc_id] is not None else None) and r.n_chars == len(r.text or "")
