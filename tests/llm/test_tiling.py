import random
import unicodedata

import numpy as np
import pytest
from support import SF
from llm_data import ODD

from pixelframe.llm import tiling as g
from pixelframe.llm.queries import op6_decontamination


def tiles_by_hand(item, text, least):
    """Greedy string tiling by comparing every place with every place."""
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and item[i + n] >= 0 and free_i[i + n] and free_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, t, i)
        n, t, i = best
        if n < least:
            return sorted(out)
        for k in range(n):
            free_i[i + k] = free_t[t + k] = False
        out.append((i, t, n))


def test_tiles(spark):
    r = random.Random(0)
    for _ in range(150):
        item = np.array([r.randrange(4) for _ in range(r.randrange(1, 15))])
        text = np.array([r.randrange(-1, 4) for _ in range(r.randrange(1, 30))])
        least = r.randrange(1, 4)
        got, want = g.greedy_tiles(item, text, least), tiles_by_hand(item, text, least)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
        for i, t, n in got:
            assert (item[i : i + n] == text[t : t + n]).all()


def leaks_by_hand(docs, items, size=5, covered=0.6):
    out = set()
    for d, text in docs:
        words = g.words_of((text or "").encode())
        for k, item in items:
            own = g.words_of((item or "").encode())
            if own:
                ids = {w: n for n, w in enumerate(dict.fromkeys(words + own))}
                tiles = tiles_by_hand([ids[w] for w in own], [ids[w] for w in words], min(size, len(own)))
                if sum(n for *_, n in tiles) / len(own) >= covered:
                    out.add((d, k))
    return out


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the river bank at dawn."), (2, "two words"), (3, None), (4, ""), (5, "A longer passage about nothing in particular. It has a second sentence as well, and a third one follows it here. The end comes last of all things."), (None, "an item without any number at all")]
ITEM_DDL = "item_id bigint, text string, doc_id string"


def items_of(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], ITEM_DDL)


def texts():
    filler = " ".join(f"filler{k}" for k in range(80))
    a, b, c = ITEMS[4][1].split(". ")[0], ITEMS[4][1].split(". ")[1], ITEMS[4][1].split(". ")[2]
    return [
        (100, f"{filler} {ITEMS[0][1]} {filler}"), (101, filler), (102, f"{filler} THE QUICK, brown fox -- jumps over; the lazy dog {filler}"), (103, "two words"), (104, "two other words"),
        (105, f"{c} {filler} {b}. {filler} {a}"), (106, "the quick brown dog and the lazy fox near a river bank"), (107, ITEMS[5][1]), (108, f"{a} {filler}"),
    ]


def test_leaks(spark, docs_of):
    rows = [(i, t, "a") for i, t in texts()] + ODD
    got = g.find_leaks(docs_of(rows), items_of(spark)).collect()
    small = [(i, t) for i, t, _ in rows if len(t or "") < 5000]
    assert {(r.doc_id, r.item_id) for r in got} == leaks_by_hand(small, ITEMS)
    assert {(100, 1), (102, 1), (103, 2), (105, 5), (107, None)} <= {(r.doc_id, r.item_id) for r in got}
    for r in got:
        assert r.coverage >= 0.6 and r.n_tiles == len(r.tiles) and r.longest == max(x.n_words for x in r.tiles)
    kept = g.decontaminated(docs_of(rows), items_of(spark))
    bad = {r.doc_id for r in got}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, *_ in rows if i not in bad), key=str) and kept.columns == docs_of([]).columns


def test_many_items_are_joined_to_the_same_result(spark, docs_of):
    r = random.Random(6)
    items = [(k, " ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(20))) for k in range(40)]
    rows = [(k, " ".join([items[k][1], *(f"x{j}" for j in range(30)), items[k + 1][1]]), "a") for k in range(0, 38, 3)]
    whole = {(x.doc_id, x.item_id) for x in g.find_leaks(docs_of(rows), items_of(spark, items)).collect()}
    parts = {(x.doc_id, x.item_id) for x in g.find_leaks(docs_of(rows), items_of(spark, items), most_bytes=500).collect()}
    assert whole == parts and len(whole) >= 2 * len(rows)
    odd = docs_of([*ODD, *[(700 + k, f"{t} and {t}", "a") for k, (_, t) in enumerate(ITEMS) if t]])
    for full in (False, True):  # a filter that is full lets all windows through
        with pytest.MonkeyPatch.context() as m:
            m.setattr(g, "FILTER_BITS", 64 if full else 1 << 16)
            one, two = ([tuple(map(str, x)) for x in g.find_leaks(odd, items_of(spark, ITEMS + ITEMS[:2]), most_bytes=n).collect()] for n in (1 << 20, 10))
            assert sorted(one) == sorted(two) and len(one) > 5
    left = [sorted(str(x.doc_id) for x in g.decontaminated(odd, items_of(spark), most_bytes=n).collect()) for n in (1 << 20, 10)]
    assert left[0] == left[1] and g.find_leaks(docs_of([]), items_of(spark), most_bytes=1).count() == 0
    assert g.decontaminated(docs_of(rows), items_of(spark, items), most_bytes=500).count() == 0


def test_empty_tables(spark, docs_of):
    assert g.find_leaks(docs_of([]), items_of(spark)).count() == 0
    assert g.find_leaks(docs_of(ODD), items_of(spark, [])).count() == 0
    assert g.decontaminated(docs_of(ODD), items_of(spark, [])).count() == len(ODD)


FOREIGN = "Der Hörer übte größere Straßenübungen, während «l’été» à la fenêtre très éloignée déjà s’achève – où él cantó mañana"


@pytest.mark.parametrize("text", [FOREIGN.upper(), FOREIGN.title(), unicodedata.normalize("NFD", FOREIGN), FOREIGN.replace(" ", " “").replace(",", "”…")], ids=["upper", "title", "decomposed", "quoted"])
def test_case_accents_and_punctuation_beyond_ascii(spark, docs_of, text):
    items, rows = items_of(spark, [(1, FOREIGN)]), [(7, f"Vorher steht etwas. {text} – nachher auch", "a"), (8, "größere Übungen", "a")]
    assert [(r.doc_id, r.item_id, r.coverage) for r in g.find_leaks(docs_of(rows), items).collect()] == [(7, 1, 1.0)]
    assert [r.doc_id for r in g.decontaminated(docs_of(rows), items).collect()] == [8]


def folded(text):
    """Words by a walk over the characters, apart from the operator's own way."""
    out = "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFC", text.casefold()))
    return f" {' '.join(out.split())} "


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query_finds_every_passage_of_an_independent_fold(spark):
    docs, items = ({r[0]: folded(r.text) for r in spark.read.parquet(str(SF / f"{t}.parquet")).select(k, "text").collect()} for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r.doc_id, r.item_id) for r in op6_decontamination(spark, str(SF)).collect()}
    assert {(d, i) for d, t in docs.items() for i, p in items.items() if p in t} <= got


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query_finds_every_whole_passage(spark):
    docs = {r.doc_id: b" " + b" ".join(g.words_of(r.text.encode())) + b" " for r in spark.read.parquet(str(SF / "documents.parquet")).collect()}
    items = {r.item_id: b" " + b" ".join(g.words_of(r.text.encode())) + b" " for r in spark.read.parquet(str(SF / "benchmark.parquet")).collect()}
    whole = {(d, i) for d, t in docs.items() for i, p in items.items() if p in t}
    got = {(r.doc_id, r.item_id) for r in op6_decontamination(spark, str(SF)).collect()}
    assert whole <= got and len(got) <= len(whole) + 2


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query_against_a_brute_force_version(spark):
    """All pairs that share a run of five words, tiled by hand."""
    docs, items = ([(r[0], r.text) for r in spark.read.parquet(str(SF / f"{t}.parquet")).select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    runs = lambda text: {tuple(w[i : i + 5]) for w in [g.words_of(text.encode())] for i in range(len(w) - 4)}
    of_items = {i: runs(t) for i, t in items}
    want = set()
    for d in docs:
        own = runs(d[1])
        near = [(i, t) for i, t in items if own & of_items[i]]
        want |= leaks_by_hand([d], near) if near else set()
    assert {(r.doc_id, r.item_id) for r in op6_decontamination(spark, str(SF)).collect()} == want and len(want) >= 3
