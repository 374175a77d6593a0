import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from support import SF
from llm_data import ODD

from pixelframe.llm import simhash as s
from pixelframe.llm.components import components
from pixelframe.llm.queries import op4_simhash


def fingerprint(text, size=3):
    words, now = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c.lower() if "A" <= c <= "Z" else c
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for x in shingles:
        v = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            votes[b] += v >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, distance=2):
    prints = [(i, fingerprint(t)) for i, t, *_ in rows]
    fps = sorted({f for _, f in prints})
    top = roots(fps, [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= distance])
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[top[f]].append(i)
    return sorted(((i, f"{f:016x}", min(least[top[f]], default=None)) for i, f in prints), key=str)


def rows_of(df):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()), key=str)


def test_odd_rows(spark, docs_of):
    assert rows_of(s.near_duplicates(docs_of(ODD))) == brute(ODD)
    assert s.near_duplicates(docs_of([])).count() == 0


def test_copies_and_near_copies(spark, docs_of):
    r = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(30):
        base = [r.choice(words) for _ in range(r.randrange(40, 400))]
        for _ in range(6):
            text = list(base)
            for _ in range(r.randrange(3)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows), " ".join(text), "a"))
    r.shuffle(rows)
    assert rows_of(s.near_duplicates(docs_of(rows))) == brute(rows)


@pytest.mark.parametrize("dense", [2, 1000])
@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_have_the_components_of_all_pairs(spark, distance, dense):
    """Chains, stars and balls of fingerprints around random centres, with groups listed pair by pair or linked through points."""
    r = random.Random(distance)
    fps = set()
    for _ in range(40):
        at = r.getrandbits(64)
        for _ in range(r.choice([1, 3, 25])):
            fps.add(at)
            for b in r.sample(range(64), r.randrange(distance + 2)):
                at ^= 1 << b
    centre = r.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)} | {0, (1 << 64) - 1}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    links = [(a, b) for a, b in s.links_within(df, distance, dense).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= distance for a, b in links) or dense == 2
    got = roots([signed(f) for f in fps], links)
    ordered = sorted(map(signed, fps))
    want = roots(ordered, [(a, b) for k, a in enumerate(ordered) for b in ordered[:k] if ((a ^ b) & mask).bit_count() <= distance])
    assert got == want


def test_pigeonring_never_drops_a_pair_within_the_budget():
    r = np.random.default_rng(0)
    for n in (0, 5, 30, 52):
        bits = np.zeros((200, 256), np.uint8)
        for row in bits:
            row[r.choice(256, n, replace=False)] = 1
        assert s.pigeonring(np.packbits(bits, axis=1).view(np.uint16), 52).all()
    many = np.packbits(r.integers(0, 2, (200, 256), dtype=np.uint8), axis=1).view(np.uint16)
    assert s.pigeonring(many, 52).mean() < 0.5
    for distance in (1, 2, 3):
        for _ in range(300):
            x = sum(1 << int(b) for b in r.choice(64, distance, replace=False))
            assert any(s.chain_holds(np.array([x], np.uint64), k, distance)[0] for k in range(2 * distance + 1))


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100)] + [(1000, k) for k in range(2000, 2300)] + [(r.randrange(5000, 5400), r.randrange(5000, 5400)) for _ in range(260)] + [(7, 7), (9, 8), (8, 9)]
    got = {x.node: x.root for x in components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == roots(nodes, edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def mutated(r, words, share, vocabulary):
    return [r.choice(vocabulary) if r.random() < share else w for w in words]


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_similar_documents_are_found_and_others_left(spark, docs_of):
    r = random.Random(2)
    vocabulary = [f"v{k}" for k in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(55)]
    rows, of, clean = [], {}, set()
    for k in range(60):
        base = [r.choice(vocabulary) for _ in range(r.choice([30, 60, 120, 250, 700]))]
        of[len(rows)] = (len(rows), base)
        rows.append((len(rows), " ".join(base), "a"))
        for _ in range(3):
            other = mutated(r, base, 0.02, vocabulary)
            if jaccard(base, other) >= 0.8:
                of[len(rows)] = (of[len(rows) - 1][0], base)
                rows.append((len(rows), " ".join(other), "a"))
    for k in range(60):
        own = [r.choice(vocabulary) for _ in range(r.choice([100, 300]))]
        clean.add(len(rows))
        rows.append((len(rows), " ".join(own[:40] + passage + own[40:]), "a"))
    copies = [(10_000 + k, rows[0][1].upper() if k % 2 else rows[0][1], "a") for k in range(150)]
    kept = {x.doc_id for x in s.deduplicated(docs_of(rows + copies)).collect()}
    assert clean <= kept and not kept & {i for i, _, _ in copies}
    assert {b for b, _ in of.values()} <= kept
    near = [i for i, (b, _) in of.items() if i != b]
    assert len(near) > 80 and len(kept & set(near)) <= 0.03 * len(near)


def test_large_group_of_near_copies(spark, docs_of):
    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(2000)]
    base = [r.choice(vocabulary) for _ in range(200)]
    rows = [(0, " ".join(base), "a")]
    while len(rows) < 200:
        other = mutated(r, base, 0.015, vocabulary)
        if jaccard(base, other) >= 0.8:
            rows.append((len(rows), " ".join(other), "a"))
    assert [x.doc_id for x in s.deduplicated(docs_of(rows)).collect()] == [0]


def test_short_copies_just_over_the_similarity_are_all_found(spark, docs_of):
    """Copies of every length from 5 shingles to 64, with words appended or one changed, at the least Jaccard of 0.8 or more."""
    r = random.Random(3)
    vocabulary = [f"v{k}" for k in range(5000)]
    rows, copies = [], set()
    for n in [*range(4, 30), 40, 50, 64]:
        for _ in range(6):
            base = [r.choice(vocabulary) for _ in range(n + 4)]
            more = int(n / 0.8 + 1e-9) - n
            rows.append((len(rows), " ".join(base), "a"))
            copies.add(len(rows))
            rows.append((len(rows), " ".join(base + [r.choice(vocabulary) for _ in range(more)]), "a"))
            assert jaccard(base, rows[-1][1].split()) >= 0.8 and more
    apart = [(10_000 + k, " ".join([r.choice(vocabulary) for _ in range(k % 9)] + vocabulary[:6] + [r.choice(vocabulary) for _ in range(5)]), "a") for k in range(100)]
    kept = {x.doc_id for x in s.deduplicated(docs_of(rows + apart)).collect()}
    assert kept == {i for i, *_ in rows + apart} - copies


def cosine(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a, b))
    return len(a & b) / (len(a) * len(b)) ** 0.5


def components_of(texts, similarity=0.8):
    """Least member by member, over all pairs that share a shingle."""
    words = [t.encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    by = {}
    for i, x in enumerate(sets):
        for sh in x:
            by.setdefault(sh, []).append(i)
    shared = {}
    for at in by.values():
        for k, i in enumerate(at):
            for j in at[:k]:
                shared[j, i] = shared.get((j, i), 0) + 1
    return roots(range(len(texts)), [(i, j) for (i, j), n in shared.items() if n >= similarity * (len(sets[i]) * len(sets[j])) ** 0.5 - 1e-9])


def test_prefixes_of_short_sets_meet_surely():
    """Any two sets up to SHORT shingles, or one such and one longer, that have the cosine share a key."""
    r = np.random.default_rng(5)
    for _ in range(3000):
        n = int(r.integers(1, s.SHORT + 1))
        a = r.choice(2**32, n, replace=False).astype(np.uint32)
        shared = int(r.integers(max(1, int(0.6 * n)), n + 1))
        b = np.concatenate([a[:shared], r.choice(2**32, int(r.integers(0, n)), replace=False).astype(np.uint32)])
        a, b = np.unique(a), np.unique(b)
        if len(np.intersect1d(a, b)) >= 0.8 * (len(a) * len(b)) ** 0.5:
            assert set(s.keys_of(a, 0.8)) & set(s.keys_of(b, 0.8))


@pytest.mark.parametrize("n", [65, 90, 128, 250, 600, 3000])
def test_cells_of_sets_at_the_cosine_meet(n):
    r = np.random.default_rng(n)
    missed = 0
    for _ in range(1000):
        m = int(n * r.uniform(0.66, 1.5))
        shared = min(n, m, int(np.ceil(0.8 * (n * m) ** 0.5)))
        values = r.choice(2**32, n + m - shared, replace=False).astype(np.uint32)
        a, b = np.sort(values[:n]), np.sort(values[n - shared :])
        missed += not set(s.keys_of(a, 0.8)) & set(s.keys_of(b, 0.8))
    assert missed <= 8


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_no_link_of_the_test_table_is_lost(spark):
    """Exactly the components of all pairs with a cosine of 0.8 or more."""
    rows = spark.read.parquet(str(SF.parent / "sf0.01" / "documents.parquet")).select("doc_id", "text").orderBy("doc_id").collect()
    want = components_of([r.text or "" for r in rows])
    ids = {r.doc_id for r in s.similar_documents(spark.read.parquet(str(SF.parent / "sf0.01" / "documents.parquet"))).where("keeper").collect()}
    assert ids == {rows[v].doc_id for v in set(want.values())} and len(ids) < len(rows) - 50


def test_cluster_of_pairs_and_strays(spark, docs_of):
    """500 texts about one original at all distances around the similarity, with copies of their own: all links are found."""
    r = random.Random(21)
    vocabulary = [f"v{k}" for k in range(9000)]
    base = [r.choice(vocabulary) for _ in range(180)]
    texts = [base]
    while len(texts) < 500:
        at = base if r.random() < 0.7 else r.choice(texts)
        texts.append(mutated(r, at, r.choice([0.01, 0.025, 0.04, 0.06]), vocabulary))
    texts = [" ".join(t) for t in texts]
    want = components_of(texts)
    kept = {x.doc_id for x in s.deduplicated(docs_of([(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert kept == set(want.values()) and 20 < len(kept) < 400


@pytest.mark.parametrize("small", [1, 6])
def test_size_from_which_cells_are_large_does_not_matter(spark, docs_of, monkeypatch, small):
    """Groups without their original, of members about as far from one another as links reach; so any hub misses some."""
    r = random.Random(12)
    vocabulary = [f"v{k}" for k in range(9000)]
    rows = []
    for _ in range(30):
        base = [r.choice(vocabulary) for _ in range(200)]
        rows += [(len(rows) + k, " ".join(mutated(r, base, 0.024, vocabulary)), "a") for k in range(9)]
    docs = docs_of(rows, clash=False).cache()
    monkeypatch.setattr(s, "SMALL", 10**6)
    want = sorted(x.doc_id for x in s.deduplicated(docs).collect())
    monkeypatch.setattr(s, "SMALL", small)
    monkeypatch.setattr(s, "BLOCK", 4)
    assert sorted(x.doc_id for x in s.deduplicated(docs).collect()) == want and 30 < len(want) < len(rows)


def test_large_cell_of_several_groups_without_a_common_original(spark, docs_of):
    """40 pairs of near copies and a passage in all 80 texts; those of different pairs are unlike each other."""
    r = random.Random(11)
    vocabulary = [f"v{k}" for k in range(9000)]
    passage = [r.choice(vocabulary) for _ in range(260)]
    rows = []
    for k in range(40):
        own = [r.choice(vocabulary) for _ in range(240)]
        rows += [(2 * k, " ".join(passage + own), "a"), (2 * k + 1, " ".join(passage + mutated(r, own, 0.01, vocabulary)), "a")]
    texts = [t.split() for _, t, _ in rows]
    assert all(jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.85 for k in range(40)) and max(jaccard(texts[0], t) for t in texts[2:]) < 0.4
    assert sorted(x.doc_id for x in s.deduplicated(docs_of(rows)).collect()) == list(range(0, 80, 2))


def test_deduplicated_odd_rows(spark, docs_of):
    docs = docs_of(ODD)
    got = s.deduplicated(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id for r in got.collect()), key=str)
    # Texts without words are copies of one another; the smallest id stays.
    assert kept == sorted([1, 4, 5, 6, 7, 9, 10, 11, None], key=str)
    assert s.deduplicated(docs_of([])).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(SF / "documents.parquet")).collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in op4_simhash(spark, str(SF)).collect()), key=str)
    assert got == brute(rows)
