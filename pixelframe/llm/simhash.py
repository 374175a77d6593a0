"""SimHash near-duplicates by the pigeonring principle.

*Small radius* (:func:`near_duplicates`). Two 64-bit fingerprints within distance t are cut into
a ring of m = 2t + 1 segments. Were they further apart than the proportional budget on some prefix
of every chain of consecutive segments, the distances would sum to more than t; so there is a chain
whose first l segments differ in at most l*t/m bits, for every l. The first two segments of that chain
are then equal: they are the join key. The rest of the chain is tested before the full distance.
Only distinct fingerprints take part. A key with few fingerprints has all its pairs tested; one
with many (:data:`DENSE`) is linked without pairs, through the points half way between: fingerprints
are within t exactly if they share a point within t//2 of one and t - t//2 of the other. Either way no link
is lost, and the work is linear in the fingerprints.

*Given similarity* (:func:`similar_documents`). Similarity is the cosine of the documents' sets of shingles. At 0.8 a
fifth of all fingerprint bits differ, so no two equal segments are left that could serve as a key. There the ring is
made of cells: the document's shingles are dealt by hash into cells of a few shingles each, and a cell's signature
changes only with its own shingles. Documents that share a cell are candidates; short documents, whose cells say
little, share one of their first shingles by hash (a prefix filter, exact). Pigeonring over 64-bit segments of 1024-bit
fingerprints prunes the candidates, the full Hamming test follows, with room for the fingerprints' own error, and what
is left is compared exactly. A key that many documents share has not all its pairs listed: see :func:`similar_links`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, filter_of, may_hold, staged, text_bytes, whole_row
from .components import components

SEED, BITS, DENSE = 42, 64, 64
_STEP = 1 << 16


def shingles_of(raw: bytes | None, size: int) -> list[bytes]:
    """Shingles of ``size`` words of the text with A-Z lower-cased, repeats included; all words if they are fewer."""
    words = raw.lower().split() if raw else []
    if not words:
        return []
    if len(words) < size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def hashes_of(shingles: list[bytes], seed: int = SEED) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))


def fingerprint_of(hashes: np.ndarray) -> np.ndarray:
    """One bit for each bit of the rows of ``hashes`` (n or n x words): set where over half have it. Zero if n is 0."""
    rows = (hashes if hashes.ndim == 2 else hashes[:, None]).astype("<u8", copy=False)
    votes = np.zeros(rows.shape[1] * 64, np.int64)
    for at in range(0, len(rows), _STEP):
        bits = np.unpackbits(np.ascontiguousarray(rows[at : at + _STEP]).view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(rows), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(id, fp) for each row: the 64-bit SimHash as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns_of(batches, id_col, "text"):
            found = [fingerprint_of(hashes_of(shingles_of(t, shingle)))[0] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col), text_bytes()).mapInArrow(run, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- small radius


def ring(distance: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of the 2*distance + 1 segments."""
    m = 2 * distance + 1
    ends = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def chain_holds(differ: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Which of the XORs stay, from segment ``start`` on, within l*distance/m at every length l of the chain."""
    segments = ring(distance)
    m, total, ok = len(segments), np.zeros(len(differ), np.int64), np.ones(len(differ), bool)
    for length in range(1, m + 1):
        shift, width = segments[(start + length - 1) % m]
        total += np.bitwise_count((differ >> np.uint64(shift)) & np.uint64((1 << width) - 1))
        ok &= total * m <= length * distance
    return ok


def _keyed(distinct: DataFrame, distance: int) -> DataFrame:
    """Each fingerprint once for each start of a chain, with the chain's first two segments as key."""
    segments = ring(distance)
    m = len(segments)
    part = lambda i: F.shiftrightunsigned("fp", segments[i % m][0]).bitwiseAND(F.lit((1 << segments[i % m][1]) - 1))
    rows = [F.struct(F.lit(i).alias("start"), (F.shiftleft(part(i), segments[(i + 1) % m][1]).bitwiseOR(part(i + 1))).alias("key")) for i in range(m)]
    return distinct.select("fp", F.explode(F.array(*rows)).alias("k")).select("fp", F.col("k.start").alias("start"), F.col("k.key").alias("key"))


def _links(distance: int, dense: int):
    """Streams sorted keys: links of small groups (a, b, near null), points of dense ones (a: point, b: fingerprint)."""
    near, far = distance // 2, distance - distance // 2
    segments = ring(distance)
    m = len(segments)

    def pairs(start: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.triu_indices(len(group), 1)
        differ = group[i] ^ group[j]
        ok = chain_holds(differ, start, distance)
        ok[ok] = np.bitwise_count(differ[ok]) <= distance
        return group[i][ok], group[j][ok]

    def points(start: int, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        in_key = {start, (start + 1) % m}
        free = [s + k for x, (s, w) in enumerate(segments) if x not in in_key for k in range(w)]
        for radius in range(far + 1):
            masks = np.array([sum(1 << b for b in chosen) for chosen in combinations(free, radius)], np.uint64)
            for at in range(0, len(fps), 256):
                some = fps[at : at + 256]
                yield (some[:, None] ^ masks[None, :]).ravel(), np.repeat(some, len(masks)), radius <= near

    def batch(a: np.ndarray, b: np.ndarray, is_near: bool | None) -> pa.RecordBatch:
        flag = pa.array([is_near] * len(a), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64)), flag], names=["a", "b", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None
        group = np.zeros(0, np.uint64)
        streaming = False

        def close() -> Iterator[pa.RecordBatch]:
            if held is not None and not streaming and len(group) > 1:
                a, b = pairs(held[0], group)
                if len(a):
                    yield batch(a, b, None)

        for x in batches:
            start, key = x.column(0).to_numpy(), x.column(1).to_numpy()
            fps = x.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(key) != 0)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(fps)], strict=True):
                if at == end:
                    continue
                now = (int(start[at]), int(key[at]))
                if now != held:
                    yield from close()
                    held, group, streaming = now, np.zeros(0, np.uint64), False
                more = fps[at:end]
                if streaming:
                    yield from (batch(*p) for p in points(now[0], more))
                    continue
                group = np.concatenate([group, more])
                if len(group) > dense:
                    yield from (batch(*p) for p in points(now[0], group))
                    group, streaming = np.zeros(0, np.uint64), True
        yield from close()

    return run


def links_within(distinct: DataFrame, distance: int, dense: int = DENSE) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints ``fp`` within ``distance`` bits of one another.

    Of a dense group not every pair is listed, but its links have the same components.
    """
    if not 0 <= distance <= 8:
        raise ValueError("distance must be from 0 to 8")
    if distance == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    keyed = _keyed(distinct, distance).select("start", "key", "fp")
    found = keyed.repartition("start", "key").sortWithinPartitions("start", "key", "fp").mapInArrow(_links(distance, dense), "a bigint, b bigint, near boolean")
    found = staged(found, "simhash-links")
    direct = found.where(F.col("near").isNull()).select("a", "b")
    # A point has at most as many fingerprints around it as there are points in a ball of that radius.
    around = found.where(F.col("near").isNotNull()).distinct()
    hubs = around.where("near").groupBy("a").agg(F.min("b").alias("hub")).withColumnRenamed("a", "point")
    through = around.join(hubs, F.col("a") == F.col("point")).select(F.col("b").alias("a"), F.col("hub").alias("b")).where(F.col("a") != F.col("b"))
    return direct.unionByName(through.distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, dense: int = DENSE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fp (signed long) and component_id.

    Fingerprints within ``distance`` bits are linked; ``component_id`` is the smallest doc_id that is
    reached over links, the row's own included.

    Nulls: a null text is an empty one; a null doc_id is in its group but never names it (a group of
    null ids only has a null component). Texts without words have fingerprint zero and link like any
    other. Very long texts are hashed whole. Equal fingerprints are one node, so copies and repeated
    rows cost no pairs; each row is returned. Other columns are not read. An empty table gives an
    empty result.
    """
    prints = staged(fingerprints(docs, shingle), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links_within(nodes.select("fp"), distance, dense)).select(F.col("node").alias("fp"), "root")
    linked = nodes.join(roots, "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component")).join(roots, "root").select("fp", "component")
    # Staged, so that the join with all rows may split a fingerprint that many share.
    named = staged(nodes.join(named, "fp", "left").select(F.col("fp").alias("node"), F.coalesce("component", "least").alias("component_id")), "simhash-named")
    return prints.join(named, F.col("fp") == F.col("node"), "left").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- given similarity

#: 64-bit words of a fingerprint; deviations of its error that the Hamming test allows for.
WIDE, ERRORS = 16, 4.0
#: Cells of a document at most and the least shingles of one that counts. Up to SHORT shingles there are prefixes instead.
CELLS, LEAST_CELL, SHORT = 32, 2, 64
#: A key with at most so many documents has all its pairs tested at once; those of a larger one are dealt into blocks of about BLOCK.
SMALL, BLOCK = 32, 1024
_TINY = 1e-9


def budget(similarity: float, bits: int = WIDE * 64) -> int:
    """Most differing bits of fingerprints whose sets have that cosine, :data:`ERRORS` deviations included."""
    share = float(np.arccos(similarity) / np.pi)
    return int(bits * (share + ERRORS * np.sqrt(share * (1 - share) / bits)))


def wide_hashes(values: np.ndarray) -> np.ndarray:
    """n x WIDE words of hash bits from n values (splitmix finaliser over successive offsets)."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64)[:, None] + np.arange(WIDE, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def set_of(raw: bytes | None, size: int) -> np.ndarray:
    """The document's set of shingles as rising 32-bit hashes."""
    return np.unique((hashes_of(shingles_of(raw, size)) >> np.uint64(32)).astype(np.uint32))


def fingerprint_of_set(values: np.ndarray) -> bytes:
    """1024 bits; a chunk of shingles is hashed at a time."""
    votes = np.zeros(WIDE * 64, np.int64)
    for at in range(0, len(values), 4096):
        bits = np.unpackbits(wide_hashes(values[at : at + 4096]).view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(values), bitorder="little").tobytes()


def keys_of(values: np.ndarray, similarity: float) -> list[int]:
    """The keys of a set, as signed longs: two sets of that cosine share one.

    Up to SHORT shingles, and up to as many more as a similar set can have, they are the first shingles by hash: two sets
    that share none of theirs are less similar, surely. From SHORT on they are signatures of up to CELLS cells, fixed
    stretches of the hash space that hold two to five shingles each. The number of cells goes with the logarithm of the
    number of shingles; a set that similar ones of another logarithm may exist for has the cells of both.
    """
    n, s2 = len(values), similarity * similarity
    out: list[int] = []
    if n and n <= SHORT / s2:
        first = n - int(np.ceil(s2 * n - _TINY)) + 1
        out += wide_hashes(values[:first].astype(np.uint64) + np.uint64(1 << 40))[:, 0].view(np.int64).tolist()
    if n > SHORT:
        mixed = wide_hashes(values)[:, 1]
        for q in sorted({int(np.log2(n * r)) for r in (similarity, 1.0, 1 / similarity)}):
            held = 2.0 if q < 8 else 2.5
            cells = min(CELLS, int((1 << q) / held))
            reach = min(1.0, cells * held / (1 << q))
            cell = np.floor(values.astype(np.float64) / (1 << 32) / reach * cells).astype(np.int64)
            inside = cell < cells
            total = np.zeros(cells, np.uint64)
            np.add.at(total, cell[inside], mixed[inside])
            kept = np.flatnonzero(np.bincount(cell[inside], minlength=cells) >= LEAST_CELL)
            out += wide_hashes(total[kept] ^ (kept.astype(np.uint64) + np.uint64(q << 8)))[:, 0].view(np.int64).tolist()
    return list(dict.fromkeys(out))


def pigeonring(differ: np.ndarray, distance: int) -> np.ndarray:
    """Rows of XOR segments (n x m) with a chain whose every prefix of length l is within l*distance/m."""
    counts = np.bitwise_count(differ).astype(np.int64)
    m = counts.shape[1]
    total, ok = np.zeros_like(counts), np.ones(counts.shape, bool)
    for length in range(1, m + 1):
        total += np.roll(counts, 1 - length, axis=1)
        ok &= total * m <= length * distance
    return ok.any(axis=1)


def _described(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, nodes, texts in columns_of(batches, "doc_id", "text_key", "node", "text"):
            sets = [set_of(t, shingle).tobytes() for t in texts]
            arrays = [pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "node", "shingles"])

    return run


def _sketched(similarity: float):
    """(node, shingles) to fingerprints and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, first, sets in columns_of(batches, "node", "first", "shingles"):
            values = [np.frombuffer(x, np.uint32) for x in sets]
            arrays = [pa.array(nodes, pa.binary()), pa.array(first, _FIRST), pa.array(sets, pa.binary()), pa.array([fingerprint_of_set(v) for v in values], pa.binary()), pa.array([keys_of(v, similarity) for v in values], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "first", "shingles", "fp", "cells"])

    return run


_FIRST = pa.struct([("last", pa.bool_()), ("doc_id", pa.int64()), ("text_key", pa.string())])
_FIRST_DDL = "struct<last:boolean,doc_id:bigint,text_key:string>"


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _close(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = batch.slice(at, 4096)
                differ = _words(x.column(2)) ^ _words(x.column(3))
                ok = pigeonring(differ, distance)
                ok[ok] = np.bitwise_count(differ[ok]).sum(axis=1, dtype=np.int64) <= distance
                yield x.select(["a", "b"]).filter(pa.array(ok))

    return run


def _exact(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_py(), np.uint32) for x in (a, b))
                both = np.sort(np.concatenate([a, b]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(shared >= similarity * np.sqrt(len(a) * len(b)) - _TINY)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _with(pairs: DataFrame, nodes: DataFrame, what: str) -> DataFrame:
    """(a, b, of_a, of_b): both nodes' value of the column ``what``."""
    of = nodes.select(F.col("node").alias("who"), F.col(what).alias("value"))
    one = pairs.join(of, F.col("a") == F.col("who")).select("a", "b", F.col("value").alias("of_a"))
    return one.join(of, F.col("b") == F.col("who")).select("a", "b", "of_a", F.col("value").alias("of_b"))


def _among(nodes: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of those ``nodes`` that a filter of the column node of ``wanted`` lets through, so that a join shuffles few others."""
    bits = filter_of(wanted.select(F.xxhash64("node").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(may_hold(bits, x.column(0).to_numpy()))).select(["node", *columns])

    ddl = ", ".join(f"{c} binary" for c in ("node", *columns))
    return nodes.select(F.xxhash64("node").alias("h"), "node", *columns).mapInArrow(run, ddl)


def verified(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have that cosine: pigeonring, the Hamming test, then the sets themselves."""
    near = staged(_with(pairs, nodes, "fp").mapInArrow(_close(budget(similarity)), "a binary, b binary"), "simhash-near")
    sides = near.select(F.explode(F.array("a", "b")).alias("node"))
    return staged(_with(near, _among(nodes, sides, "shingles"), "shingles").mapInArrow(_exact(similarity), "a binary, b binary"), "simhash-links")


def _by_key(n_keys: int, of_group):
    """Streams rows sorted by their first ``n_keys`` columns; ``of_group`` makes batches of the record batches of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for x in batches:
            keys = [x.column(i).to_numpy() for i in range(n_keys)]
            cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1 if x.num_rows else np.zeros(0, np.int64)
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), x.num_rows], strict=True):
                if at == end:
                    continue
                key = tuple(int(k[at]) for k in keys)
                if key != held:
                    if parts:
                        yield from of_group(parts)
                    held, parts = key, []
                parts.append(x.slice(at, end - at))
        if parts:
            yield from of_group(parts)

    return run


def _centre(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a block (cell, block, node, fp): the member next to the majority of bits, and its mean distance from the others."""
    whole = pa.Table.from_batches(parts).combine_chunks()
    prints = np.concatenate([_words(p.column(3)) for p in parts])
    at = int(np.bitwise_count(prints ^ fingerprint_of(prints)).sum(axis=1, dtype=np.int64).argmin())
    mean = float(np.bitwise_count(prints ^ prints[at]).sum(axis=1, dtype=np.int64).mean())
    yield pa.RecordBatch.from_arrays([pa.array([parts[0].column(0)[0].as_py()]), pa.array([whole.column(2)[at].as_py()], pa.binary()), pa.array([mean])], names=["cell", "hub", "mean"])


class _Sets:
    """Sets of shingles (rising 32-bit numbers as bytes) that another one is compared with, all at once."""

    def __init__(self, sets: list[bytes]):
        values = [np.frombuffer(x, np.uint32) for x in sets]
        self.values, self.sizes = values, np.array([len(v) for v in values])
        flat = np.concatenate(values)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(values)), self.sizes)[order]

    def shared(self, x: np.ndarray, among: np.ndarray) -> np.ndarray:
        """How many shingles ``x`` shares with each of the sets ``among``."""
        if len(among) <= 8:
            found = [np.sort(np.concatenate([x, self.values[i]])) for i in among]
            return np.array([np.count_nonzero(v[1:] == v[:-1]) for v in found], np.int64)
        low, high = np.searchsorted(self.flat, x, "left"), np.searchsorted(self.flat, x, "right")
        each = high - low
        at = np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))[among]


def _across(similarity: float):
    """Of a block (cell, block, part, side, node, root, fp, shingles): links of rows of side 1 and members (side 0) of other roots.

    Fingerprints prune, sets decide; roots that a link joins count as one from there on, so a block has fewer links than rows.
    """
    distance = budget(similarity)

    def run(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        side = table.column(3).to_numpy()
        inside, outside = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(inside) or not len(outside):
            return
        prints = np.concatenate([_words(p.column(6)) for p in parts])
        sets = table.column(7).to_pylist()
        members = _Sets([sets[i] for i in inside])
        _, group = np.unique(np.array(table.column(5).to_pylist(), object), return_inverse=True)
        a, b = [], []
        for x in outside.tolist():
            away = np.bitwise_count(prints[inside] ^ prints[x]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero((away <= distance) & (group[inside] != group[x]))
            if not len(near):
                continue
            own = np.frombuffer(sets[x], np.uint32)
            enough = members.shared(own, near) >= similarity * np.sqrt(len(own) * members.sizes[near]) - _TINY
            for i in inside[near[enough]].tolist():
                if group[i] != group[x]:
                    a.append(x)
                    b.append(i)
                    group[group == group[i]] = group[x]
        if a:
            nodes = table.column(4)
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)).combine_chunks(), nodes.take(pa.array(b)).combine_chunks()], names=["a", "b"])

    return run


def similar_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of all ``nodes`` (node, shingles, fp, cells) that are linked to another: root is the least of a component.

    A key with at most :data:`SMALL` nodes has all its pairs tested. Of a larger one, in which most are copies of one
    text, every member is tested against one hub, that next to the majority of bits; the members are dealt into blocks for
    it, so that no task holds more than a block. Those that are not in the component of most members then are compared
    with all members of other components, a block of theirs with a block of members at a time; that is done in place,
    and only links that join two components are listed. So the components are those of all pairs that share a key,
    at any size of a key, and rows grow in proportion; comparisons in place grow with the strays of a key times its members.
    """
    cells = nodes.select(F.explode("cells").alias("cell"), "node")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("cell", "at")
    shared = staged(cells.join(sizes, F.col("cell") == F.col("at")).select("cell", "node", "n"), "simhash-cells")
    # A list has at most SMALL nodes.
    lists = shared.where(F.col("n") <= SMALL).groupBy("cell").agg(F.array_sort(F.collect_set("node")).alias("l"))
    pair = lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = lists.where(F.size("l") > 1).select(F.explode(F.flatten(F.transform("l", pair))).alias("p")).select("p.a", "p.b")
    large = shared.where(F.col("n") > SMALL).join(nodes.select(F.col("node").alias("who"), "fp"), F.col("node") == F.col("who"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    large = staged(large.select("cell", block.alias("block"), "node", "fp", blocks.alias("blocks")), "simhash-large")
    centres = large.select("cell", "block", "node", "fp").repartition("cell", "block").sortWithinPartitions("cell", "block", "node").mapInArrow(_by_key(2, _centre), "cell bigint, hub binary, mean double")
    hubs = centres.groupBy("cell").agg(F.min(F.struct("mean", "hub")).alias("best")).select(F.col("cell").alias("at"), F.col("best.hub").alias("hub"))
    to_hub = large.select("cell", "node").join(hubs, F.col("cell") == F.col("at")).where(F.col("node") != F.col("hub")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    roots = staged(components(verified(pairs.unionByName(to_hub).distinct(), nodes, similarity)), "simhash-roots")
    members = large.join(roots.select(F.col("node").alias("who"), "root"), F.col("node") == F.col("who"), "left")
    members = staged(members.select("cell", "block", "blocks", "node", F.coalesce("root", "node").alias("root")), "simhash-members")
    counts = members.groupBy("cell", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("most")).select(F.col("cell").alias("at"), F.col("most.root").alias("main"))
    rest = staged(members.join(main, F.col("cell") == F.col("at")).where(F.col("root") != F.col("main")).select("cell", "blocks", "node", "root"), "simhash-rest")
    if rest.isEmpty():
        return roots
    strays = rest.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).withColumnRenamed("cell", "at")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    payload = _among(nodes, members.join(strays, F.col("cell") == F.col("at"), "left_semi"), "fp", "shingles").withColumnRenamed("node", "who")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    sides = members.join(strays, F.col("cell") == F.col("at")).select("cell", "block", "blocks", "parts", F.lit(0).alias("side"), "node", "root")
    sides = sides.unionByName(rest.join(strays, F.col("cell") == F.col("at")).select("cell", F.lit(0).alias("block"), "blocks", own.alias("parts"), F.lit(1).alias("side"), "node", "root"))
    met = sides.join(payload, F.col("node") == F.col("who"))
    inside = met.where("side = 0").select("cell", "block", every("parts").alias("part"), "side", "node", "root", "fp", "shingles")
    outside = met.where("side = 1").select("cell", every("blocks").alias("block"), F.col("parts").alias("part"), "side", "node", "root", "fp", "shingles")
    keys = ("cell", "block", "part")
    met = inside.unionByName(outside).repartition(*keys).sortWithinPartitions(*keys, "side", "node")
    more = staged(met.mapInArrow(_by_key(3, _across(similarity)), "a binary, b binary"), "simhash-more")
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").unionByName(more))


def text_key(text: str = "text") -> Column:
    """Tells texts apart; null counts as the empty text."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _keyed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of a text: the hash of its words."""
    for ids, keys, texts in columns_of(batches, "doc_id", "text_key", "text"):
        nodes = [xxhash.xxh3_128_digest(b" ".join((raw or b"").lower().split())) for raw in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(nodes, pa.binary())], names=["doc_id", "text_key", "node"])


def _nodes_and_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        texts = x.column(2).to_pylist()
        nodes = [xxhash.xxh3_128_digest(b" ".join((raw or b"").lower().split())) for raw in texts]
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(nodes, pa.binary()), x.column(2)], names=["doc_id", "text_key", "node", "text"])


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text_key (hash of the text) and keeper.

    Documents of the same words are one node; nodes whose sets of shingles have a cosine of ``similarity`` or more are
    linked; ``keeper`` is true in one row of every group: that of the smallest doc_id (null last, then by text_key); of
    equal (doc_id, text) rows, in all.

    Null, empty and very long texts, repeated rows, other columns and empty tables: as
    :func:`near_duplicates`; all texts without words are copies of one another.
    """
    texts = docs.select("doc_id", text_key().alias("text_key"), text_bytes())
    rows = staged(texts.mapInArrow(_keyed_rows, "doc_id bigint, text_key string, node binary"), "simhash-rows")
    described = texts.mapInArrow(_chained(_nodes_and_texts, _described(shingle)), "doc_id bigint, text_key string, node binary, shingles binary")
    # Rows of one node are equal in their shingles.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    once = described.groupBy("node").agg(least, F.first("shingles").alias("shingles"))
    nodes = staged(once.mapInArrow(_sketched(similarity), f"node binary, first {_FIRST_DDL}, shingles binary, fp binary, cells array<bigint>"), "simhash-nodes")
    roots = similar_links(nodes, similarity).withColumnRenamed("node", "who")
    grouped = nodes.select("node", "first").join(roots, F.col("node") == F.col("who"), "left").select(F.coalesce("root", "node").alias("root"), "first")
    keepers = grouped.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    joined = rows.select("doc_id", "text_key").join(keepers, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left")
    return joined.select("doc_id", "text_key", F.col("kept_key").isNotNull().alias("keeper"))


def _chained(one, two):
    return lambda batches: two(one(batches))


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document kept of every group of :func:`similar_documents`; all its columns.

    Of repeated rows (equal doc_id and text) one is kept. Extra columns may have any names. The texts are shuffled once.
    """
    own = lambda doc_id, key: F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), key)
    keepers = similar_documents(docs, shingle, similarity).where("keeper").select(own("doc_id", F.col("text_key")).alias("kept")).distinct()
    rows = docs.select(whole_row(docs), own("doc_id", text_key()).alias("own"))
    kept = rows.join(keepers, F.col("own") == F.col("kept"), "left_semi")
    return kept.groupBy("own").agg(F.first("row").alias("row")).select("row.*")
