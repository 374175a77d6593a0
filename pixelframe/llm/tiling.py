"""Benchmark decontamination by greedy string tiling.

Documents and test items are sequences of words. Windows of a few words are hashed by running
Karp-Rabin; a document joins the items whose windows it shares (the seeds). For each such pair
the longest common runs that do not overlap what is marked are marked as tiles, again and again, until
none of the least length is left. Tiles may lie in any order and anywhere in the document, so a passage
whose sentences were reordered is covered like one in place. A document is contaminated by an item
of which tiles cover a given share.

The test items are a stated query set. Up to :data:`ITEM_BYTES` of them go to every document, which is read once and
never shuffled. More of them are joined: the documents' windows that a bounded filter of all seeds lets through meet the
seeds by hash, pairs whose shared seeds could cover enough get their texts, and these are tiled. Nothing of that is
collected but the filter, whose size does not depend on the items; a filter that is full lets more through and loses
nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, columns_of, filter_of, may_hold, staged, text_bytes, whole_row

#: Words of a seed, share of an item that tiles must cover, bytes of test items that go to all tasks at once.
SEED_WORDS, COVERED, ITEM_BYTES = 5, 0.6, 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Letters and digits of any script; all else parts words.
_WORDS = re.compile(r"[^\W_]+")


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of UTF-8 text with case folded by Unicode (so that ``STRASSE`` is ``straße``), composed accents, in order."""
    if not raw:
        return []
    text = raw.decode("utf-8", "replace").casefold()
    return " ".join(_WORDS.findall(unicodedata.normalize("NFC", text))).encode().split()


def running(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of ``size``; each is the last one moved on by one word."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        total = mixed[: len(ids) - size + 1].copy()
        for k in range(1, size):
            total = total * _BASE + mixed[k : len(ids) - size + 1 + k]
    return total


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length): the longest common run of unmarked words is marked, and so on.

    Of runs of one length the first in the text is marked first, with the first place in the item.
    A negative word equals nothing.
    """
    free_item, free_text = item >= 0, text >= 0
    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(text))

    def common(size: int) -> list[tuple[int, int]]:
        """Equal unmarked windows as (place in text, place in item)."""
        if size > min(len(item), len(text)):
            return []
        windows = lambda free: np.convolve(free, np.ones(size, np.int64), "valid") == size
        a, b = np.flatnonzero(windows(free_item)), np.flatnonzero(windows(free_text))
        by = defaultdict(list)
        for at, h in zip(a.tolist(), running(item, size)[a].tolist(), strict=True):
            by[h].append(at)
        hits = ((at, i) for at, h in zip(b.tolist(), running(text, size)[b].tolist(), strict=True) for i in by.get(h, ()))
        return [(at, i) for at, i in hits if np.array_equal(text[at : at + size], item[i : i + size])]

    while most >= least:
        low, high, found = least - 1, most, []
        while low < high:  # a common run of some length has one of every lesser length in it
            size = (low + high + 1) // 2
            hits = common(size)
            low, high, found = (size, high, hits) if hits else (low, size - 1, found)
        if low < least:
            break
        for at, i in found:
            if free_text[at : at + low].all() and free_item[i : i + low].all():
                free_text[at : at + low] = free_item[i : i + low] = False
                tiles.append((i, at, low))
        most = low
    return tiles


class Items:
    """A block of test items: their words as numbers and the seeds by hash."""

    def __init__(self, rows: list[tuple], seed_words: int, covered: float):
        self.ids, self.covered, self.least = [r[0] for r in rows], covered, []
        self.vocabulary: dict[bytes, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(r[1])], np.int64) for r in rows]
        found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for k, item in enumerate(self.items):
            size = min(seed_words, len(item))
            self.least.append(size)
            if size:
                for h in running(item, size).tolist():
                    found[size][h].add(k)
        #: An item of fewer words than a seed is one window of its own length.
        self.seeds = {size: (np.array(sorted(by), np.uint64), {h: sorted(k) for h, k in by.items()}) for size, by in found.items()}

    def matches(self, raw: bytes | None) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        """(number of the item, share covered, tiles) of the items that the text contaminates."""
        known = self.vocabulary
        words = np.array([known.get(w, -1) for w in words_of(raw)], np.int64)
        near: dict[int, list[int]] = defaultdict(list)
        for size, (hashes, by) in self.seeds.items():
            strange = np.concatenate([[0], np.cumsum(words < 0)])
            at = np.flatnonzero(strange[size:] == strange[:-size]) if len(words) >= size else np.zeros(0, np.int64)
            if not len(at):
                continue
            h = running(words, size)[at]
            hit = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
            for place, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
                for k in by[x]:
                    near[k].append(place)
        for k, places in sorted(near.items()):
            item, size = self.items[k], self.least[k]
            # Tiles lie in windows that are seeds, so only these words of the text are looked at.
            inside = np.zeros(len(words), bool)
            for step in range(size):
                inside[np.array(places) + step] = True
            if np.count_nonzero(inside) < self.covered * len(item):
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
            text, origin = [], []
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                text += [words[a:b], [-1]]
                origin += [np.arange(a, b), [-1]]
            tiles = greedy_tiles(item, np.concatenate(text), size)
            share = sum(n for _, _, n in tiles) / len(item)
            if share >= self.covered:
                back = np.concatenate(origin)
                yield k, share, [(i, int(back[at]), n) for i, at, n in tiles]


def few_items(items: DataFrame, most_bytes: int = ITEM_BYTES) -> list[tuple] | None:
    """The test items (item_id, text) if they have at most ``most_bytes``; None if they have more."""
    size = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    return [(r[0], bytes(r[1] or b"")) for r in items.select("item_id", text_bytes()).collect()] if size <= most_bytes else None


# ---------------------------------------------------------------- many items


def _row_key(name: str) -> Column:
    """Tells rows with another id or text apart."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(name).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))


def _windows(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words; windows of different sizes never meet."""
    ids = np.fromiter((xxhash.xxh64_intdigest(w, size) for w in words), np.uint64, len(words))
    return running(ids, size)


def _seeds(seed_words: int, covered: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in columns_of(batches, "item_key", "text"):
            rows = []
            for key, raw in zip(keys, texts, strict=True):
                words = words_of(raw)
                size = min(seed_words, len(words))
                if size:
                    found, often = np.unique(_windows(words, size).view(np.int64), return_counts=True)
                    rows += [(h, size, key, n * size, covered * len(words)) for h, n in zip(found.tolist(), often.tolist(), strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.float64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "size", "item_key", "covers", "need"])

    return run


def _hits(bits: np.ndarray, sizes: list[int]):
    """Windows of the documents that the filter lets through, each once for a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in columns_of(batches, "doc_key", "text"):
            for key, raw in zip(keys, texts, strict=True):
                words, found = words_of(raw), []
                for size in sizes:
                    h = np.unique(_windows(words, size))
                    found.append(h[may_hold(bits, h)])
                h = np.concatenate(found) if found else np.zeros(0, np.uint64)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(h)), pa.array(h.view(np.int64))], names=["doc_key", "hit"])

    return run


def _tiled(seed_words: int, covered: float):
    """Leaks of pairs (doc_id, item_id, text, item_text, doc_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, items, texts, tests, keys in columns_of(batches, "doc_id", "item_id", "text", "item_text", "doc_key", rows=256):
            rows = []
            for doc_id, item_id, raw, test, key in zip(ids, items, texts, tests, keys, strict=True):
                found = next(Items([(item_id, test or b"")], seed_words, covered).matches(raw), None)
                if found:
                    rows.append((*_leak(doc_id, item_id, found[1], found[2]), key))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _KEYED, strict=True)], schema=_KEYED)

    return run


def _joined(docs: DataFrame, items: DataFrame, seed_words: int, covered: float) -> DataFrame:
    """The leaks of :func:`find_leaks` with doc_key; of equal items and of equal documents each has a row."""
    tests = staged(items.select("item_id", text_bytes(), _row_key("item_id").alias("item_key")), "tiling-items")
    seeds = staged(tests.dropDuplicates(["item_key"]).select("item_key", "text").mapInArrow(_seeds(seed_words, covered), "seed bigint, size int, item_key string, covers bigint, need double"), "tiling-seeds")
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())
    rows = docs.select("doc_id", text_bytes(), _row_key("doc_id").alias("doc_key"))
    hits = rows.select("doc_key", "text").mapInArrow(_hits(filter_of(seeds.select("seed"), FILTER_BITS), sizes), "doc_key string, hit bigint").distinct()
    met = hits.join(seeds, F.col("hit") == F.col("seed")).groupBy("doc_key", "item_key").agg(F.sum("covers").alias("covers"), F.first("need").alias("need"))
    pairs = staged(met.where("covers >= need").select(F.col("doc_key").alias("in_doc"), F.col("item_key").alias("in_item")), "tiling-pairs")
    with_text = rows.join(pairs, F.col("doc_key") == F.col("in_doc")).join(tests.select("item_id", F.col("text").alias("item_text"), "item_key"), F.col("in_item") == F.col("item_key"))
    return with_text.select("doc_id", "item_id", "text", "item_text", "doc_key").mapInArrow(_tiled(seed_words, covered), f"{_FOUND_DDL}, doc_key string")


def find_leaks(docs: DataFrame, items: DataFrame, seed_words: int = SEED_WORDS, covered: float = COVERED, most_bytes: int = ITEM_BYTES) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text) and each of ``items`` (item_id, text) that it contaminates.

    Returns doc_id, item_id, coverage, n_tiles, longest (words) and ``tiles``, an array of (item_at, text_at,
    n_words). Clean documents have no row.

    Nulls: a null text is empty, matches nothing and is matched by nothing; null ids are carried. An item of
    fewer words than a seed must be there whole. Very long texts are read whole. Ties: see
    :func:`greedy_tiles`. Repeated rows on either side give a row each. Other columns are not read.
    Empty tables give an empty result.
    """
    rows = few_items(items, most_bytes)
    if rows is None:
        return _joined(docs, items, seed_words, covered).drop("doc_key")
    return docs.select("doc_id", text_bytes()).mapInArrow(_found(Items(rows, seed_words, covered)), _FOUND_DDL)


_FOUND_DDL = "doc_id bigint, item_id bigint, coverage double, n_tiles int, longest int, tiles array<struct<item_at:int,text_at:int,n_words:int>>"
_TILE = pa.struct([("item_at", pa.int32()), ("text_at", pa.int32()), ("n_words", pa.int32())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32()), ("tiles", pa.list_(_TILE))])


_KEYED = _FOUND.append(pa.field("doc_key", pa.string()))


def _leak(doc_id: int | None, item_id: int | None, share: float, tiles: list[tuple[int, int, int]]) -> tuple:
    spans = [dict(zip(("item_at", "text_at", "n_words"), t, strict=True)) for t in sorted(tiles)]
    return doc_id, item_id, share, len(tiles), max(n for _, _, n in tiles), spans


def _found(block: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns_of(batches, "doc_id", "text"):
            rows = [_leak(doc_id, block.ids[k], share, tiles) for doc_id, raw in zip(ids, texts, strict=True) for k, share, tiles in block.matches(raw)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return run


def decontaminated(docs: DataFrame, items: DataFrame, seed_words: int = SEED_WORDS, covered: float = COVERED, most_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all columns; decided row by row, without a shuffle, while the items are few.

    Null, empty and very long texts, null ids and short items: as :func:`find_leaks`. Repeated rows are decided alike and kept
    each. Extra columns may have any names. Empty tables: all documents stay, or there are none.
    """
    rows = few_items(items, most_bytes)
    if rows is None:
        leaks = _joined(docs, items, seed_words, covered).select(F.col("doc_key").alias("leak")).distinct()
        return docs.select(whole_row(docs), _row_key("doc_id").alias("key")).join(leaks, F.col("key") == F.col("leak"), "left_anti").select("row.*")
    row = docs.select(whole_row(docs))
    return row.mapInArrow(_clean(Items(rows, seed_words, covered)), row.schema).select("row.*")


def _clean(block: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field("text").cast(pa.binary())
            keep = [next(block.matches(raw.as_py()), None) is None for raw in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
