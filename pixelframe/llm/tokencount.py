"""Token counts by distinct pre-token.

No token id is ever made for a document. Documents are read in blocks; a block knows each of its
distinct pre-tokens once, and of every document only how often it has which (the per-document
frequencies, packed). The pre-tokens of all blocks meet by a shuffle on the pre-token, where the
pieces of each distinct one are counted once; the counts are joined back to the frequencies by block
and summed to one number for each document.

What is shuffled is a dictionary for each block and the packed frequencies, not the text and no row
for each token; a very common pre-token has one row for each block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A block ends with the document that takes it over one of these.
BLOCK_BYTES, BLOCK_ROWS, BLOCK_WORDS = 24 << 20, 50_000, 600_000
#: White space of Unicode. A run of other characters, with one space before it, is
#: cut into pre-tokens without regard to what stands around it; so is a run of white space.
_WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_RUNS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special_strings(path: str) -> list[str]:
    """Strings that the library takes out of a text as one token, longest first."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    odd = [t for t in model.get("added_tokens", ()) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    plain = model["model"].get("type") == "BPE" and (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not model.get("normalizer")
    if odd or not plain or model["pre_tokenizer"].get("add_prefix_space") or not model["pre_tokenizer"].get("use_regex", True):
        raise ValueError("counting by pre-token needs a byte-level BPE file without prefix space, normaliser or stripping tokens")
    return sorted((t["content"] for t in model.get("added_tokens", ())), key=len, reverse=True)


def _blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _tokenizer(path).pre_tokenizer.pre_tokenize_str
        special = _special_strings(path)
        apart = re.compile("|".join(map(re.escape, special))) if special else None
        task = TaskContext.get().partitionId() << 32
        made = 0
        runs: dict[str, int | tuple[int, ...]] = {}
        words: dict[str, int] = {}
        ids: list = []
        sizes: list[int] = []
        whole: list[int] = []
        starts, where, often = [0], [], []

        def close() -> pa.RecordBatch:
            nonlocal made, runs, words, ids, sizes, whole, starts, where, often
            at, n = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (where, often))
            packed = zlib.compress(at.astype(np.int32).tobytes(), 1), zlib.compress(n.astype(np.int32).tobytes(), 1)
            row = [task + made], [ids], [sizes], [whole], [starts], [packed[0]], [packed[1]], [zlib.compress("\n".join(words).encode(), 1)]
            made += 1
            runs, words, ids, sizes, whole, starts, where, often = {}, {}, [], [], [], [0], [], []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        room = 0
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py() or b""
                text = raw.decode("utf-8", "replace")
                alone = 0
                if apart and any(s in text for s in special):
                    parts = apart.split(text)
                    alone = len(parts) - 1
                    found = Counter(r for p in parts for r in _RUNS.findall(p))
                else:
                    found = Counter(_RUNS.findall(text))
                mine: dict[int, int] = {}
                for r, n in found.items():
                    known = runs.get(r)
                    if known is None:
                        known = tuple(words.setdefault(w, len(words)) for w, _ in cut(r))
                        known = runs[r] = known[0] if len(known) == 1 else known
                    if type(known) is int:
                        mine[known] = mine.get(known, 0) + n
                        continue
                    for w in known:
                        mine[w] = mine.get(w, 0) + n
                at = np.fromiter(mine.keys(), np.int32, len(mine))
                n = np.fromiter(mine.values(), np.int32, len(mine))
                order = np.argsort(at)
                at = at[order]
                at[1:] -= at[:-1].copy()
                where.append(at)
                often.append(n[order])
                starts.append(starts[-1] + len(at))
                ids.append(batch.column(0)[i].as_py())
                sizes.append(len(raw))
                whole.append(alone)
                room += len(raw)
                if room >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS or len(words) >= BLOCK_WORDS:
                    yield close()
                    room = 0
        if ids:
            yield close()

    return run


_LONGS = pa.list_(pa.int64())
_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", _LONGS), ("n_bytes", _LONGS), ("whole", _LONGS), ("starts", _LONGS), ("at", pa.binary()), ("often", pa.binary()), ("words", pa.binary())])
_BLOCK_DDL = "block bigint, doc_ids array<bigint>, n_bytes array<bigint>, whole array<bigint>, starts array<bigint>, at binary, often binary, words binary"


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pre-token of each block: the text in the library's byte characters, which hold no line feed, and its number."""
    for batch in batches:
        for i in range(batch.num_rows):
            packed = zlib.decompress(batch.column(1)[i].as_py())
            words = packed.decode().split("\n") if packed else []
            for at in range(0, len(words), 10_000):
                texts = pa.array(words[at : at + 10_000])
                number = pa.array(np.arange(at, at + len(texts), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([texts, pa.array([batch.column(0)[i].as_py()] * len(texts), pa.int64()), number], names=["text", "block", "word"])


#: Counts that a task holds before it packs them.
_HELD = 400_000


def _pieces(path: str):
    """Over rows sorted by pre-token: the pieces of each distinct one, counted once; packed by block as (gaps of the numbers, pieces)."""

    def packed(blocks: np.ndarray, words: np.ndarray, pieces: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((words, blocks))
        blocks, words, pieces = blocks[order], words[order], pieces[order]
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        names, found = [], []
        for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
            gaps = np.diff(words[a:b], prepend=0).astype(np.int32)
            names.append(int(blocks[a]))
            found.append(zlib.compress(gaps.tobytes() + pieces[a:b].astype(np.int32).tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.binary())], names=["block", "counted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _tokenizer(path).model.tokenize
        last, pieces, held, n = None, 0, [], 0
        for batch in batches:
            counts = np.empty(batch.num_rows, np.int32)
            for i, word in enumerate(batch.column(0).to_pylist()):
                if word != last:
                    last, pieces = word, len(cut(word))
                counts[i] = pieces
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), counts))
            n += batch.num_rows
            if n >= _HELD:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _sums(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, whole, starts, at, often, counted = (batch.column(k)[i] for k in range(7))
                starts = starts.values.to_numpy()
                gaps, n = (np.frombuffer(zlib.decompress(x.as_py()), np.int32).astype(np.int64) for x in (at, often))
                running = np.concatenate([[0], np.cumsum(gaps)])
                # Gaps begin anew with each document.
                begun = np.repeat(running[starts[:-1]], np.diff(starts))
                words = running[1:] - begun
                table = np.zeros(int(words.max()) + 1 if len(words) else 0, np.int64)
                for part in counted.as_py() or ():
                    moved, pieces = np.frombuffer(zlib.decompress(part), np.int32).reshape(2, -1)
                    table[np.cumsum(moved)] = pieces
                total = np.concatenate([[0], np.cumsum(table[words] * n)])
                tokens = total[starts[1:]] - total[starts[:-1]] + whole.values.to_numpy()
                yield pa.RecordBatch.from_arrays([ids.values, sizes.values, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (more than ``limit``).

    ``path`` is a tokenizers file of a byte-level BPE vocabulary that every executor can open. Counts are
    the library's for the whole text, without begin, end or other added tokens; its special strings inside
    a text are one token each, as is its default.

    Nulls: a null text is empty and has no tokens; a null doc_id is carried. Very long texts are counted
    whole, a block then holds one document. Repeated rows are counted each. Other columns are not read.
    An empty table gives an empty result.
    """
    blocks = staged(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_blocks(path), _BLOCK_DDL), "token-blocks")
    words = blocks.select("block", "words").mapInArrow(_dictionary, "text string, block bigint, word int")
    counted = words.repartition("text").sortWithinPartitions("text").mapInArrow(_pieces(path), "block bigint, counted binary")
    # A block's dictionary is bounded by BLOCK_WORDS and one document, and so is what is collected of it.
    by_block = counted.groupBy("block").agg(F.collect_list("counted").alias("counted")).withColumnRenamed("block", "of")
    joined = blocks.drop("words").join(by_block, F.col("block") == F.col("of"), "left")
    return joined.select("doc_ids", "n_bytes", "whole", "starts", "at", "often", "counted").mapInArrow(_sums(limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
