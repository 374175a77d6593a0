from collections import Counter

import pytest
from support import SF
from llm_data import ODD

from pixelframe.llm import tokencount as t
from pixelframe.llm.queries import op5_token_counts, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(library, rows, limit=512):
    out = Counter()
    for i, x, *_ in rows:
        n = len(library.encode(x or "", add_special_tokens=False).ids)
        out[i, len((x or "").encode()), n, n > limit] += 1
    return out


MORE = [
    (30, "a  b\n\n c <|endoftext|>x don't  ", "a"), (31, "日本語 ² ½ \x1c\x1d x　y ᠎​ z 12³4", "a"), (32, "It's 'twas'll  \t\n", "a"), (33, "<|endoftext|><|endoftext|>", "a"),
    (34, "   a b   ", "a"), (35, "é e\u0301 😀😀 \u2028x\u2029 \u3000\u3000 y", "a"), (36, "'s's 'S 're-re'llama\r\n\r\n  \r\n", "a"), (37, "1,234.56%-- __x__ ^_^ \x00\x01", "a"),
]


def test_odd_rows(spark, docs_of, library):
    rows = ODD + MORE
    assert Counter(map(tuple, t.count_tokens(docs_of(rows), PATH).collect())) == want(library, rows)
    assert t.count_tokens(docs_of([]), PATH).count() == 0


def test_blocks_do_not_matter(spark, docs_of, library, monkeypatch):
    """Many small blocks, packed in small pieces, give the same counts."""
    rows = [(i, f"number {i} of the documents, number {i % 7}!", "a") for i in range(300)] + MORE
    docs = docs_of(rows)
    blocks, pieces = t._blocks, t._pieces
    scope = {"BLOCK_ROWS": 7, "_HELD": 11}
    for name, value in scope.items():
        monkeypatch.setattr(t, name, value)
    assert blocks is t._blocks and pieces is t._pieces
    assert Counter(map(tuple, t.count_tokens(docs, PATH, limit=9).collect())) == want(library, rows, 9)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        t._special_strings(vocabulary("word_bpe_49k.json"))


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(SF / "documents.parquet")).collect()]
    assert Counter(map(tuple, op5_token_counts(spark, str(SF)).collect())) == want(library, rows)
