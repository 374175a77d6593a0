from collections import Counter

import pytest
from support import SF
from llm_data import ODD

from pixelframe.llm import fertility as f
from pixelframe.llm.queries import op1_quality_rules, vocabulary

NAMES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
PATHS = {n: vocabulary(n) for n in NAMES}
SEP = " \t\n\x0b\x0c\r"


def brute(text):
    """The base measures word by word."""
    text = text or ""
    words, now = [], ""
    for c in text + " ":
        if c in SEP:
            words += [now] if now else []
            now = ""
        else:
            now += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 3000 else set(range(len(words)))
    lines = [x for x in text.split("\n") if any(c not in SEP for c in x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_odd_rows(spark, docs_of):
    rows = [*ODD, (20, "a b c x a b c\na b c x a b c\n#$|\n#$|", "a"), (21, "a a a a", "a")]
    got = f.quality_rules(docs_of(rows), PATHS).collect()
    assert len(got) == len(rows)
    want = Counter((i, *brute(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.reason is None) and not (r.base_failed and r.kept)
    assert f.quality_rules(docs_of([]), PATHS).count() == 0
    ids = spark.createDataFrame([(6,), (None,), (6,), (10,)], "doc_id bigint")
    again = f.quality_rules(docs_of(rows), PATHS, ids).collect()
    assert Counter((r.doc_id, r.n_words, r.kept) for r in again) == Counter((r.doc_id, r.n_words, r.kept) for r in got)
    assert f.quality_rules(docs_of([]), PATHS, ids).count() == 0


def test_bands_reject_blobs_and_keep_prose(spark, docs_of):
    import random

    r = random.Random(3)
    prose = "The committee met on Tuesday to review what had been learned from the previous season and agreed that most of the work should be repeated, with better records, by the people who had proposed it in the first place, since nobody else understood why the figures differed from those that the older report had given for the same area."
    blob = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40)) for _ in range(60))
    mojibake = " ".join("".join(chr(r.randrange(0x2500, 0x25FF)) for _ in range(8)) for _ in range(60)) + " abc"
    few = " ".join(["spam"] * 3 + [f"{w} spam" for w in "abcdefgh" * 8])
    got = {x.doc_id: x for x in f.quality_rules(docs_of([(1, prose, "a"), (2, blob, "a"), (3, mojibake, "a"), (4, few, "a")]), PATHS).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and not got[4].kept
    assert got[2].chars_per_token < 1.7 and got[3].byte_share > 0.5


def test_scripts():
    assert [f.script_of(t) for t in ("abc", "привет", "日本語", "ελληνικά", "한국어", "12 !?", "ひらがな", "né", "مرحبا")] == ["Latin", "Cyrillic", "Han", "Greek", "Hangul", "None", "Kana", "Latin", "Arabic"]


def test_texts_without_letters_have_a_strict_band(spark, docs_of):
    import random

    r = random.Random(5)
    emoji = " ".join("".join(chr(r.randrange(0x1F300, 0x1F5FF)) for _ in range(4)) for _ in range(80))
    numbers = " ".join(str(r.randrange(10**6)) for _ in range(80))
    assert not any(x.kept for x in f.quality_rules(docs_of([(1, emoji, "a"), (2, numbers, "a")]), PATHS).collect())


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query_against_a_brute_force_version(spark):
    """All measures by encoding every word by itself, bands from sorted lists, on the whole table."""
    import base64
    import math
    from collections import defaultdict

    import sentencepiece
    import tiktoken
    from public_tokenizers import PATTERN

    piece = sentencepiece.SentencePieceProcessor(model_file=PATHS[NAMES[0]])
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATHS[NAMES[1]], "rb"))}
    multi = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(i):
        try:
            multi.decode_single_token_bytes(i).decode()
        except UnicodeDecodeError:
            return False
        return True

    meters = ((lambda w: piece.encode(w), piece.is_byte), (lambda w: multi.encode_ordinary(" " + w), lambda i: not whole(i)))
    rows = spark.read.parquet(str(SF / "documents.parquet")).collect()
    trusted = {r.doc_id for r in spark.read.parquet(str(SF / "labels.parquet")).where("quality = 1").collect()}
    known = [{}, {}]
    out = []
    for r in rows:
        n_words, chars, *_, again = brute(r.text)
        found = []
        for (encode, is_byte), memory in zip(meters, known):
            ids = [i for w in (r.text or "").split() for i in memory.setdefault(w, encode(w))]
            counts = Counter(ids)
            total = max(1, len(ids))
            found.append((chars / total, sum(n for i, n in counts.items() if is_byte(i)) / total, -sum(n / total * math.log2(n / total) for n in counts.values())))
        out.append((r.doc_id, r.lang, f.script_of(r.text or ""), n_words < 50 or 100 * again > 50 * n_words, found))
    bands = defaultdict(dict)
    for at, kind in ((1, "lang"), (2, "script")):
        for key in {x[at] for x in out}:
            good = [x[4] for x in out if x[at] == key and x[0] in trusted and not x[3]]
            if key is None or len(good) < f.LEAST_TRUSTED:
                continue
            for v in range(2):
                sides = []
                for m in range(3):
                    s = sorted(g[v][m] for g in good)
                    low, mid, high = (s[math.ceil(p * len(s)) - 1] for p in (0.25, 0.5, 0.75))
                    d = f.WIDTH * max(high - low, f.LEAST_SPREAD * mid)
                    sides.append((low - d, high + d))
                bands[kind, key][v] = f.Band(*sides[0], max(sides[1][1], f.FREE_SHARE), sides[2][0])
    want = {}
    for doc_id, lang, script, failed, found in out:
        by = bands.get(("lang", lang)) or bands.get(("script", script)) or {v: f.BANDS[n].get(script, f.BANDS[n]["Other"]) for v, n in enumerate(NAMES)}
        want[doc_id] = (not failed and all(by[v].holds(*found[v]) for v in range(2)), failed, *found[0])
    got = {r.doc_id: (r.kept, r.base_failed, r.chars_per_token, r.byte_share, r.token_entropy) for r in op1_quality_rules(spark, str(SF)).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:2] == w[:2] and got[k][2:] == pytest.approx(w[2:], abs=1e-9), k


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query_keeps_labelled_good_documents_and_rejects_others(spark):
    d = SF.parent / "sf0.01"
    labels = spark.read.parquet(str(d / "labels.parquet")).select("doc_id", "quality")
    got = op1_quality_rules(spark, str(d)).join(labels, "doc_id").where("not base_failed").cache()
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("not kept").count() <= 0.01 * good.count() and good.count() > 100
    assert bad.where("not kept").count() >= 0.3 * bad.count()


def test_bands_from(spark, docs_of):
    texts = [(i, " ".join(f"word{i * k % 97} and" for k in range(60)), "a") for i in range(30)]
    row = f.bands_from(f.measures(docs_of(texts), PATHS, most_repeated_percent=100), "script").first()
    assert row.key == "Latin" and len(row.bands) == 2 and row.n_docs == 30
    assert all(b.least_chars <= b.most_chars for b in row.bands)
    assert f.bands_from(f.measures(docs_of([(1, None, None)]), PATHS), "lang").count() == 0
