"""Quality rules by tokeniser fertility.

Public vocabularies are used as measuring instruments: text in a language and script that a
vocabulary knows costs few pieces, spreads over many of them and needs few byte pieces;
encoded blobs, mojibake and endless repetition do not. Three measures are taken of each
document under each vocabulary:

* characters (of words) per token,
* byte-fallback share: of the tokens, those that stand for single bytes and not for characters,
* token entropy in bits: of the document's own token distribution.

Each must lie in a band. Where there is trusted text, the bands are those of the document's language, or else of its
dominant script, taken over all trusted documents (:func:`bands_from`); for what has too few of them, and without
trusted text, they are fixed ones by script. The texts are read once, in one pass without a shuffle; bands and verdicts
are aggregations and joins of the measures.

A document's words are encoded once per distinct word and task (pieces never cross the space
before a word), so the cost is that of the distinct words.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns_of, staged

#: First code point after each range, and the script of the range.
SCRIPT_RANGES = (
    (0x0041, ""), (0x005B, "Latin"), (0x0061, ""), (0x007B, "Latin"), (0x00AA, ""), (0x0250, "Latin"),
    (0x0370, ""), (0x0400, "Greek"), (0x0530, "Cyrillic"), (0x0590, "Other"), (0x0600, "Hebrew"),
    (0x0780, "Arabic"), (0x0900, "Other"), (0x0E00, "Indic"), (0x0E80, "Thai"), (0x1100, "Other"),
    (0x1200, "Hangul"), (0x1E00, "Other"), (0x1F00, "Latin"), (0x2000, "Greek"), (0x3040, ""),
    (0x3100, "Kana"), (0x3400, "Other"), (0xA000, "Han"), (0xAC00, "Other"), (0xD7B0, "Hangul"),
    (0xF900, "Other"), (0xFB00, "Han"), (0x1F000, "Other"), (0x20000, ""), (0x30000, "Han"), (0x110000, "Other"),
)
_ENDS = np.array([end for end, _ in SCRIPT_RANGES], dtype=np.uint32)
_NAMES = sorted({name for _, name in SCRIPT_RANGES})
_CODES = np.array([_NAMES.index(name) for _, name in SCRIPT_RANGES])


#: Documents whose new words are encoded together.
SLICE, SLICE_BYTES = 512, 2 << 20


@dataclass(frozen=True)
class Band:
    """What one vocabulary may measure: characters per token, byte share, entropy in bits."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float

    def holds(self, chars: float, share: float, entropy: float) -> bool:
        return self.least_chars <= chars <= self.most_chars and share <= self.most_bytes and entropy >= self.least_entropy


#: Fixed bands by vocabulary and script; ``None`` is that of texts without letters, ``Other`` of scripts without a band.
BANDS: dict[str, dict[str, Band]] = {
    "piece_bpe_32k.model": {
        "Latin": Band(1.5, 9.0, 0.20, 4.5),
        "Cyrillic": Band(1.2, 8.0, 0.25, 4.5),
        "Greek": Band(0.5, 6.0, 0.80, 3.5),
        "Han": Band(0.3, 4.0, 0.90, 3.5),
        "Kana": Band(0.4, 5.0, 0.80, 3.5),
        "Hangul": Band(0.3, 4.0, 0.95, 3.5),
        "Arabic": Band(0.4, 6.0, 0.90, 3.5),
        "Hebrew": Band(0.4, 6.0, 0.90, 3.5),
        "Indic": Band(0.3, 5.0, 0.95, 3.5),
        "Thai": Band(0.3, 5.0, 0.95, 3.5),
        "Other": Band(0.2, 9.0, 1.00, 3.5),
        "None": Band(1.2, 9.0, 0.50, 4.0),
    },
    "byte_bpe_multi_50k.tiktoken": {
        "Latin": Band(1.4, 10.0, 0.20, 4.5),
        "Cyrillic": Band(1.0, 8.0, 0.30, 4.5),
        "Greek": Band(0.5, 6.0, 0.80, 3.5),
        "Han": Band(0.3, 4.0, 0.95, 3.5),
        "Kana": Band(0.3, 5.0, 0.90, 3.5),
        "Hangul": Band(0.3, 4.0, 0.95, 3.5),
        "Arabic": Band(0.4, 6.0, 0.90, 3.5),
        "Hebrew": Band(0.4, 6.0, 0.90, 3.5),
        "Indic": Band(0.3, 5.0, 0.95, 3.5),
        "Thai": Band(0.3, 5.0, 0.95, 3.5),
        "Other": Band(0.2, 9.0, 1.00, 3.5),
        "None": Band(1.2, 9.0, 0.50, 4.0),
    },
}
#: A language or script has a band of its own from so many trusted documents on. It is as wide as so many distances of the
#: quartiles, and a distance counts as this share of the median at least; the byte share may always be the last number.
LEAST_TRUSTED, WIDTH, LEAST_SPREAD, FREE_SHARE = 30, 8.0, 0.02, 0.05

_MEASURED = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, lang string, script string, chars array<double>, shares array<double>, entropies array<double>"
)


def script_of(text: str) -> str:
    """The script that most letters belong to; ``None`` if there are none. Ties: the first by name."""
    if text.isascii():
        return "Latin" if re.search("[A-Za-z]", text) else "None"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = np.bincount(_CODES[np.searchsorted(_ENDS, points, side="right")], minlength=len(_NAMES))
    found[_NAMES.index("")] = 0
    return _NAMES[int(found.argmax())] if found.any() else "None"


class Vocabulary:
    """Pieces of single words under a public vocabulary, each word encoded once while it is remembered."""

    def __init__(self, path: str, remember: int = 300_000):
        self.remember, self.known = remember, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.bytes = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
            self.encode = lambda words: model.encode(words, num_threads=1)
        else:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            model = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.bytes = np.zeros(max(ranks.values()) + 1, bool)
            self.bytes[[i for piece, i in ranks.items() if not _whole(piece)]] = True
            self.encode = lambda words: [model.encode_ordinary(" " + w) for w in words]

    def learn(self, words: list[str]) -> None:
        """Encodes the words that are not known, all at once; forgets the others first if they are too many."""
        known = self.known
        if len(known) > self.remember:
            known.clear()
        new = [w for w in words if w not in known]
        if new:
            for word, ids in zip(new, self.encode(new), strict=True):
                known[word] = array("I", ids).tobytes()

    def measure(self, words: list[str], at: np.ndarray, doc: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
        """Characters per token, byte share and entropy, a row for each document; zeros where there are no tokens.

        ``words`` are the distinct ones, ``at`` the place in them of each word of the documents, ``doc`` its document.
        """
        self.learn(words)
        pieces = [self.known[w] for w in words]
        flat = np.frombuffer(b"".join(pieces), np.uint32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts[at] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        doc = np.repeat(doc, each)
        n = len(n_chars)
        total = np.bincount(doc, minlength=n).astype(np.float64)
        # Runs of the sorted pairs (document, id) are the documents' counts.
        ordered = np.sort(doc.astype(np.uint64) << np.uint64(32) | ids)
        last = np.flatnonzero(np.diff(ordered, append=np.uint64(1 << 63)))
        counts = np.diff(last, prepend=-1).astype(np.float64)
        weight = np.bincount((ordered[last] >> np.uint64(32)).astype(np.int64), counts * np.log2(counts), n)
        some = np.maximum(total, 1)
        entropy = np.maximum(0, np.log2(some) - weight / some)
        found = np.stack([n_chars / some, np.bincount(doc, self.bytes[ids], n) / some, entropy], axis=1)
        return np.where(total[:, None] > 0, found, 0)


def _whole(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


_WORDS = re.compile(WORD).findall
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def base_measures(text: str) -> tuple[list[str], int, int, int, int]:
    """The words, their code points, the symbols, the repeated lines and the words in repeated 3-word windows."""
    words = _WORDS(text)
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return words, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window which the list holds twice or more; each word counts once."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    if len(often) == len(windows):
        return 0
    covered, upto = 0, 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered += at + 3 - max(at, upto)
            upto = at + 3
    return covered


def measures(docs: DataFrame, vocabularies: dict[str, str], min_words: int = 50, most_repeated_percent: int = 50) -> DataFrame:
    """Base measures, language, script and what each vocabulary measures (arrays in their order), a row for each row of ``docs``."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meters = [Vocabulary(path) for path in vocabularies.values()]
        for ids, texts, langs in _bounded(columns_of(batches, "doc_id", "text", "lang", rows=SLICE)):
            decoded = [(raw or b"").decode("utf-8", "replace") for raw in texts]
            bases = [base_measures(text) for text in decoded]
            place: dict[str, int] = {}
            at = np.fromiter((place.setdefault(w, len(place)) for base in bases for w in base[0]), np.int64)
            doc = np.repeat(np.arange(len(bases)), [len(base[0]) for base in bases])
            chars = np.array([base[1] for base in bases], np.float64)
            found = np.stack([meter.measure(list(place), at, doc, chars) for meter in meters], axis=2)
            rows = []
            for i, (doc_id, text, lang, (words, n, symbols, same_lines, again)) in enumerate(zip(ids, decoded, langs, bases, strict=True)):
                failed = len(words) < min_words or 100 * again > most_repeated_percent * len(words)
                rows.append((doc_id, len(words), n, symbols, same_lines, again, failed, lang, script_of(text), *found[i].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_FIELDS)

    lang = F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), lang).mapInArrow(measured, _MEASURED)


def bands_from(measured: DataFrame, by: str, width: float = WIDTH) -> DataFrame:
    """Bands by the column ``by`` (lang or script) from :func:`measures` of trusted documents: key, n_docs and bands, an array by vocabulary.

    Quartiles by mergeable sketches, moved out by ``width`` times their distance. Documents that fail the base rules, and
    those whose key is null, are left out.
    """
    n = F.posexplode(F.arrays_zip("chars", "shares", "entropies")).alias("at", "m")
    each = measured.where(~F.col("base_failed") & F.col(by).isNotNull()).select(F.col(by).alias("key"), n).select("key", "at", "m.*")
    q = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000)
    spread = lambda c: width * F.greatest(F.col(c)[2] - F.col(c)[0], LEAST_SPREAD * F.col(c)[1])
    table = each.groupBy("key", "at").agg(F.count("*").alias("n_docs"), q("chars").alias("c"), q("shares").alias("b"), q("entropies").alias("e"))
    band = F.struct(
        (F.col("c")[0] - spread("c")).alias("least_chars"), (F.col("c")[2] + spread("c")).alias("most_chars"),
        F.greatest(F.col("b")[2] + spread("b"), F.lit(FREE_SHARE)).alias("most_bytes"), (F.col("e")[0] - spread("e")).alias("least_entropy"),
    )
    listed = F.array_sort(F.collect_list(F.struct("at", band.alias("band"))))
    return table.groupBy("key").agg(F.max("n_docs").alias("n_docs"), F.transform(listed, lambda x: x["band"]).alias("bands"))


def quality_rules(
    docs: DataFrame,
    vocabularies: dict[str, str],
    trusted: DataFrame | None = None,
    fixed: dict[str, dict[str, Band]] | None = None,
    min_words: int = 50,
    most_repeated_percent: int = 50,
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, optional lang): base measures, fertility and verdict.

    ``vocabularies`` maps a vocabulary's name to its file, which every executor can open; ``trusted`` (doc_id) names the
    documents that bands are taken from. The measures that are returned are those of the first vocabulary; all must
    hold. ``kept`` is false where the base rules fail (fewer than ``min_words`` words, or more than that percentage of
    words in repeated windows) or a band is left; ``reason`` names the first cause, ``band`` whose band it was.

    Nulls: a null text has no words and fails; a null doc_id is carried and never trusted; a null language has its
    script's band. Empty texts fail. Very long texts are measured whole. Repeated rows give repeated rows (and count
    each among the trusted). Other columns are not read. An empty table gives an empty result.
    """
    fixed = BANDS if fixed is None else fixed
    missing = [v for v in vocabularies if v not in fixed]
    if missing or not vocabularies:
        raise ValueError(f"no bands for the vocabularies {missing or 'given'}")
    found = measures(docs, vocabularies, min_words, most_repeated_percent)
    scripts = sorted(set.intersection(*({*fixed[v]} for v in vocabularies)))
    numbers = ("least_chars", "most_chars", "most_bytes", "least_entropy")
    literal = lambda b: F.struct(*(F.lit(float(getattr(b, x))).alias(x) for x in numbers))
    table = F.create_map(*[x for k in scripts for x in (F.lit(k), F.array(*(literal(fixed[v][k]) for v in vocabularies)))])
    plain = F.coalesce(F.try_element_at(table, F.col("script")), F.try_element_at(table, F.lit("Other")))
    if trusted is None:
        found = found.withColumn("band", F.lit("fixed")).withColumn("bands", plain)
    else:
        found = staged(found, "fertility")
        good = found.join(trusted.select(F.col("doc_id").alias("good_id")).where("good_id is not null").distinct(), F.col("doc_id") == F.col("good_id"), "left_semi")
        good = staged(good.select("lang", "script", "base_failed", "chars", "shares", "entropies"), "fertility-trusted")
        for by in ("lang", "script"):
            own = bands_from(good, by).where(F.col("n_docs") >= LEAST_TRUSTED).select(F.col("key").alias(f"{by}_key"), F.col("bands").alias(f"{by}_bands"))
            found = found.join(own, F.col(by) == F.col(f"{by}_key"), "left")
        whose = F.when(F.col("lang_bands").isNotNull(), F.concat(F.lit("lang "), "lang")).when(F.col("script_bands").isNotNull(), F.concat(F.lit("script "), "script")).otherwise("fixed")
        found = found.withColumn("band", whose).withColumn("bands", F.coalesce("lang_bands", "script_bands", plain))
    reason = F.when(F.col("base_failed"), "base")
    for i, name in enumerate(vocabularies):
        b = F.col("bands")[i]
        reason = reason.when((F.col("chars")[i] < b["least_chars"]) | (F.col("chars")[i] > b["most_chars"]), f"{name}: characters per token")
        reason = reason.when(F.col("shares")[i] > b["most_bytes"], f"{name}: byte share").when(F.col("entropies")[i] < b["least_entropy"], f"{name}: entropy")
    first = [F.col(c)[0].alias(x) for c, x in (("chars", "chars_per_token"), ("shares", "byte_share"), ("entropies", "token_entropy"))]
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = found.withColumn("reason", reason)
    return judged.select(*base, F.col("reason").isNull().alias("kept"), "script", *first, "reason", "band")


def _bounded(slices: Iterator[tuple[list, ...]]) -> Iterator[tuple[list, ...]]:
    """Slices cut further, so that one has about SLICE_BYTES of text or a single document."""
    for ids, texts, langs in slices:
        first, size = 0, 0
        for i, raw in enumerate(texts):
            size += len(raw or b"")
            if size >= SLICE_BYTES or i + 1 == len(texts):
                yield ids[first : i + 1], texts[first : i + 1], langs[first : i + 1]
                first, size = i + 1, 0


_FIELDS = [x.split()[0] for x in _MEASURED.split(", ")]
_KINDS = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
_TYPES = [_KINDS[x.split()[1]] for x in _MEASURED.split(", ")]
