"""Quality classifier by positive-unlabelled learning.

Known are trusted positives (texts labelled good) and unlabelled web text, a mixture of good and bad
with an unknown share of good, the class prior. The prior is estimated first, by the best bin: a plain classifier of
positives against unlabelled text ranks texts that it has not seen; of all thresholds, the one is taken at which
the share of unlabelled texts above it, over that of positives, is least (with allowance for chance). Where only
good texts score that high, this ratio is the prior. Then a linear model is fitted that minimises the non-negative
unbiased risk

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

with the logistic loss; where the second part falls below zero, steps go against its gradient only, which
keeps a flexible model from overfitting it. No negative label is used. The score is the logistic of f.

Features are computed from the text's bytes and words only, once for each document (:func:`features`). The gradients
are taken on a bounded sample, in one task; the features' means and deviations and the shares of unlabelled
texts above the bins are counted over all documents. The driver gets a model and a thousand counts at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, staged, text_bytes, whole_row

#: The model is fitted on at most so many positives and so many unlabelled texts, those of least hash; the prior's bins are at most so many.
SAMPLE, BINS = 20_000, 1000
#: Sums of features are kept as whole numbers of this unit, so that they do not depend on the order of the tasks.
_UNIT = float(1 << 20)
THRESHOLD = 0.3
_LOWER, _UPPER, _DIGIT = frozenset(range(97, 123)), frozenset(range(65, 91)), frozenset(range(48, 58))
_SYMBOLS = b"#*$%&|<>"
_CLASSES = np.zeros((256, 8))
for _c in range(256):
    _CLASSES[_c, 0 if _c in _LOWER else 1 if _c in _UPPER else 2 if _c in _DIGIT else 3 if _c in (32, 9, 10, 11, 12, 13) else 4 if _c > 127 else 5 if _c in _SYMBOLS else 6 if _c in b".,;:!?'\"()-" else 7] = 1


def features_of(raw: bytes | None) -> np.ndarray:
    """The features of a text; a text without words has zeros and a flag."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    if not n:
        out = np.zeros(N_FEATURES)
        out[0] = 1.0
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts @ _CLASSES / len(raw)
    often = Counter(words)
    top = [c for _, c in often.most_common(8)]
    pairs = Counter(zip(words, words[1:], strict=False))
    twins = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.int64, n)
    shouted = sum(w.isupper() for w in words)
    titled = sum(65 <= w[0] <= 90 or w[0] > 127 for w in words)
    ended = sum(w[-1] in b".!?" for w in words)
    commas = sum(w[-1] == 44 for w in words)
    wordless = sum(len(w) == 1 and not w.isalnum() and w[0] < 128 for w in words)
    marked = sum(w[-1] in _SYMBOLS for w in words)
    lines = raw.split(b"\n")
    letters = shares[0] + shares[1] + shares[4]
    dense = [
        0.0, np.log1p(n), np.log1p(len(raw)) - np.log1p(n), lengths.mean() / 10, min(lengths.std(), 20) / 10, min(lengths.max(), 80) / 80,
        *shares, shares[1] / (letters + 1e-9), len(often) / n, np.log1p(len(often)) / np.log1p(n), top[0] / n, sum(top[:3]) / n, sum(top) / n,
        twins / n, len(pairs) / max(1, n - 1), shouted / n, titled / n, ended / n, commas / n, wordless / n, marked / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines) / (n / len(lines) + 20), 1.0 if n < 10 else 0.0, 1.0 if n < 50 else 0.0,
    ]
    marks = counts[33:127] / len(raw)
    steps = [float(x > t) for x in (twins / n, shouted / n, wordless / n, marked / n) for t in (0.05, 0.2)]
    return np.concatenate([dense, np.sqrt(marks), steps])


N_FEATURES = 6 + 8 + 1 + 5 + 2 + 6 + 5 + 94 + 8


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(scaled(x, self.centre, self.scale).astype(np.float64) @ np.append(self.weights, self.bias))


def scaled(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The rows of ``x`` about the centre, within eight deviations, and a column of ones: one float32 matrix."""
    out = np.empty((len(x), x.shape[1] + 1), np.float32)
    np.subtract(x, centre.astype(np.float32), out=out[:, :-1])
    out[:, :-1] /= scale.astype(np.float32)
    np.clip(out[:, :-1], -8, 8, out=out[:, :-1])
    out[:, -1] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero, with a rate that falls to a tenth."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _values(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x @ w.astype(np.float32)).astype(np.float64)


def _pulled(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return (by.astype(np.float32) @ x).astype(np.float64)


def ranking(p: np.ndarray, u: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights of a plain classifier of the rows ``p`` against ``u`` (both scaled)."""

    def gradient(w: np.ndarray) -> np.ndarray:
        return -_pulled(p, 1 - _sigmoid(_values(p, w))) / len(p) + _pulled(u, _sigmoid(_values(u, w))) / len(u) + 2e-3 * w

    return _descend(gradient, p.shape[1], steps)


def bins_of(scores: np.ndarray, most: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds, at most ``most`` of the positives' scores in rising order, and the share of positives at or above each."""
    ordered = np.sort(scores)
    at = np.unique(np.linspace(0, len(ordered) - 1, min(most, len(ordered))).astype(np.int64))
    return ordered[at], (len(ordered) - np.searchsorted(ordered, ordered[at], side="left")) / len(ordered)


def best_bin(above: np.ndarray, n_positive: int, share: np.ndarray, n_unlabelled: int) -> float:
    """The prior from the shares of ``n_positive`` positives and of ``n_unlabelled`` texts above the same thresholds."""
    chance = sum(np.sqrt(np.log(40) / (2 * max(1, n))) for n in (n_positive, n_unlabelled))
    best = int(np.argmin(share / above + 1.01 * chance / above))
    return float(np.clip(share[best] / above[best], 0.05, 0.99))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every other row for the classifier, the rest for the bins; a single row is for both."""
    return x[::2], x[1::2] if len(x) > 1 else x


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200) -> float:
    """Share of positives among the unlabelled (both scaled)."""
    (p, seen_p), (u, seen_u) = halves(positive), halves(unlabelled)
    w = ranking(p, u, steps)
    at, above = bins_of(_values(seen_p, w))
    su = np.sort(_values(seen_u, w))
    return best_bin(above, len(seen_p), (len(su) - np.searchsorted(su, at, side="left")) / len(su), len(su))


def fit(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float | None = None,
    centre: np.ndarray | None = None,
    scale: np.ndarray | None = None,
    times: np.ndarray | None = None,
    steps: int = 400,
    decay: float = 1e-3,
) -> Model:
    """The model of least non-negative risk; ``times``: how often each unlabelled row counts. Without positives or unlabelled rows every score is one half."""
    size = N_FEATURES if not len(positive) else positive.shape[1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(size), 0.0, np.zeros(size), np.ones(size), prior or 0.5)
    if centre is None or scale is None:
        centre, scale = unlabelled.mean(axis=0, dtype=np.float64), unlabelled.std(axis=0, dtype=np.float64) + 1e-3
    p, u = scaled(positive, centre, scale), scaled(unlabelled, centre, scale)
    prior = estimate_prior(p, u) if prior is None else prior
    share = np.full(len(u), 1 / len(u)) if times is None else times / times.sum()
    w = _descend(lambda w: risk_gradient(w, p, u, share, prior, decay)[1], p.shape[1], steps)
    return Model(w[:-1], float(w[-1]), centre, scale, prior)


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, share: np.ndarray, prior: float, decay: float) -> tuple[float, np.ndarray]:
    """The non-negative risk at ``w`` and the direction against which a step goes; ``share`` weighs the rows of ``u``; the last weight, the bias, isn't shrunk."""
    vp, vu = _values(p, w), _values(u, w)
    fp, fu = _sigmoid(vp), _sigmoid(vu)
    # loss(f) = log(1 + exp(-f)); its gradient in f is sigmoid(f) - 1, that of loss(-f) is sigmoid(f).
    negative = share @ np.logaddexp(0, vu) - prior * np.logaddexp(0, vp).mean()
    of_negative = _pulled(u, share * fu) - prior * _pulled(p, fp) / len(p)
    plain = np.append(w[:-1], 0)
    risk = prior * np.logaddexp(0, -vp).mean() + max(0.0, negative) + decay / 2 * plain @ plain
    if negative < 0:
        return risk, -of_negative + decay * plain
    return risk, prior * _pulled(p, fp - 1) / len(p) + of_negative + decay * plain


def held_out(doc_id: str = "doc_id"):
    """Rows whose label is never learnt: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _stacked(texts: list[bytes | None]) -> np.ndarray:
    return np.stack([features_of(t) for t in texts]).astype(np.float32) if texts else np.zeros((0, N_FEATURES), np.float32)


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of ``docs`` (doc_id, text), staged; x holds the features as float32 numbers.

    A null text is empty; texts without words have a feature of their own; null ids are carried. Very long texts are read
    whole. Repeated rows are rows of their own. Other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns_of(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in _stacked(texts)], pa.binary())], names=["doc_id", "x"])

    return staged(docs.select("doc_id", text_bytes()).mapInArrow(run, "doc_id bigint, x binary"), "pu-features")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, N_FEATURES), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            x = _rows(batch.column(0).slice(at, 4096)).astype(np.float64)
            total += np.stack([np.rint(x * _UNIT).astype(np.int64).sum(axis=0), np.rint(x * x * _UNIT).astype(np.int64).sum(axis=0)])
    yield pa.RecordBatch.from_arrays([pa.array(range(N_FEATURES), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["at", "s", "q"])


def moments(described: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the features over all rows, as :func:`fit` takes them; one row for each feature is collected."""
    rows = described.select("x").mapInArrow(_summed, "at int, s bigint, q bigint").groupBy("at").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    s, q = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for r in rows:
        s[r["at"]], q[r["at"]] = r["s"] / _UNIT / max(1, n), r["q"] / _UNIT / max(1, n)
    return s, np.sqrt(np.maximum(0, q - s * s)) + 1e-3


def _sampled(ids: DataFrame, n: int, sample: int, seed: int) -> DataFrame:
    """The ``sample`` distinct ids of least hash; a first cut by the hash, for about ``n`` ids, leaves little more than that to be ordered."""
    part = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 33)
    near = ids if n <= 2 * sample else ids.where(part < int((1 << 31) * min(1.0, 1.5 * sample / n)))
    return near.distinct().orderBy(part, "doc_id").limit(sample)


def _on_sample(sample: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes]) -> bytes | None:
    """What ``work`` makes of the positive and the unlabelled rows of the sample and how often the latter count, in one task; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, list[np.ndarray]] = {True: [], False: []}
        often: list[np.ndarray] = [np.zeros(0)]
        for batch in batches:
            kinds, x = np.array(batch.column(0).to_pylist(), bool), _rows(batch.column(1))
            for kind in found:
                found[kind].append(x[kinds == kind])
            often.append(batch.column(2).to_numpy()[~kinds])
        p, u = (np.concatenate([np.zeros((0, N_FEATURES), np.float32), *found.pop(kind)]) for kind in (True, False))
        yield pa.RecordBatch.from_arrays([pa.array([work(p, u, np.concatenate(often))], pa.binary())], names=["made"])

    # The rows are sorted, as the fit shall not depend on how they come.
    row = sample.repartition(1).sortWithinPartitions("positive", "x", "times").mapInArrow(run, "made binary").first()
    return None if row is None else bytes(row[0])


def _counted(w: np.ndarray, thresholds: np.ndarray, centre: np.ndarray, scale: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(thresholds) + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                values = _values(scaled(_rows(batch.column(0).slice(at, 4096)), centre, scale), w)
                counts += np.bincount(np.searchsorted(thresholds, values, side="right"), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bin", "n"])

    return run


def train(described: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fits on the positives among ``labels`` (doc_id, quality) and on the texts of ``described`` (see :func:`features`).

    The gradients take at most ``sample`` of each, those of least hash of the id, rows held out excepted; of rows that
    repeat an id one is taken, and an unlabelled one counts as often as its id. Only these ids are broadcast, and their features meet in one task: both bounded by
    ``sample``. Means, deviations and the prior's shares are those of all rows.

    Labels without an id or a document, with a null quality or repeated, are left out or count once. Without positives
    or texts every score is one half.
    """
    apart = described.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id")
    n, near = described.agg(F.count("*"), F.approx_count_distinct(F.when(F.col("doc_id").isNotNull() & ~held_out(), F.col("doc_id")))).first()
    known = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id")
    good = _sampled(known, known.agg(F.approx_count_distinct("doc_id")).first()[0], sample, seed)
    some = _sampled(apart, near, sample, seed)
    wanted = good.withColumn("positive", F.lit(True)).unionByName(some.withColumn("positive", F.lit(False))).withColumnRenamed("doc_id", "wanted")
    chosen = described.join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted")).groupBy("doc_id", "positive").agg(F.min("x").alias("x"), F.count("*").alias("times"))
    chosen = staged(chosen.select("positive", "x", "times"), "pu-sample")
    nothing = fit(np.zeros((0, N_FEATURES)), np.zeros((0, N_FEATURES)))
    centre, scale = moments(described, n)

    def ranked(p: np.ndarray, u: np.ndarray, _: np.ndarray) -> bytes:
        if not len(p) or not len(u):
            return b""
        (p, seen), (u, _) = halves(scaled(p, centre, scale)), halves(scaled(u, centre, scale))
        w = ranking(p, u)
        at, above = bins_of(_values(seen, w))
        return np.concatenate([[len(seen), len(at)], w, at, above]).tobytes()

    made = _on_sample(chosen, ranked)
    if not made:
        return nothing
    flat = np.frombuffer(made)
    n_seen, n_bins, flat = int(flat[0]), int(flat[1]), flat[2:]
    w, at, above = flat[: N_FEATURES + 1], flat[N_FEATURES + 1 : N_FEATURES + 1 + n_bins], flat[N_FEATURES + 1 + n_bins :]
    counts = np.zeros(n_bins + 1, np.int64)
    for r in described.select("x").mapInArrow(_counted(w, at, centre, scale), "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    prior = best_bin(above, n_seen, counts[::-1].cumsum()[::-1][1:] / n, n)

    def fitted(p: np.ndarray, u: np.ndarray, times: np.ndarray) -> bytes:
        model = fit(p, u, prior, centre, scale, times)
        return np.append(model.weights, model.bias).tobytes()

    w = np.frombuffer(_on_sample(chosen, fitted))
    return Model(w[:-1], float(w[-1]), centre, scale, prior)


def score(described: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``described`` (see :func:`features`): doc_id, held_out, score in 0..1 and predicted (1 from ``threshold``).

    A null doc_id is carried and not held out. Equal texts have equal scores; repeated rows are returned each. An empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(_rows(batch.column(2))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return described.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that score ``threshold`` or more, with all columns; decided row by row, without a shuffle.

    Null, empty and very long texts and null ids: as :func:`features`. Repeated rows are decided alike and kept each. Extra
    columns may have any names. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep += (model.scores(_stacked(part.column(0).field("text").cast(pa.binary()).to_pylist())) >= threshold).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    row = docs.select(whole_row(docs))
    return row.mapInArrow(run, row.schema).select("row.*")
