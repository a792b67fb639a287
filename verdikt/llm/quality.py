"""Quality scores by a regularised quadratic discriminant.

A text is described by counts and shares of its characters, words and lines, each transformed towards a bell shape (logs
of sizes, logits of shares). Sums, and sums of products, over all labelled rows give each class its mean and covariance;
covariances shrink towards the pooled one and towards a multiple of the identity. The Cholesky factors are inverted once
and sent with the model; a score is the logistic function of the difference of the classes' log densities (from
Mahalanobis distances, determinants and class shares), damped by a fitted temperature.

All labelled rows count, with partial sums in each partition: the driver gets d + d^2 numbers a class. The temperature is
fitted on a sample of about ``FIT_ROWS`` labelled rows by a hash, twice as many at most.

Defined results: null and empty texts are scored like any text, from zero counts. Without labels every score is 0.5, with
one class only it is that class. Labels with a null quality or of documents that don't exist are ignored; a document with
several labels counts for each; rows that repeat a doc_id each get their row; an empty table gives no rows; only doc_id (as
a long), text and the given label column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, runs, small_batches, span_hashes, utf8, word_hashes

FIT_ROWS = 20_000
TO_POOLED, TO_IDENTITY = 0.2, 0.02
FEATURES = ("log_bytes", "letters", "upper", "digits", "stops", "symbols", "bars", "quotes", "space", "foreign", "word_length", "long_words", "new_words", "top_word", "lines", "new_lines", "line_length", "capital_words", "marks_run")
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?!", b"#$%&*@^~+=<>/\\", b"|_{}[]", b"\"'()`-", b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 9


def _logit(share: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = (share * n + 0.5) / (n + 1)
    return np.log(p / (1 - p))


def _distinct(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values and the commonest value's count for each row."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([at, [len(h)]]))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, rows[at], counts)
    return np.bincount(rows[at], minlength=n), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    by = np.bincount(row * 10 + kind, minlength=10 * n).reshape(n, 10)
    starts, stops, of = runs(kind != 8, offsets)
    words = np.bincount(of, minlength=n)
    length = stops - starts
    hashes, hash_rows = word_hashes(data, offsets)
    new, top = _distinct(hashes, hash_rows, n)
    capital = np.bincount(of, weights=kind[starts] == 2, minlength=n) if len(starts) else np.zeros(n)
    long_words = np.bincount(of, weights=length > 12, minlength=n) if len(starts) else np.zeros(n)
    ls, le, lrow = runs(data != 10, offsets)
    lines = np.bincount(lrow, minlength=n)
    new_lines, _ = _distinct(span_hashes(data, ls, le), lrow, n)
    marks = (kind[1:] >= 4) & (kind[1:] <= 6) & (kind[:-1] >= 4) & (kind[:-1] <= 6) & (row[1:] == row[:-1]) if len(data) else np.zeros(0, bool)
    run = np.bincount(row[1:][marks], minlength=n) if len(data) else np.zeros(n)
    s, w, ln = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
    share = lambda k: _logit(by[:, k] / s, size)
    out = [
        np.log1p(size), _logit((by[:, 1] + by[:, 2] + by[:, 9]) / s, size), share(2), share(3), share(4), share(5), share(6), share(7), share(8), share(9),
        np.log1p(size / w), _logit(long_words / w, words), _logit(new / w, words), _logit(top / w, words),
        np.log1p(lines), _logit(new_lines / ln, lines), np.log1p(size / ln), _logit(capital / w, words), _logit(run / s, size),
    ]
    return np.stack(out, 1)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        x = statistics(*utf8(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the vector x of ``FEATURES`` for every row."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_described, "doc_id long, x array<double>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        y = b.column(1).to_numpy()
        x = np.stack(b.column(0).to_pylist()) if len(y) else np.zeros((0, len(FEATURES)))
        z = np.hstack([np.ones((len(y), 1)), x])
        for k in set(y.tolist()):
            held[k] = held.get(k, 0) + z[y == k].T @ z[y == k]
    for k, m in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], ["y", "at", "v"])


class Model:
    """Means, inverse Cholesky factors and offsets of the two classes; None where the labels don't allow one."""

    def __init__(self, sums: dict[int, np.ndarray], pooled: float = TO_POOLED, identity: float = TO_IDENTITY) -> None:
        self.classes, self.temperature, self.only = {}, 1.0, 0.5
        total = sum(m[0, 0] for m in sums.values())
        if len(sums) < 2:
            self.only = float(next(iter(sums))) if sums else 0.5
            return
        d = len(FEATURES)
        means = {k: m[0, 1:] / m[0, 0] for k, m in sums.items()}
        spread = {k: m[1:, 1:] / m[0, 0] - np.outer(means[k], means[k]) for k, m in sums.items()}
        within = sum(m[0, 0] / total * spread[k] for k, m in sums.items())
        self.scale = np.sqrt(np.maximum(np.diag(within), 1e-6))
        self.centre = sum(m[0, 0] / total * means[k] for k, m in sums.items())
        within = within / np.outer(self.scale, self.scale)
        for k, m in sums.items():
            cov = spread[k] / np.outer(self.scale, self.scale)
            # a class of few rows leans on the pooled covariance
            lean = max(pooled, d / (d + m[0, 0]))
            cov = (1 - lean) * cov + lean * within
            cov = (1 - identity) * cov + identity * max(np.trace(cov) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.classes[k] = ((means[k] - self.centre) / self.scale, np.linalg.inv(factor), float(np.log(m[0, 0] / total) - np.log(np.diag(factor)).sum()))

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        log = {k: c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for k, (m, f, c) in self.classes.items()}
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.only)
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -50, 50)))


def fit(described: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """``labels``: doc_id and quality (0 or 1)."""
    labels = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = cut(described.join(labels, "doc_id").select("x", "quality", "doc_id"), "labelled")
    sums: dict[int, np.ndarray] = {}
    d = len(FEATURES) + 1
    for r in known.select("x", "quality").mapInArrow(_sums, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r["y"], np.zeros(d * d))[r["at"]] = r["v"]
    model = Model({k: v.reshape(d, d) for k, v in sums.items()})
    if model.classes:
        n = sum(v[0] for v in sums.values())
        sampled = F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30))
        # equal rows fall into the sample together, so it is bounded once more; a sample without rows leaves 1
        some = known.where(sampled).select("x", "quality").limit(2 * rows).toPandas()
        if not len(some):
            return model
        margin, y = model.margin(np.stack(some["x"])), some["quality"].to_numpy()
        grid = np.exp(np.linspace(0, np.log(50), 60))
        loss = [np.mean(np.logaddexp(0, np.where(y == 1, -margin, margin) / t)) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _scores(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack(b.column(1).to_pylist()) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return score


def score(described: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: quality 1 is likelier) for every row of ``describe``'s result."""
    return described.select("doc_id", "x").mapInArrow(_scores(model), "doc_id long, score double")
