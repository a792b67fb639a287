"""Softmax regressions and isotonic curves fitted on all rows, with the rows where they lie.

``fit_linear`` solves many small problems at once: each iteration is one job, in which every partition adds up its rows'
losses, gradients and second derivatives for all problems, and only those sums, a row a problem and partition, are
shuffled. The driver holds the parameters (options x features of each problem) and takes a Newton step for all of them; the
next job tries several lengths of it. ``isotonic_curves`` pools adjacent violators in sorted ranges and
then the ranges' blocks.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Step lengths that a job tries at once.
STEPS = (1.0, 0.5, 0.25, 0.0625, 1.0 / 256)
#: Problems whose second derivatives have more numbers than this are too large for these steps.
MOST_PARAMETERS = 1024


@dataclasses.dataclass
class Problem:
    """Least mean log loss of softmax(x W' + b) plus sum of cost * (parameter - centre)^2; parameters are one vector, W by rows and
    then b, of which those that aren't ``free`` keep their start. ``rows`` names the rows that it learns from: a value of
    the table's ``of`` column, and the parts left out, as pairs of a fold column and its value. ``cost`` is a function of
    the number of rows."""

    of: str
    left_out: tuple[tuple[str, int], ...]
    k: int
    d: int
    free: np.ndarray
    start: np.ndarray
    centre: np.ndarray
    cost: Callable[[int], np.ndarray]
    classes: tuple[int, ...] | None = None


def _design(problem: Problem, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if problem.classes is not None:
        code = np.full(max(int(y.max(initial=0)) + 1, max(problem.classes) + 1), -1)
        code[list(problem.classes)] = np.arange(len(problem.classes))
        y = code[y]
    return np.hstack([x, np.ones((len(x), 1))]), y


def _sums(problem: Problem, points: list[np.ndarray], full: bool, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` rows are like each of x and y. Rows, summed losses at the points, and at the first point the gradient and the second derivatives, as one vector."""
    design, y = _design(problem, x, y)
    k, d = problem.k, problem.d
    out = [np.array([float(n.sum())])]
    probs = None
    for v in points:
        s = design @ np.vstack([v[: k * d].reshape(k, d).T, v[k * d :]])
        s -= s.max(1, keepdims=True)
        total = np.log(np.exp(s).sum(1))
        out.append(np.array([float(((total - s[np.arange(len(y)), y]) * n).sum())]))
        if probs is None:
            probs = np.exp(s - total[:, None])
    if full:
        hot = np.eye(k)[y]
        g = design.T @ ((probs - hot) * n[:, None])
        out.append(np.concatenate([g[:d].T.ravel(), g[d]]))
        place = lambda i: np.concatenate([np.arange(i * d, i * d + d), [k * d + i]])
        h = np.zeros((k * d + k, k * d + k))
        for i in range(k):
            for j in range(i, k):
                w = probs[:, i] * ((i == j) - probs[:, j]) * n
                block = design.T @ (design * w[:, None])
                h[np.ix_(place(i), place(j))] = block
                h[np.ix_(place(j), place(i))] = block.T
        out.append(h[np.ix_(problem.free, problem.free)].ravel())
    return np.concatenate(out)


def _added(rows: DataFrame, of: str, folds: list[str], asked: list[tuple[int, Problem, list[np.ndarray], bool]]) -> dict[int, np.ndarray]:
    """The sums of each asked problem over its rows, with one row a problem and partition sent on."""
    by_name: dict[str, list] = {}
    for q in asked:
        by_name.setdefault(q[1].of, []).append(q)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            names = pd.factorize(b.column(0).to_numpy(zero_copy_only=False))
            y, lists = b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            counts = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            parts = {c: b.column(4 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(folds)}
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            for code, name in enumerate(names[1]):
                own = np.flatnonzero(names[0] == code)
                for at in range(0, len(own), 8192):
                    some = own[at : at + 8192]
                    width = offsets[some[0] + 1] - offsets[some[0]]
                    x = flat[offsets[some][:, None] + np.arange(width)]
                    for key, problem, points, full in by_name.get(name, ()):
                        keep = np.ones(len(some), bool)
                        for c, v in problem.left_out:
                            keep &= parts[c][some] != v
                        if keep.any():
                            s = _sums(problem, points, full, x[keep], y[some][keep], counts[some][keep])
                            held[key] = held[key] + s if key in held else s
        for key, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([s.tolist()], pa.list_(pa.float64()))], ["key", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for key, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = s.values.to_numpy()
                held[key] = held[key] + v if key in held else v.copy()
        for key, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([s.tolist()], pa.list_(pa.float64()))], ["key", "sums"])

    kind = "key int, sums array<double>"
    sent = rows.select(F.col(of).cast("string"), F.col("gold").cast("long"), "x", F.col("n") if "n" in rows.columns else F.lit(1).alias("n"), *folds).mapInArrow(add, kind)
    return {r["key"]: np.array(r["sums"]) for r in sent.repartition(min(8, max(1, len(asked))), "key").mapInArrow(total, kind).collect()}


def fit_linear(rows: DataFrame, problems: list[Problem], of: str = "task", folds: list[str] = (), rounds: int = 60, tol: float = 1e-8) -> list[np.ndarray | None]:
    """The solution of each problem over ``rows`` (of, gold, x, folds; with a column ``n`` each stands for n equal ones), or None
    where it has no rows.

    Problems are convex, so damped Newton steps reach the minimum; a problem ends with the step that promises
    less than ``tol``, after which little is left, as steps converge quadratically.
    """
    folds = list(folds)
    for p in problems:
        if p.k * (p.d + 1) > MOST_PARAMETERS:
            raise ValueError(f"more than {MOST_PARAMETERS} parameters: fit it with sparse rows")
    point = [p.start.astype(float).copy() for p in problems]
    step: list[np.ndarray | None] = [None] * len(problems)
    value = [np.inf] * len(problems)
    found: list[np.ndarray | None] = [None] * len(problems)
    open_ = set(range(len(problems)))

    def along(i: int, length: float) -> np.ndarray:
        v = point[i].copy()
        v[problems[i].free] -= length * step[i]
        return v

    for _ in range(rounds):
        if not open_:
            break
        # one job: for a problem that moves the losses along its step, and the derivatives after the whole step
        asked = {i: [point[i]] if step[i] is None else [along(i, s) for s in STEPS] for i in sorted(open_)}
        sums = _added(rows, of, folds, [(i, problems[i], points, True) for i, points in asked.items()])
        for i, points in asked.items():
            p = problems[i]
            if i not in sums:
                open_.discard(i)
                continue
            n, size, tried = sums[i][0], p.k * p.d + p.k, len(points)
            cost = p.cost(int(n))
            values = [sums[i][1 + j] / n + (cost * (v - p.centre) ** 2).sum() for j, v in enumerate(points)]
            best = int(np.argmin(values))
            if step[i] is not None and not values[best] < value[i]:
                found[i] = point[i]
                open_.discard(i)
                continue
            point[i], value[i] = points[best], values[best]
            if best:  # a shorter step: the next job gives its derivatives
                step[i] = None
                continue
            g = (sums[i][1 + tried : 1 + tried + size] / n + 2 * cost * (point[i] - p.centre))[p.free]
            h = sums[i][1 + tried + size :].reshape(p.free.sum(), -1) / n + np.diag(2 * cost[p.free])
            step[i] = np.linalg.lstsq(h, g, rcond=1e-12)[0]
            if g @ step[i] <= tol:
                found[i] = along(i, 1.0) if g @ step[i] > 0 else point[i]
                open_.discard(i)
    for i in open_:
        found[i] = point[i]
    return found


def losses_of(rows: DataFrame, asked: list[tuple[Problem, np.ndarray]], of: str = "task", folds: list[str] = ()) -> list[tuple[float, int]]:
    """Summed loss and number of rows of each problem's rows at a point."""
    sums = _added(rows, of, list(folds), [(i, p, [v], False) for i, (p, v) in enumerate(asked)])
    return [(float(sums[i][1]), int(sums[i][0])) if i in sums else (0.0, 0) for i in range(len(asked))]


def _pool(lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[list[float]]:
    """Pool adjacent violators over blocks in order; a block is [lo, hi, weight, total]."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), weight.tolist(), total.tolist(), strict=True):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            last = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = last[1], out[-1][2] + last[2], out[-1][3] + last[3]
    return out


BLOCKS = "curve string, lo double, hi double, weight double, total double"


def isotonic_curves(points: DataFrame, curve: str, x: str, y: str, n_rows: str | None = None) -> DataFrame:
    """curve, lo, hi, weight and total: the blocks of the isotonic regression of ``y`` on ``x`` for each curve; a block's value is
    total / weight. ``n_rows`` names a column of how many rows each stands for.

    Equal values of x are added up, the sums are dealt by ranges of (curve, x), and each range is pooled in order as it
    streams past. Pooling ranges first and their blocks afterwards gives the same blocks as pooling all points: blocks are
    few (of n answers that are right or wrong at most about n^(2/3)), so those of a curve fit one task.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = points.select(F.col(curve).cast("string").alias("curve"), F.col(x).cast("double").alias("lo"), F.col(y).cast("double").alias("y"), (F.col(n_rows) if n_rows else F.lit(1)).cast("double").alias("w"))
    sums = sums.where("curve is not null and lo is not null and y is not null").groupBy("curve", "lo").agg(F.sum("w").alias("weight"), F.sum(F.col("y") * F.col("w")).alias("total"))

    def ranges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, blocks = None, []
        frame = lambda: pd.DataFrame([[held, *b] for b in blocks], columns=["curve", "lo", "hi", "weight", "total"])
        for pdf in parts:
            for name, own in pdf.groupby("curve", sort=True):
                if name != held:
                    if blocks:
                        yield frame()
                    held, blocks = name, []
                old = np.array(blocks).reshape(-1, 4)
                new = np.stack([own["lo"], own["lo"], own["weight"], own["total"]], 1)
                blocks = _pool(*np.concatenate([old, new]).T)
        if blocks:
            yield frame()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        blocks = _pool(*(pdf[c].to_numpy() for c in ("lo", "hi", "weight", "total")))
        return pd.DataFrame([[pdf["curve"].iloc[0], *b] for b in blocks], columns=["curve", "lo", "hi", "weight", "total"])

    some = sums.repartitionByRange(n, "curve", "lo").sortWithinPartitions("curve", "lo").mapInPandas(ranges, BLOCKS)
    return some.groupBy("curve").applyInPandas(whole, BLOCKS)


def knots(blocks: list[tuple[float, float, float, float]]) -> tuple[list[float], list[float]]:
    """Knots and values of the blocks (lo, hi, weight, total) of a curve, for clipped linear interpolation."""
    at, values = [], []
    for lo, hi, weight, total in sorted(blocks):
        for v in dict.fromkeys((lo, hi)):
            at.append(v)
            values.append(total / weight)
    return at, values
