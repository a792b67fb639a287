"""Hard negatives: for each anchor and positive the best rows of other labels whose score lies in a window of the positive's.

Components are numbers of a grid (``floor(scale * x)``, x as double), so scores are exact integers whatever the order of
their sums. Higher scores come first, ties by smaller vec_id.

Rows are dealt into blocks by a hash of their number in the table; every block meets all anchors, which stream past it. In a block
an anchor's scores are computed as one product and sorted in full (the block lies in the order of ids, and the sort by
score is stable: a lexicographic sort by score and id). A first pass reads the anchor's best rows of its own label, of
which the best over all blocks are its positives. A second pass searches each positive's upper limit in the sorted scores
and reads the first k rows of other labels that lie above the lower limit; the best over all blocks are the result. A task
holds one block and a batch of anchors at a time, whatever the number of rows, anchors or rows of a label.

Defined results: rows whose vec_id, label or vector is null or that hold a null or non-finite component take no part (a row
without an id couldn't be named). Vectors of different length have no score with each other; empty ones score 0 with each
other. Rows that repeat a vec_id are rows of their own: another row than the anchor even with its id, and every one of an
anchor's id is an anchor; equal ids with equal scores lie in the order of the table. Scores outside a long raise an error. An anchor
without another row of its label, and a positive whose window holds no row, give no rows; a negative positive's window is
empty. An empty table gives no rows. Only vec_id (as a long), label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, small_batches

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LOW, HIGH = 30, 90
EVERY = 100
#: Components of a block's vectors, and anchors that meet a block at a time.
BLOCK_COMPONENTS, BATCH = 1 << 22, 64
#: A small table gets so many blocks where they have so many rows; the result doesn't depend on it.
BLOCKS, LEAST_ROWS = 24, 1024
_KINDS = {b"2": np.dtype("<i2"), b"4": np.dtype("<i4"), b"8": np.dtype("<f8")}
GRID = "vec_id long, label string, n int, grid binary"
MET = "anchor long, anchor_id long, place int, positive_id long, positive_score long, row long, vec_id long, score long"


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The query's rows: vec_ids divisible by ``every`` get the next label."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), "embedding")


def _on_grid(scale: int):
    def on_grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, label, vector -> vec_id, label, length and the grid numbers in the narrowest kind that holds them."""
        for b in batches:
            lists, keep, sizes, grids = b.column(2), [], [], []
            for i in range(b.num_rows):
                v = lists[i].values if lists[i].is_valid else None
                if v is None or v.null_count:
                    continue
                x = v.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                g = np.floor(x * scale)
                if not np.isfinite(g).all():
                    raise ArithmeticError("a grid number outside the range of doubles")
                most = np.abs(g).max(initial=0)
                kind = b"2" if most < 1 << 15 else b"4" if most < 1 << 31 else b"8"
                keep.append(i)
                sizes.append(len(g))
                grids.append(kind + g.astype(_KINDS[kind]).tobytes())
            own = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(sizes, pa.int32()), pa.array(grids, pa.binary())], ["vec_id", "label", "n", "grid"])

    return on_grid


def _matrix(grids: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(g, _KINDS[g[:1]], offset=1).astype(np.float64) for g in grids]).reshape(len(grids), -1)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum leaves their integers, else in longs, else in Python's integers."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if most < 1 << 53:
        return (anchors @ rows.T).astype(np.int64)
    if most < 1 << 62:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    out = whole(anchors) @ whole(rows).T
    if max(map(abs, out.ravel()), default=0) >= 1 << 63:
        raise ArithmeticError("a score outside the range of longs")
    return out.astype(np.int64)


def _of_own_label(k: int):
    def read(order: np.ndarray, score: np.ndarray, own: np.ndarray, mark: dict) -> Iterator[tuple]:
        for i in order[own[order]][:k]:
            yield 0, None, None, i, score[i]

    return read


def _in_windows(k: int, low: int, high: int):
    def read(order: np.ndarray, score: np.ndarray, own: np.ndarray, mark: dict) -> Iterator[tuple]:
        other = order[~own[order]]
        falling = -score[other]
        for place, positive in enumerate(mark["positives"]):
            p = positive["score"]
            top, least = p * high // 100, -(-p * low // 100)  # low * p <= 100 * score <= high * p
            at = int(np.searchsorted(falling, -top, "left"))
            for i in other[at : at + k]:
                if score[i] < least:
                    break
                yield place, positive["vec_id"], p, i, score[i]

    return read


class _Block:
    """One block's rows in the order of ids."""

    def __init__(self, tables: list[pa.Table]):
        t = pa.concat_tables(tables)
        ids, rows = t["vec_id"].to_numpy(), t["row"].to_numpy()
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        names = t["label"].combine_chunks().dictionary_encode()
        self.labels = names.indices.to_numpy()[order]
        self.code = {x: i for i, x in enumerate(names.dictionary.to_pylist())}
        grids = t["grid"].to_pylist()
        self.x = _matrix([grids[i] for i in order])

    def meet(self, anchors: list[dict], read) -> list[tuple]:
        out = []
        score = _scores(_matrix([a["grid"] for a in anchors]), self.x)
        for s, a in zip(score, anchors, strict=True):
            order = np.argsort(-s, kind="stable")
            order = order[self.rows[order] != a["row"]]
            own = self.labels == self.code.get(a["label"], -1)
            out += [(a["row"], a["vec_id"], place, pid, p, int(self.rows[i]), int(self.ids[i]), int(x)) for place, pid, p, i, x in read(order, s, own, a)]
        return out


def _meeting(read):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by block, with a block's rows before its anchors."""
        schema = pa.schema([(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.int64()) for c in MET.split(", ")])
        key, held, block, waiting = None, [], None, []

        def answer():
            found = block.meet(waiting, read)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema) if found else None

        for b in batches:
            keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.int8()).to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                part, one = b.slice(at, end - at), tuple(keys[at][:2])
                if one != key:
                    if waiting and (out := answer()):
                        yield out
                    key, held, block, waiting = one, [], None, []
                if not keys[at][2]:
                    held.append(pa.Table.from_batches([part]))
                    continue
                if block is None and held:
                    block, held = _Block(held), []
                if block is None:
                    continue
                for a in part.to_pylist():
                    waiting.append(a)
                    if len(waiting) == BATCH:
                        if out := answer():
                            yield out
                        waiting = []
        if waiting and (out := answer()):
            yield out
        give_back()

    return meet


def _met(rows: DataFrame, anchors: DataFrame, counts: dict[int, int], read) -> DataFrame:
    """What ``read`` finds where every block of ``rows`` meets every anchor of its length."""
    blocks = {n: max(-(-count * n // BLOCK_COMPONENTS), min(BLOCKS, -(-count // LEAST_ROWS)), 1) for n, count in counts.items()}
    of = rows.sparkSession.createDataFrame(list(blocks.items()) or [(0, 1)], "n int, blocks int")
    sides = F.broadcast(of)  # a row for each length of a vector
    mine = rows.join(sides, "n").select("n", F.pmod(F.xxhash64("row"), "blocks").alias("block"), F.lit(False).alias("anchors"), "row", "vec_id", "label", "grid", F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>").alias("positives"))
    each = anchors.join(sides, "n").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.lit(True).alias("anchors"), "row", "vec_id", "label", "grid", "positives")
    both = mine.unionByName(each).repartition(max(1, sum(blocks.values())), "n", "block").sortWithinPartitions("n", "block", "anchors")
    return both.mapInArrow(_meeting(read), MET)


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``vectors``: vec_id, label, embedding.

    Anchors are the rows whose vec_id is divisible by ``every``. Limits are hundredths of the positive's score.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    usable = vectors.where("vec_id is not null and label is not null and embedding is not null")
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    numbered = cut(usable.mapInArrow(_on_grid(scale), GRID).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    counts = {r["n"]: r["count"] for r in numbered.groupBy("n").count().collect()}  # a row for each length of a vector
    anchors = numbered.where(F.col("vec_id") % every == 0)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    near = _met(numbered, anchors.withColumn("positives", F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>")), counts, _of_own_label(positives))
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("ranked"))
    near = near.select(F.col("anchor").alias("row"), F.transform("ranked", lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("positives"))
    marked = cut(anchors.join(near, "row"), "negatives-anchors")
    found = _met(numbered, marked, counts, _in_windows(negatives, low, high))
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
with rows as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, list_transform(embedding, lambda x: floor(256 * x::double)) q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.vec_id anchor_id, r.vec_id, a.lab = r.lab same, list_dot_product(a.q, r.q)::bigint score from rows a join rows r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
pos as (select anchor_id, vec_id positive_id, score positive_score from pairs where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
neg as (select anchor_id, positive_id, positive_score, vec_id negative_id, score negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from pos join pairs using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from neg where rank <= 10
"""
