"""Embedding near-duplicates by sorted projection passes.

Vectors that are equal are one class from the start. In each pass a class gets 64 random projection signs, written one
after the other as a key; rows are ranged by pass, label, key and node over the cluster and lie in that order in each
partition. Each row is compared in double precision with its next ``window`` neighbours; rows near a partition's ends are
compared over the border in a step of their own, over several where partitions hold few rows or none. Of the verified pairs of a window only a spanning forest goes
out, at most one edge a row. The union of all passes gives components.

Links are counted inside components only, where all links between different vectors must lie: members are dealt into
blocks of 512 and each pair of blocks is one matrix product, so no pair becomes a row. Copies count by class sizes.

Passes are as many as the largest label needs: where a label's vectors spread in direction, a pair at the cosine limit are
neighbours of a window in one pass with a chance that falls with the label's rows (measured with windows of 64: 0.43 at
5,000, 0.28 at 100,000, 0.20 at 500,000), and ``passes_for`` takes so many that none meets them with a chance under
``MISSED``; closer pairs are missed less often. Vectors crowded about one direction share sign bits, which lowers the
chance; nothing bounds it there. Members that any chain of found pairs joins are all counted exactly. ``tests/llm``
measures recall against brute force, and on a label of 100,000 vectors.

Defined results: rows whose label or vector is null, whose vector is empty or zero or holds null or non-finite
components link with nothing: 0 links, own component, kept. Vectors of different length don't link. Rows that repeat a
vec_id are vectors of their own, which link; the component is the smallest vec_id. Null vec_ids get a component from
their copies or partners, else null, and are not kept. Equal keys lie in the order of vec_ids, so ties don't depend on the
order of rows. An empty table gives no rows. Only vec_id (as a long), embedding and label are read. Vectors are shuffled
with the precision that they came in, once a pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_batches, sorted_groups
from .components import connected_components

LEAST = 0.93
WINDOW, SIGNS, BLOCK = 64, 64, 512
MISSED = 0.001


def passes_for(rows: int, window: int = WINDOW, least: float = LEAST) -> int:
    """Passes after which a pair at the limit in a label of ``rows`` vectors is still unmet with a chance under ``MISSED``.

    Neighbours of a window share about log2(rows / window) leading bits, each with the chance 1 - angle / pi; a twentieth is
    taken off, as the measured chances lie up to that much below.
    """
    bits = math.log2(max(rows, 2 * window) / window)
    met = 0.95 * (1 - math.acos(least) / math.pi) ** bits
    return max(12, math.ceil(math.log(MISSED) / math.log(1 - met)))


def _vectors(kind: np.dtype):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, label, vector -> id, label, class digest (null: links with nothing), components as bytes."""
        for b in batches:
            ids, labels = b.column(0), b.column(1)
            digests: list[bytes | None] = []
            raws: list[bytes | None] = []
            lists, names = b.column(2), labels.cast(pa.string()).to_pylist()
            for i in range(b.num_rows):
                digest = raw = None
                if names[i] is not None and lists[i].is_valid and len(v := lists[i].values) and not v.null_count:
                    x = v.to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # -0.0 becomes 0.0
                    if np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                        digest = hashlib.blake2b(raw + names[i].encode(), digest_size=16).digest()
                digests.append(digest)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "label", "class", "raw"])

    return describe


def units(raws: list[bytes], kind: np.dtype) -> np.ndarray:
    """Unit vectors in double precision of vectors of one length; what is shuffled are the components as they came."""
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _projector(seed: int, passes: int, kind: np.dtype):
    made: dict[int, np.ndarray] = {}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = b.column(2).to_pylist()
            for n in {len(u) // kind.itemsize for u in raws}:
                rows = [i for i, u in enumerate(raws) if len(u) // kind.itemsize == n]
                if n not in made:
                    made[n] = np.random.default_rng([seed, n]).standard_normal((n, passes * SIGNS))
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    x = units([raws[i] for i in part], kind)
                    keys = np.packbits((x @ made[n] > 0).reshape(len(part), passes, SIGNS), axis=2)
                    own = b.take(pa.array(part))
                    for p in range(passes):
                        cols = [pa.array(np.full(len(part), p, np.int32)), pa.array(np.full(len(part), n, np.int32)), own.column(1), pa.array([k.tobytes() for k in keys[:, p]], pa.binary()), own.column(0), own.column(2)]
                        yield pa.RecordBatch.from_arrays(cols, ["pass", "n", "label", "key", "node", "raw"])

    return project


def _forest(node: np.ndarray, x: np.ndarray, window: int, least: float, apart: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the verified pairs of neighbours connect. apart: only pairs across that border."""
    a, b = [], []
    for at in range(0, len(x), 256):
        end = min(len(x), at + 256 + window)
        s = x[at:end] @ x[at:end].T >= least
        i = np.arange(end - at)
        s &= np.abs(i[:, None] - i[None, :]) <= window
        if apart:
            s &= ((i + at) < apart)[:, None] != ((i + at) < apart)[None, :]
        s[i, i] = True
        if s.sum() == len(i):
            continue
        root = i
        while True:
            new = np.where(s, root[None, :], len(i)).min(1)
            new = new[new]
            if (new == root).all():
                break
            root = new
        keep = root != i
        a.append(node[at:end][keep])
        b.append(node[at:end][root[keep]])
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


#: Edges (a, b); vectors near a partition's ends: a, the partition, place in it, the pass, length and label that a vector is
#: compared in, and components; or a partition's number of rows as place.
PASS_OUT = "a long, b long, part long, place long, grp string, raw binary"


def _pass_rows(n: int, **columns) -> pa.RecordBatch:
    kinds = {"a": pa.int64(), "b": pa.int64(), "part": pa.int64(), "place": pa.int64(), "grp": pa.string(), "raw": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))


def _neighbours(window: int, least: float, kind: np.dtype):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []
        first, last, mark = None, None, None

        def ends(t: pa.Table, at: int) -> pa.RecordBatch:
            n = t.num_rows
            grp = [repr(x) for x in zip(*(t.column(c).to_pylist() for c in ("pass", "n", "label")), strict=True)]
            return _pass_rows(n, a=t.column("node").to_pylist(), part=np.full(n, part), place=np.arange(at, at + n), grp=grp, raw=t.column("raw").to_pylist())

        for batch in batches:
            if not batch.num_rows:
                continue
            group = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            cuts = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                t = pa.Table.from_batches([batch.slice(i, j - i)])
                if group[i] != mark:
                    held, mark = [], group[i]
                t = pa.concat_tables([*held, t]).combine_chunks()
                a, b = _forest(t.column("node").to_numpy(), units(t.column("raw").to_pylist(), kind), window, least)
                yield _pass_rows(len(a), a=a, b=b)
                held = [t.slice(max(0, t.num_rows - window))]
            got = pa.Table.from_batches([batch])
            rows += batch.num_rows
            if first is None or first.num_rows < window:
                first = (got if first is None else pa.concat_tables([first, got])).slice(0, window)
            last = got if last is None else pa.concat_tables([last, got])
            last = last.slice(max(0, last.num_rows - window))
        if last is not None:
            yield ends(first, 0)
            rest = min(last.num_rows, rows - first.num_rows)  # rows that stand in both go once
            yield ends(last.slice(last.num_rows - rest), rows - rest)
            yield _pass_rows(1, part=[part], place=[rows])

    return compare


def _spread(window: int, begins: dict[int, int], borders: np.ndarray):
    """Rows near partitions' ends, once for each border that lies within the window, with their place in the whole order. A
    window may reach over several partitions, where these hold few rows."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([begins[p] for p in b.column("part").to_pylist()], np.int64) + b.column("place").to_numpy()
            lo, hi = np.searchsorted(borders, at - window, "right"), np.searchsorted(borders, at + window, "right")
            row = np.repeat(np.arange(len(at)), hi - lo)
            border = borders[np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[row]]
            take = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(border, pa.int64()), pa.array(at[row], pa.int64()), take.column("a"), take.column("grp"), take.column("raw")], ["border", "place", "a", "grp", "raw"])

    return spread


def _borders(window: int, least: float, kind: np.dtype):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["border"]):
            border = t.column("border")[0].as_py()
            raws, place, node = t.column("raw").to_pylist(), t.column("place").to_numpy(), t.column("a").to_numpy()
            grp = np.array(t.column("grp").to_pylist(), object)
            for g in set(grp[place < border].tolist()) & set(grp[place >= border].tolist()):
                rows = np.flatnonzero(grp == g)
                a, b = _forest(node[rows], units([raws[i] for i in rows], kind), window, least, apart=int((place[rows] < border).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare


def _counts(least: float, kind: np.dtype):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, rows linked with it: for each pair of blocks of a component."""
        for t in sorted_groups(batches, ["component", "i", "j"]):
            node, size, side = (t.column(c).to_numpy() for c in ("node", "size", "side"))
            x = units(t.column("raw").to_pylist(), kind)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if side.max() == 2:
                s = x @ x.T >= least
                np.fill_diagonal(s, False)
                found = [(node, s @ size)]
            else:
                s = x[left] @ x[right].T >= least
                found = [(node[left], s @ size[right]), (node[right], s.T @ size[left])]
            for of, links in found:
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(links, pa.int64())], ["node", "links"])

    return count


def embedding_duplicates(vectors: DataFrame, least: float = LEAST, passes: int | None = None, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    small_batches(spark)
    label, floats = dict(vectors.dtypes)["label"], dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = np.dtype(np.float32 if floats else np.float64)
    embedding = F.col("embedding").cast("array<float>" if floats else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", embedding).mapInArrow(_vectors(kind), f"vec_id long, label {label}, class binary, raw binary")
    rows = cut(rows, "vectors")
    classes = cut(rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("node"), F.count("*").alias("size")), "vector-classes")
    reps = rows.join(classes.where("node is not null"), "class").where("vec_id = node")
    reps = cut(reps.groupBy("class").agg(F.first("label").alias("label"), F.first("node").alias("node"), F.first("raw").alias("raw"), F.first("size").alias("size")), "class-vectors")

    if passes is None:
        passes = passes_for(reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0, window, least)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = reps.select("node", "label", "raw").mapInArrow(_projector(seed, passes, kind), f"pass int, n int, label {label}, key binary, node long, raw binary")
    order = ["pass", "n", "label", "key", "node"]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = cut(ranged.mapInArrow(_neighbours(window, least, kind), PASS_OUT), "pass-edges")
    # a number for each partition: where its rows begin in the whole order
    begins, total = {}, 0
    for r in out.where("part is not null and grp is null").select("part", "place").orderBy("part").collect():
        begins[r["part"]] = total
        total += r["place"]
    borders = np.array(sorted({x for x in begins.values() if x}), np.int64)
    near = out.where("grp is not null").select("part", "place", "a", "grp", "raw").mapInArrow(_spread(window, begins, borders), "border long, place long, a long, grp string, raw binary")
    near = near.repartition("border").sortWithinPartitions("border", "place")
    edges = out.where("part is null").select("a", "b").union(near.mapInArrow(_borders(window, least, kind), "a long, b long"))
    comps = cut(connected_components(edges), "vector-components")
    drop_cut(out)

    members = reps.select("node", "raw", "size").join(comps, "node")
    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("g"))
    members = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")))
    tasks = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    tasks = tasks.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "node", "size", "raw")
    tasks = tasks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = tasks.mapInArrow(_counts(least, kind), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    of = classes.join(comps, "node", "left").join(links, "node", "left")
    of = of.select("class", F.coalesce("component", "node").alias("component"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    comp = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = rows.select("vec_id", "class").join(of, "class", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


#: All pairs of a label; for small tables only.
SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings),
ok as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
n as (select a, count(*) n from l group by a), r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a), c as (select a, least(a, min(b)) c from r group by a)
select vec_id, coalesce(n, 0) n_links, coalesce(c, vec_id) component_id, coalesce(c, vec_id) = vec_id kept from v left join n on n.a = vec_id left join c on c.a = vec_id
"""
