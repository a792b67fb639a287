"""MinHash near-duplicate groups with odd sketches.

128 MinHash samples of a document's 5-word shingles give 32 bands of 4 for candidates. The 1,024 least shingle hashes
(a bottom-k MinHash sample) are folded into a parity bitmap of 2,048 bits (an odd sketch): each sample flips the bit that
it hashes to, so two bitmaps differ in as many bits as the samples differ in members, less collisions. For sets of at most
1,024 shingles the sample is the set, and more differing bits than a similarity of 0.75 allows prove a smaller one; for
larger sets the limit is five standard deviations beyond the expected difference. The rest of the band candidates are
confirmed on the full shingle sets of their whole texts.

Equal shingle sets are one class from the start. A band bucket of n classes gives n - 1 candidates at first, each member
with the bucket's smallest one. After the components of their confirmed links, only pairs between different components
can still matter; buckets that hold several components compare those pairs in a second round: pair by pair in buckets of
at most 16 members, by blocks of 512 bitmaps in larger ones. So no group is expanded into all its pairs, and no pair that
shares a band is left untested unless it is in one component already.

Defined results: a null or empty text, or one of white space only, has an empty set, links with nothing and is its own
component. A text of fewer than five words has one shingle, its whole sequence. Rows that repeat a doc_id are one node
and each gets the node's row. Rows without doc_id get a null component unless an equal text has an id; kept is then
false. An empty table gives no rows. Only doc_id (as a long) and text are read, so further columns can't clash. Of sets
larger than the sample the limit loses a pair at the similarity limit with a chance under one in a million; the tests
measure it on sets of 2,000 to 20,000 shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, drop_cut, mix, shingle_sets, small_batches, sorted_groups, U, utf8
from .components import connected_components

SAMPLES, ROWS, LEAST, BITS = 128, 4, 1024, 2048
SMALL, BLOCK = 16, 512
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, SAMPLES, dtype=np.int64).astype(U) * U(2) + U(1)
_B = _rng.integers(0, 2**63, SAMPLES, dtype=np.int64).astype(U)

SIGNATURE = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary"


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """Samples of non-empty sets, one row each: the least of 128 hashes over the set's members."""
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    x = np.concatenate(sets)
    out = np.empty((len(sets), SAMPLES), U)
    for j in range(SAMPLES):
        v = x * _A[j] + _B[j]
        v ^= v >> U(32)
        out[:, j] = np.minimum.reduceat(v, first)
    return out


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of the least members of sorted sets, 256 bytes a row."""
    least = [s[:LEAST] for s in sets]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in least])
    at = (mix(np.concatenate(least)) >> U(64 - 11)).astype(np.int64)
    bits = np.bincount(row * BITS + at, minlength=len(sets) * BITS) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1, BITS), axis=1)


def most_bits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Differing bits that bitmaps of sets of n and m members with a similarity of 0.75 can have."""
    both = n + m
    large = np.maximum(n, m)
    share = np.minimum(1.0, 0.75 / 1.75 * both / large)
    common = LEAST * share - 5 * np.sqrt(LEAST * share * (1 - share))
    sampled = np.minimum(n, LEAST) + np.minimum(m, LEAST) - 2 * common
    return np.where(large <= LEAST, both / 7, sampled)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    n = SAMPLES // ROWS
    k = np.tile(np.arange(1, n + 1).astype(U) * U(0xD6E8FEB86659FD93), (len(samples), 1))
    for j in range(ROWS):
        k = mix(k * U(0x2545F4914F6CDD1D) + samples[:, j::ROWS][:, :n])
    return k.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        sets = shingle_sets(*utf8(b.column(1)))
        full = [i for i, s in enumerate(sets) if len(s)]
        hashes: list[bytes | None] = [None] * len(sets)
        bands: list = [[]] * len(sets)
        sketches: list[bytes | None] = [None] * len(sets)
        if full:
            m = minhashes([sets[i] for i in full])
            keys, odd = band_keys(m), odd_sketches([sets[i] for i in full])
            for r, i in enumerate(full):
                hashes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                bands[i], sketches[i] = keys[r], odd[r].tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set_hash", "bands", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signatures, SIGNATURE)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8).view(U)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of the pairs whose bitmaps differ in few bits."""
    for b in batches:
        if b.num_rows:
            differ = np.bitwise_count(_matrix(b.column(2)) ^ _matrix(b.column(3))).sum(1, dtype=np.int64)
            yield b.select([0, 1]).filter(pa.array(differ <= most_bits(b.column(4).to_numpy(), b.column(5).to_numpy())))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of the pairs whose full shingle sets have 100 * intersection >= 75 * union."""

    def sets(b: pa.RecordBatch, key: str, text: str) -> list[np.ndarray]:
        ids = b.column(key).to_numpy()
        _, at, of = np.unique(ids, return_index=True, return_inverse=True)
        texts = b.column(text).take(pa.array(at))
        # rows that repeat an id may differ in text: then take each row's own
        own = shingle_sets(*utf8(texts))
        same = texts.take(pa.array(of))
        return [own[k] if s == t else shingle_sets(*utf8(pa.array([t])))[0] for k, s, t in zip(of, same.to_pylist(), b.column(text).to_pylist(), strict=True)]

    for batch in batches:
        for b in blocks(iter([batch]), "ta"):
            linked = []
            for x, y in zip(sets(b, "a", "ta"), sets(b, "b", "tb"), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= 75 * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(linked, pa.bool_()))


def _confirmed(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb")
    near = cut(near.mapInArrow(_near, "a long, b long"), "near-pairs")
    ids = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    # the same shuffle at every size: a broadcast of the ids would only help small tables
    some = texts.join(ids.hint("merge"), F.col("doc_id") == F.col("node"), "left_semi").distinct()
    some = cut(some, "near-texts")
    side = lambda c, s: some.select(F.col("doc_id").alias(c), F.col("text").alias(s))
    out = near.join(side("b", "tb"), "b").join(side("a", "ta"), "a").select("a", "b", "ta", "tb")
    out = cut(out.mapInArrow(_confirm, "a long, b long"), "links")
    drop_cut(near)
    drop_cut(some)
    return out


def _blocks_of_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components with near bitmaps, for each pair of blocks of a large bucket."""
    for t in sorted_groups(batches, ["key", "i", "j", "within"]):
        node, comp, left, n = (t.column(c).to_numpy() for c in ("node", "comp", "left", "n_shingles"))
        m, within = _matrix(t.column("sketch")), t.column("within")[0].as_py()
        ls = np.flatnonzero(left)
        rs = ls if within else np.flatnonzero(~left)
        for x in ls:
            at = rs[(np.bitwise_count(m[rs] ^ m[x]).sum(1, dtype=np.int64) <= most_bits(n[rs], n[x])) & (comp[rs] != comp[x])]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[at])), pa.array(np.maximum(node[x], node[at]))], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    sig = cut(signatures(docs), "signatures")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = cut(sig.where("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("node")), "classes")
    reps = sig.join(classes.where("node is not null"), "set_hash").where("doc_id = node")
    # one row a class, however often its first row is repeated
    reps = reps.groupBy("set_hash").agg(F.first("node").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    reps = cut(reps.drop("set_hash"), "class-signatures")
    sketches = reps.select("node", "sketch", "n_shingles")
    banded = reps.select("node", F.explode("bands").alias("key"))
    buckets = cut(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"), "buckets")
    members = cut(banded.join(buckets, "key"), "members")
    links = _confirmed(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), sketches, texts)
    comps = cut(connected_components(links), "components")

    # Second round: pairs of different components in buckets that hold several of them.
    held = members.where("n > 2").join(comps, "node", "left").select("key", "node", "pivot", "n", F.coalesce("component", "node").alias("comp"))
    seen = held = cut(held, "bucket-components")
    # small tables are written, so that the joins with them can be split at a bucket of many members
    open_ = cut(held.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("key"), "open-buckets")
    opened = held = cut(held.join(open_, "key"), "open-members")
    few = held.where(f"n <= {SMALL}")
    a, b = (few.select("key", "pivot", F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab")
    pairs = a.join(b.drop("pivot"), "key").where("a < b and comp_a <> comp_b and a <> pivot").select("a", "b")
    many = held.where(f"n > {SMALL}")
    sizes = many.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("n"))
    sizes = cut(sizes, "bucket-sizes")
    many = many.drop("n").join(sizes, "key").withColumn("gm", F.ceil(F.col("m") / BLOCK)).withColumn("go", F.ceil((F.col("n") - F.col("m")) / BLOCK))
    blk = lambda g: F.pmod(F.xxhash64("node"), F.col(g))
    upto = lambda g: F.explode(F.sequence(F.lit(0).cast("long"), F.col(g) - 1))
    main = many.where("comp = main").withColumn("i", blk("gm")).withColumn("j", upto("go"))
    rest = many.where("comp <> main").withColumn("own", blk("go"))
    cols = ["key", "i", "j", "within", "left", "node", "comp"]
    tasks = main.withColumns({"within": F.lit(False), "left": F.lit(True)}).select(cols)
    tasks = tasks.union(rest.withColumn("j", F.col("own")).withColumn("i", upto("gm")).withColumns({"within": F.lit(False), "left": F.lit(False)}).select(cols))
    inner = rest.withColumn("other", upto("go")).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    inner = inner.withColumns({"within": F.col("own") == F.col("other"), "left": F.col("own") <= F.col("other")})
    tasks = tasks.union(inner.withColumn("i", F.col("i") + F.col("gm")).withColumn("j", F.col("j")).select(cols))
    tasks = tasks.join(sketches, "node").select(*cols, "sketch", "n_shingles").repartition("key", "i", "j", "within").sortWithinPartitions("key", "i", "j", "within")
    pairs = pairs.union(tasks.mapInArrow(_blocks_of_bucket, "a long, b long"))
    more = _confirmed(pairs, sketches, texts)
    comps = cut(connected_components(links.union(more)), "components")
    for x in (reps, buckets, members, seen, open_, opened, sizes, links, more):
        drop_cut(x)

    of = classes.join(comps, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    out = sig.select("doc_id", "n_shingles", "set_hash").join(of, "set_hash", "left")
    comp = F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))


#: All pairs of documents that share a shingle; for small tables only.
SQL = """
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], chr(10)) s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i from d where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, least(a, min(b)) c from r group by a)
select d.doc_id, coalesce(n, 0) n_shingles, coalesce(c, d.doc_id) component_id, coalesce(c, d.doc_id) = d.doc_id kept from d left join n using (doc_id) left join c on c.a = d.doc_id
"""
