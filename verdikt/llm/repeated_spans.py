"""Removal of long repeated byte strings by a run-length index.

Every byte that a string of 400 bytes covers which also starts elsewhere in the table goes. The work is split so that
each index stays small, and no pair of equal strings is lost:

1. Anchors. The string that starts at s has as anchor the least hash among the 16-byte words that start in its first
   320 bytes; equal strings have it at the same place. Runs of starts with one anchor p form a segment: up to 319 bytes
   left of p, the 81 bytes from p that all of its strings hold (their digest is the segment's key) and up to 319 bytes
   after those. One segment stands for about 160 starts.
2. Counting. Keys and contexts (digests of whole segments) are counted with partial sums. A key that occurs once can't
   repeat; a context that occurs twice repeats at every start; only keys with several contexts need an index, and one
   copy of each context goes there.
3. Keys with more contexts than ``HOT`` are split: the range of starts is halved, which lets the common part, and so the
   key, grow by the bytes that all strings of a half hold. At a range of one start all contexts of a key are equal, so
   this ends after nine rounds; a key of the commonest passage is dealt over many groups, with one row a context and half.
4. Index. Of a key's contexts those are left out that share no bytes beyond the common part with another, as ``sharing``
   says. The others of a few keys, each with its common part as one symbol, are one text. Its Burrows-Wheeler transform is
   kept as runs, with the suffix and the common prefix length sampled at each run's two ends only. Matching statistics of the text against itself are streamed from these samples: one symbol further on, a match with the
   neighbouring suffix is one symbol shorter, until the next sample. Starts whose statistic reaches the string's length
   are repeated.
5. The marked starts are joined back to all places of their contexts, merged by text, and cut from the bytes.

Digests have 96 bits. Equal texts share one digest; a task segments at most two of them, as counts matter as one or more,
and spans are found once for each text. Joins of texts by digest can be split at a text with many copies.

Defined results: a null text is empty; texts under 400 bytes lose nothing; rows that repeat a doc_id are documents of
their own, so a text that stands twice goes from both; null doc_ids are kept; an empty table gives no rows; only doc_id
(as a long) and text are read. Matches never cross documents. What is kept is bytes, as a removal may cut a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, cut, drop_cut, mix, small_batches, sorted_groups, U, utf8

LENGTH, WINDOW, WORD = 400, 320, 16
COMMON = LENGTH - WINDOW + 1
HOT = 512
INDEX_SYMBOLS = 400_000
_PLACE = U((1 << 24) - 1)

ANCHORS = "td binary, p int, lo int, hi int, key binary, ctx binary"


def _digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=12)
    for p in parts:
        h.update(p)
    return h.digest()


def text_digest():
    """The first 12 bytes of a text's MD5, as in ``_anchors``."""
    return F.unhex(F.substring(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1, 24))


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each segment of one text."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    x = data.astype(U)
    x = x[:-1] | x[1:] << U(8)
    x = x[:-2] | x[2:] << U(16)
    x = x[:-4] | x[4:] << U(32)
    h = mix(mix(x[:-8] + U(0x9E3779B97F4A7C15)) * U(3) + x[8:])
    h = (h & ~_PLACE) | np.arange(len(h), dtype=U)
    for k in range(8):
        h = np.minimum(h[: -(1 << k)], h[1 << k :])
    h = np.minimum(h[:n], h[WINDOW - 256 :][:n]) & _PLACE
    at = np.flatnonzero(h[1:] != h[:-1]) + 1
    lo = np.concatenate([[0], at])
    return h[lo].astype(np.int64), lo, np.concatenate([at, [n]]) - 1


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    copies: dict[bytes, int] = {}
    for b in blocks(batches):
        data, offsets = utf8(b.column(0))
        rows: list[tuple] = []
        for i in range(b.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            if len(text) < LENGTH:
                continue
            raw = text.tobytes()
            td = hashlib.md5(raw).digest()[:12]
            # counts matter as one or more: a task's third copy of a text and those after it add nothing
            copies[td] = copies.get(td, 0) + 1
            if copies[td] > 2:
                continue
            for base in range(0, len(raw) - LENGTH + 1, BLOCK_BYTES):
                for p, lo, hi in zip(*(x.tolist() for x in segments(text[base : base + BLOCK_BYTES + LENGTH - 1])), strict=True):
                    p, lo, hi = p + base, lo + base, hi + base
                    rows.append((td, p, lo, hi, _digest(raw[p : p + COMMON]), _digest(b"%d,%d:" % (p - lo, hi - lo), raw[lo : hi + LENGTH])))
                    if len(rows) >= 50_000:
                        yield _rows(rows)
                        rows = []
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["td", "p", "lo", "hi", "key", "ctx"])


#: One row for each context and range of starts: a counts bytes left of the anchor, from r0 to r1 for the key, from a0 to
#: a1 for this context; key0 and ctx0 are those of the segment.
CONTEXT = "key0 binary, ctx0 binary, key binary, ctx binary, r0 int, r1 int, a0 int, a1 int, left binary, right binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, places -> a row for each place: its segment without the common part."""
    for b in blocks(batches):
        data, offsets = utf8(b.column(0))
        rows = []
        for i, places in enumerate(b.column(1).to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            for x in places:
                p, lo, hi = x["p"], x["lo"], x["hi"]
                rows.append((x["key"], x["ctx"], x["key"], x["ctx"], 0, WINDOW - 1, p - hi, p - lo, raw[lo:p], raw[p + COMMON : hi + LENGTH]))
        yield _context_rows(rows)


def _context_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    kinds = [pa.int32() if x.endswith("int") else pa.binary() for x in CONTEXT.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context in the halves of its key's range that it has starts in, under longer keys."""
    for b in batches:
        rows = []
        for x in b.to_pylist():
            mid = (x["r0"] + x["r1"]) // 2
            for r0, r1 in ((x["r0"], mid), (mid + 1, x["r1"])):
                a0, a1 = max(x["a0"], r0), min(x["a1"], r1)
                if a0 > a1:
                    continue
                # left holds the bytes from a1 down to the old r0, right those after the old common part
                grown, more = r0 - x["r0"], x["r1"] - r1
                left = x["left"][len(x["left"]) - (a1 - x["r0"]) :]
                common = left[len(left) - grown :] if grown else b""
                left = left[: len(left) - grown]
                right = x["right"][more : more + r1 - a0]
                key = _digest(b"%d-%d:" % (r0, r1), x["key"], common, b"|", x["right"][:more])
                rows.append((x["key0"], x["ctx0"], key, _digest(b"%d,%d:" % (a0, a1), left, b"|%d|" % len(left), right), r0, r1, a0, a1, left, right))
        yield _context_rows(rows)


class RunLengthIndex:
    """A Burrows-Wheeler transform as runs, with suffixes and common prefix lengths sampled at the runs' ends.

    ``text`` holds symbols under 65,536, and each of its strings ends in a symbol of its own, so all suffixes differ. Of
    the transform only the runs' borders are kept: streaming reads nothing but the samples there.
    """

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        self.n = n
        padded = np.concatenate([text.astype(U), np.zeros(4, U)])
        key = padded[:n] << U(48) | padded[1 : n + 1] << U(32) | padded[2 : n + 2] << U(16) | padded[3 : n + 3]
        order, rank = np.argsort(key), np.empty(n, np.int64)
        place, key, step, levels = np.arange(n), key[order], 4, []  # levels: ranks of the prefixes of 4, 8, 16 ... symbols
        # a group of suffixes that agree so far has its first place as rank; only groups of several are sorted on
        while True:
            first = np.flatnonzero(np.concatenate([[True] * min(n, 1), key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            rank[order[place]] = np.repeat(place[first], size)
            levels.append(rank.astype(np.int32))
            place = place[np.repeat(size > 1, size)]
            if not len(place):
                break
            suffix = order[place]
            after = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
            key = rank[suffix] * (n + 1) + after
            by = np.argsort(key)
            order[place], key = suffix[by], key[by]
            step *= 2
        before = text[order - 1] if n else text
        breaks = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.heads, self.tails = np.concatenate([[0], breaks]).astype(np.int64), np.concatenate([breaks, [n]]).astype(np.int64) - 1
        self.head_suffix, self.tail_suffix = order[self.heads], order[self.tails]
        self.head_prefix = self._common(text, levels, self.head_suffix, order[self.heads - 1], self.heads > 0)
        self.tail_prefix = self._common(text, levels, self.tail_suffix, order[np.minimum(self.tails + 1, n - 1)], self.tails < n - 1)

    @staticmethod
    def _common(text: np.ndarray, levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes x and y, by the ranks of ever shorter prefixes."""
        n, x, y = len(text), x.copy(), y.copy()
        out = np.zeros(len(x), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (x < n) & (y < n)
            same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
            for a in (out, x, y):
                a += same * (4 << k)
        for _ in range(3):
            same = (x < n) & (y < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
            for a in (out, x, y):
                a += same
        return out * valid

    def matching_statistics(self) -> np.ndarray:
        """For each place of the text the longest match with any other place, streamed from the samples in text order."""
        best = np.zeros(self.n, np.int64)
        for suffix, prefix in ((self.head_suffix, self.head_prefix), (self.tail_suffix, self.tail_prefix)):
            value = np.zeros(self.n, np.int64)
            sampled = np.zeros(self.n, np.int64)
            value[suffix] = prefix
            sampled[suffix] = suffix
            at = np.maximum.accumulate(sampled)
            np.maximum(best, value[at] - (np.arange(self.n) - at), out=best)
        return best


MARKS = "key binary, ctx binary, r0 int, starts array<struct<a0:int,a1:int>>"


def sharing(rows: list[tuple]) -> list[tuple]:
    """Of the contexts of one key those that can repeat: the range of starts is parted in eight, and all strings that start in
    a part hold the same bytes about the anchor, so a context stays, with the starts of the parts in question, where another
    one has these bytes too. Rows are (key, ctx, r0, r1, a0, a1, left, right)."""
    r0, r1 = rows[0][2], rows[0][3]
    width = max(1, (r1 - r0 + 8) // 8)
    seen: dict[tuple, list[int]] = {}
    for i, (_, _, _, _, a0, a1, left, right) in enumerate(rows):
        for q0 in range(r0 + (a0 - r0) // width * width, a1 + 1, width):
            q1 = min(q0 + width - 1, r1)
            seen.setdefault((q0, left[len(left) - (q0 - r0) :], right[: r1 - q1]), []).append(i)
    hull: dict[int, list[int]] = {}
    for (q0, _, _), own in seen.items():
        if len(own) > 1:
            for i in own:
                h = hull.setdefault(i, [q0, q0])
                h[0], h[1] = min(h[0], q0), max(h[1], q0)
    out = []
    for i, (low, high) in sorted(hull.items()):
        key, ctx, _, _, a0, a1, left, right = rows[i]
        a0, a1 = max(a0, low), min(a1, high + width - 1)
        out.append((key, ctx, r0, r1, a0, a1, left[len(left) - (a1 - r0) :], right[: r1 - a0]))
    return out


def _index_text(groups: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the groups' contexts, each with its common part as one symbol, and where each context begins."""
    rows = [r for g in groups for r in g]
    text = np.frombuffer(b"".join(x for r in rows for x in (r[6], b"\0", r[7], b"\0")), np.uint8).astype(np.uint16) + np.uint16(1)
    sizes = np.array([(len(r[6]), len(r[7])) for r in rows], np.int64) + 1
    begins = np.concatenate([[0], np.cumsum(sizes.sum(1))])
    text[begins[:-1] + sizes[:, 0] - 1] = 257 + np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    text[begins[1:] - 1] = 257 + len(groups) + np.arange(len(rows))
    return text, begins[:-1]


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts, as ranges of a, of contexts that come sorted by key; several keys share an index."""

    def flush(groups: list[list[tuple]]) -> pa.RecordBatch:
        text, begins = _index_text(groups)
        found = RunLengthIndex(text).matching_statistics()
        out = []
        for (key, ctx, r0, r1, a0, a1, _, _), at in zip((r for g in groups for r in g), begins.tolist(), strict=True):
            hit = np.zeros(a1 - a0 + 3, bool)
            np.greater_equal(found[at : at + a1 - a0 + 1], r1 - r0 + 1, out=hit[1:-1])
            edge = np.flatnonzero(hit[1:] != hit[:-1]).tolist()
            if edge:
                out.append((key, ctx, r0, [{"a0": a1 - j + 1, "a1": a1 - i} for i, j in zip(edge[::2], edge[1::2], strict=True)]))
        cols = zip(*out, strict=True) if out else [[]] * 4
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.struct([("a0", pa.int32()), ("a1", pa.int32())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "ctx", "r0", "starts"])

    groups, symbols, rows = [], 0, 0
    for t in sorted_groups(batches, ["key"]):
        own = sharing(list(zip(*(t.column(c).to_pylist() for c in ("key", "ctx", "r0", "r1", "a0", "a1", "left", "right")), strict=True)))
        if not own:
            continue
        groups.append(own)
        symbols += sum(len(r[6]) + len(r[7]) + 2 for r in own)
        rows += len(own)
        if symbols >= INDEX_SYMBOLS or rows + len(groups) >= 50_000:
            yield flush(groups)
            groups, symbols, rows = [], 0, 0
    if groups:
        yield flush(groups)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans -> doc_id, n_bytes, merged spans, kept bytes."""
    for b in blocks(batches):
        data, offsets = utf8(b.column(1))
        merged, kept = [], []
        for i, spans in enumerate(b.column(2).to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            own: list[list[int]] = []
            for s in sorted((x["from"], x["to"]) for x in spans or ()):
                if own and s[0] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], s[1])
                else:
                    own.append(list(s))
            merged.append([{"from": a, "to": z} for a, z in own])
            kept.append(b"".join(raw[a:z] for a, z in zip([0] + [z for _, z in own], [a for a, _ in own] + [len(raw)], strict=True)))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(merged, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs, from and to in bytes) and kept (the other bytes) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    anchors = cut(docs.select(text).mapInArrow(_anchors, ANCHORS), "anchors")
    place = F.struct("td", "p", "lo", "hi")
    contexts = anchors.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    keys = contexts.groupBy("key").agg(F.count("*").alias("contexts"), F.sum("n").alias("n")).where("n > 1")
    contexts = cut(contexts.join(keys.drop("n"), "key"), "contexts")
    whole = contexts.where("n > 1").select("key", "ctx", F.lit(0).alias("r0"), F.lit(None).cast("array<struct<a0:int,a1:int>>").alias("starts"))

    wanted = contexts.where("contexts > 1").select("at.td", F.struct("at.p", "at.lo", "at.hi", "key", "ctx").alias("place")).groupBy("td").agg(F.collect_list("place").alias("places"))
    wanted = cut(wanted, "wanted")  # so that the join below can be split at a text with many copies
    sources = docs.select(text_digest().alias("td"), text).join(wanted, "td").select("text", "places")
    level = cut(sources.mapInArrow(_contexts, CONTEXT).dropDuplicates(["key", "ctx"]), "segments")
    sizes = level.groupBy("key").agg(F.count("*").alias("m"))
    ready, spare = None, [level]
    while True:
        sizes = cut(sizes, "sizes")
        hot = sizes.where(F.col("m") > HOT).select("key")
        cold = level.join(sizes.where(f"m <= {HOT}").select("key"), "key")
        ready = cold if ready is None else ready.unionByName(cold)
        if hot.isEmpty():
            break
        level = cut(level.join(hot, "key").mapInArrow(_halved, CONTEXT), "segments")
        spare.append(level)
        # m: different contexts of a key; contexts that coincide in this range are one string
        sizes = level.groupBy("key", "ctx").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("n")).where("n > 1").drop("n")
    shape = ["key", "ctx", "r0", "r1", "a0", "a1", "left", "right"]
    once = ready.groupBy("key", "ctx").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in shape[2:]))
    once = cut(once, "index-input")
    index = once.select(*shape).repartition("key").sortWithinPartitions("key").mapInArrow(_indexed, MARKS)
    equal = once.where("n > 1").select("key", "ctx", "r0", F.array(F.struct("a0", "a1")).alias("starts"))
    held = cut(index.unionByName(equal), "marks")
    found = ready.select("key0", "ctx0", "key", "ctx").join(held, ["key", "ctx"]).select(F.col("key0").alias("key"), F.col("ctx0").alias("ctx"), "r0", "starts")
    starts = F.explode_outer("starts")
    marks = cut(whole.unionByName(found).select("key", "ctx", starts.alias("s")), "starts")

    # a bytes left of the anchor p: the string starts at p - a; a null range stands for all starts of the segment.
    spans = anchors.join(marks, ["key", "ctx"]).select("td", F.struct(F.coalesce(F.col("p") - F.col("s.a1"), "lo").alias("from"), (F.coalesce(F.col("p") - F.col("s.a0"), "hi") + LENGTH).alias("to")).alias("span"))
    spans = cut(spans.groupBy("td").agg(F.collect_set("span").alias("spans")), "spans")
    for x in (*spare, once, held, anchors, contexts, wanted, marks):
        drop_cut(x)
    joined = docs.select("doc_id", text, text_digest().alias("td")).join(spans, "td", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_out, "doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary")


def digest(out: DataFrame) -> DataFrame:
    """The contract's columns of ``remove_repeated``'s result."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: A digest of every string of 400 bytes; for small tables only.
SQL = """
with d as (select row_number() over () rid, doc_id, hex(coalesce(text, '')) h from documents),
w as (select rid, i, hash(substr(h, 2 * i + 1, 800)) k from (select rid, h, unnest(range(0, greatest(length(h) // 2 - 399, 0))) i from d)),
st as (select rid, i from w semi join (select k from w group by k having count(*) > 1) using (k)),
g as (select rid, i, sum(n) over (partition by rid order by i) g from (select rid, i, case when i <= lag(i) over (partition by rid order by i) + 400 then 0 else 1 end n from st)),
sp as (select rid, a, z, coalesce(lag(z) over (partition by rid order by a), 0) pz from (select rid, g, min(i) a, max(i) + 400 z from g group by rid, g)),
k as (select rid, count(*) n_spans, sum(z - a)::bigint n_removed, max(z) mz, string_agg(substr(h, 2 * pz + 1, 2 * (a - pz)), '' order by a) kept from sp join d using (rid) group by rid)
select doc_id, length(h) // 2 n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(from_hex(coalesce(kept || substr(h, 2 * mz + 1), h))) kept_sha256 from d left join k using (rid)
"""
