"""Language of whole texts, with spans of mixed-language text.

A word is a maximal run of letters and marks. Its script (by code point ranges) narrows the candidates to the languages
that were seen in that script. A candidate's score for the word is the sum of smoothed log shares of the word's letter
trigrams, with word borders, in that language. Viterbi over the words of a text, where a change of language costs
``SWITCH`` nats, labels spans. The text's language is the one with most letters in its spans, the first by name at a tie;
its share of the letters is the score.

Viterbi runs over segments of 256 words of many texts at once: first every segment's best score from each language it
may be entered in, then the best chain of segments of each text, then the path inside each segment. The result is that of
a run over the whole text.

The model is learned from a sample of labelled texts, about ``FIT_DOCUMENTS`` different ones for each of the
``LANGUAGES`` commonest languages, taken by a hash of the text, so that it doesn't depend on order; copies of a text count
once. Its size is bounded by 65,536 trigram bins a language.

Defined results: ``und`` with score 0 for a null text, a text without letters, or when no language was learned; rows that
repeat a doc_id each get their row; null doc_ids are kept; an empty table gives no rows; a null lang teaches nothing; only
doc_id (as a long), text and (for learning) lang are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, small_batches, U

BINS, SEGMENT, BLOCK = 1 << 16, 256, 1 << 20
SWITCH = 6.0
FIT_DOCUMENTS, LANGUAGES = 4000, 256
UNKNOWN = "und"
#: First and last code points of scripts; letters elsewhere are script 0.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x531, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FFFF),
)
_kinds: list[np.ndarray] = []


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 0 none, 1 mark, 2 letter; and its script's number."""
    if not _kinds:
        table = {"M": 1, "L": 2}
        _kinds.append(np.array([table.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8))
        script, names = np.zeros(0x110000, np.uint8), list(dict.fromkeys(s[0] for s in SCRIPTS))
        for name, a, z in SCRIPTS:
            script[a : z + 1] = names.index(name) + 1
        _kinds.append(script)
    return _kinds[0], _kinds[1]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bins of all letters, the first of each word, each word's text and script, and letters of each word."""
    kind, script = kinds()
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    letter = kind[code] > 0
    at = np.flatnonzero(letter)
    c = np.where(letter, code, 0).astype(U)
    padded = np.concatenate([[0], c, [0]]).astype(U)
    here = padded[at] | padded[at + 1] << U(21) | padded[at + 2] << U(42)
    bins = (mix(here) >> U(48)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1])) if len(at) else at
    real = np.add.reduceat(kind[code[at]] == 2, begins, dtype=np.int64) if len(at) else begins
    rows = np.searchsorted(first, at[begins], "right") - 1 if len(at) else begins
    return bins, begins, rows, script[code[at[begins]]] if len(at) else begins, real


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, lang -> lang, bin (negative: a script), n: counts of a partition."""
    held: dict[str, np.ndarray] = {}
    for b in blocks(batches, size=BLOCK):
        langs = b.column(1).to_pylist()
        bins, begins, rows, scripts, real = words(b.column(0).to_pylist())
        ends = np.concatenate([begins[1:], [len(bins)]]).astype(np.int64)
        row_of = np.repeat(rows, ends - begins) if len(begins) else rows
        for lang in set(langs):
            own = np.array([x == lang for x in langs])
            n = held.setdefault(lang, np.zeros(BINS + 256, np.int64))
            if len(begins):
                n[:BINS] += np.bincount(bins[own[row_of]], minlength=BINS)
                n[BINS:] += np.bincount(scripts[own[rows]], weights=real[own[rows]], minlength=256).astype(np.int64)
    for lang, n in held.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at < BINS, at, BINS - 1 - at), pa.int32()), pa.array(n[at])], ["lang", "bin", "n"])


class Model:
    def __init__(self, languages: list[str], scores: np.ndarray, scripts: np.ndarray) -> None:
        self.languages, self.scores, self.scripts = languages, scores, scripts


def fit(labelled: DataFrame, most: int = FIT_DOCUMENTS) -> Model:
    """Learn from (text, lang) rows: about ``most`` different texts of each language, all of those with fewer."""
    spark = labelled.sparkSession
    small_batches(spark)
    labelled = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros((256, 0), bool))
    share = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, most / r["n"]) if r["n"] > most else 1.0) for r in counts], "lang string, share double"))
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    some = labelled.join(share, "lang").where(part < F.col("share"))
    # copies are combined before the shuffle, and each text teaches once
    some = some.groupBy("lang", F.md5(F.col("text").cast("binary")).alias("td")).agg(F.first("text").alias("text")).select("text", "lang")
    rows = some.mapInArrow(_grams, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(rows["lang"]))
    n, seen = np.zeros((BINS, len(languages))), np.zeros((256, len(languages)))
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        at, value = own["bin"].to_numpy(), own["n"].to_numpy()
        n[at[at >= 0], k] = value[at >= 0]
        seen[-at[at < 0] - 1, k] = value[at < 0]
    smooth = 0.1
    scores = np.log((n + smooth) / (n.sum(0) + smooth * BINS))
    return Model(languages, scores.astype(np.float32), seen >= 0.01 * np.maximum(seen.sum(0), 1))


def word_scores(model: Model, bins: np.ndarray, begins: np.ndarray, scripts: np.ndarray) -> np.ndarray:
    s = np.add.reduceat(model.scores[bins], begins, axis=0).astype(np.float64)
    allowed = model.scripts[scripts]
    some = allowed.any(1)
    return np.where(some[:, None] & ~allowed, -1e6, np.where(some[:, None], s, 0.0))


def viterbi(scores: np.ndarray, rows: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; ``rows`` are the words' texts, in order. At ties the first language wins."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    border = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sizes = np.diff(np.concatenate([border, [n]]))
    parts = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(border)), parts)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = border[text] + inner * SEGMENT
    length = np.minimum(SEGMENT, sizes[text] - inner * SEGMENT)
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(SEGMENT), "left")  # segments with more than t words
    # best score of each segment from each entry language to each last one
    d = np.full((len(text), k, k), -switch)
    d[:, np.arange(k), np.arange(k)] = 0.0
    through = np.empty_like(d)
    for t in range(int(length.max())):
        a = order[: active[t]]
        x = d[a]
        d[a] = np.maximum(x, x.max(2, keepdims=True) - switch) + scores[start[a] + t][:, None, :] if t else x + scores[start[a]][:, None, :]
    through = d
    # chain the segments of each text; long texts have many
    entry = np.zeros((len(text), k))
    came = np.zeros((len(text), k), np.int64)
    last = np.zeros(len(text), np.int64)
    heads = np.cumsum(parts) - parts
    for h, m in zip(heads.tolist(), parts.tolist(), strict=True):
        if m == 1:
            continue
        for s in range(h, h + m - 1):
            every = entry[s][:, None] + through[s]
            entry[s + 1] = every.max(0)
    # the path inside each segment
    back = np.zeros((n, k), np.int8 if k < 128 else np.int16)
    d = entry.copy()
    own = np.arange(k)
    for t in range(int(length.max())):
        a = order[: active[t]]
        x = d[a]
        if t or (inner[a] > 0).any():
            top, arg = x.max(1), x.argmax(1)
            stay = x >= top[:, None] - switch
            came_from = np.where(stay, own[None, :], arg[:, None])
            best = np.where(stay, x, top[:, None] - switch)
            back[start[a] + t] = came_from
            d[a] = best + scores[start[a] + t]
        else:
            back[start[a]] = own
            d[a] = x + scores[start[a]]
    out = np.empty(n, np.int64)
    # last languages: from each text's end backwards over its segments, all texts' last segments first
    tails = heads + parts - 1
    last[tails] = d[tails].argmax(1)
    for step in range(int(parts.max())):
        now = tails[parts > step] - step
        state = last[now]
        for t in range(int(length[now].max()) - 1, -1, -1):
            on = length[now] > t
            at = start[now[on]] + t
            out[at] = state[on]
            state[on] = back[at, state[on]]
        before = inner[now] > 0
        last[now[before] - 1] = state[before]
    return out


def _labels(model: Model, switch: float):
    names = model.languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, size=BLOCK):
            bins, begins, rows, scripts, real = words(b.column(1).to_pylist())
            pred, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            spans: list[list] = [[] for _ in pred]
            if names and len(begins):
                path = viterbi(word_scores(model, bins, begins, scripts), rows, switch)
                letters = np.zeros((b.num_rows, len(names)), np.int64)
                np.add.at(letters, (rows, path), real)
                total, best = letters.sum(1), letters.argmax(1)
                for i in np.flatnonzero(total):
                    pred[i], score[i] = names[best[i]], letters[i, best[i]] / total[i]
                cuts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (path[1:] != path[:-1])]))
                word = np.arange(len(rows)) - np.searchsorted(rows, rows)
                for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True):
                    if total[rows[a]]:
                        spans[rows[a]].append({"lang": names[path[a]], "word": int(word[a]), "words": z - a})
            kind = pa.list_(pa.struct([("lang", pa.string()), ("word", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return predict


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (lang, first word, words) for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    shape = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,word:long,words:long>>"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_labels(model, switch), shape)


def in_language(docs: DataFrame, model: Model, least: float, switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs``, with all columns, that have a language and at least that score; no row is looked up by an id."""
    small_batches(docs.sparkSession)
    predicted, at = _labels(model, switch), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, size=BLOCK):
            ids = pa.nulls(b.num_rows, pa.int64())
            out = pa.Table.from_batches(list(predicted(iter([pa.RecordBatch.from_arrays([ids, b.column(at)], ["doc_id", "text"])]))))
            score, und = out.column("score").to_numpy(), np.array([x == UNKNOWN for x in out.column("lang_pred").to_pylist()])
            yield b.filter(pa.array((score >= least) & ~und))

    return docs.mapInArrow(keep, docs.schema)
