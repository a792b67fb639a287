"""Text operators: answer parsing, tokens, language tags, cue terms, rules, rendering and sequence alignment."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import settled

#: Pattern of a word, number or single CJK character.
TOKEN = r"[A-Za-z][A-Za-z0-9'\-]*|\p{Nd}+(?:\.\p{Nd}+)?|[㐀-鿿]"
CJK = r"[一-鿿]"
#: Patterns of a named answer and of a letter that stands alone.
NAMED, ALONE = r'(?U)"answer"\s*:\s*"\s*([A-J])', r"(?U)\b([A-J])\b"


def parse_letter(text: Column, letters: list[str]) -> Column:
    """The letter A to J that a JSON-like answer begins with, if it is an option; else the first such letter that stands as a
    word, null if that is no option. Words and white space are those of Unicode."""
    named, alone = F.regexp_extract(text, NAMED, 1), F.regexp_extract(text, ALONE, 1)
    return F.when(named.isin(letters), named).when(alone.isin(letters), alone)


def best_by_letter(df: DataFrame, by: list[str], tokens: str, letters: list[str]) -> DataFrame:
    """by and a map of letters to the greatest log-probability among the tokens that are that letter once trimmed.
    ``tokens``: array of structs token, logprob."""
    x = df.select(*by, F.explode(tokens).alias("t")).select(*by, F.trim("t.token").alias("letter"), "t.logprob").where(F.col("letter").isin(letters))
    x = x.groupBy(*by, "letter").agg(F.max("logprob").alias("logprob"))
    return x.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", "logprob")))).alias("raw_logprobs"))


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), lambda x: F.lower(x))


def is_latin(token: Column) -> Column:
    return F.rlike(token, F.lit("^[A-Za-z]"))


def is_cjk(token: Column) -> Column:
    """Whether a token begins beyond ASCII."""
    return F.rlike(token, F.lit(r"^[^\x00-\x7F]"))


def join_tokens(toks: Column) -> Column:
    """Tokens in a row, with a space only between two of ASCII."""
    ascii_ = lambda x: ~F.rlike(x, F.lit(r"[^\x00-\x7F]"))
    step = lambda a, x: F.when(a == "", x).when(ascii_(F.substring(a, -1, 1)) & ascii_(F.substring(x, 1, 1)), F.concat(a, F.lit(" "), x)).otherwise(F.concat(a, x))
    return F.aggregate(toks, F.lit(""), step)


def contains_run(toks: Column, part: list[str]) -> Column:
    """Whether the tokens hold ``part`` consecutively."""
    want = F.array(*map(F.lit, part))
    at = F.sequence(F.lit(1), F.greatest(F.size(toks) - len(part) + 1, F.lit(1)))
    return F.exists(at, lambda i: F.slice(toks, i, len(part)) == want)


def language_tag(text: Column, rule: str = "any") -> Column:
    """zh or en by one of three rules: any CJK character; any character from U+3000 on; at least 30 % CJK characters."""
    cjk = {
        "any": F.rlike(text, F.lit(CJK)),
        "wide": F.rlike(text, F.lit(r"[　-￿]")),
        "ratio": F.length(F.regexp_replace(text, r"[^一-鿿]", "")) >= 0.3 * F.greatest(F.length(text), F.lit(1)),
    }[rule]
    return F.when(cjk, "zh").otherwise("en")


def source_id(row_id: Column, mark: str) -> Column:
    """The id before the last occurrence of ``mark``; the id itself without one."""
    at = F.length(row_id) - F.instr(F.reverse(row_id), mark[::-1]) - len(mark) + 1
    return F.when(F.instr(row_id, mark) > 0, F.substring(row_id, F.lit(1), at)).otherwise(row_id)


def cue_terms(text: Column, stop: list[str]) -> Column:
    """CJK terms of 2 to 6 characters and English words of 4 letters or more, without stop words, first ones first."""
    cjk = F.regexp_extract_all(text, F.lit(r"([一-鿿]{2,6})"), F.lit(1))
    latin = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z]{4,})"), F.lit(1)), lambda x: F.lower(x))
    return F.array_except(F.array_distinct(F.concat(cjk, latin)), F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>"))


def remove_cues(text: Column, cues: list[str]) -> Column:
    out = text
    for c in cues:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def render(template: str, **columns: Column) -> Column:
    """Text with {name} parts replaced by columns; nulls are empty."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(columns[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def compact_json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def plain_number(x: Column, digits: int = 6) -> Column:
    """A number with at most that many decimals, without trailing zeros."""
    s = F.format_string(f"%.{digits}f", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")


OPCODES = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n == "op" else T.IntegerType()) for n in ("op", "i1", "i2", "j1", "j2")]))


@F.pandas_udf(OPCODES)
def opcodes(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Alignment of two token arrays as edit blocks, with no token treated as junk."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else [dict(zip(("op", "i1", "i2", "j1", "j2"), o, strict=True)) for o in SequenceMatcher(None, list(x), list(y), autojunk=False).get_opcodes()] for x, y in zip(a, b, strict=True)])


def error_rate(ops: Column, reference: Column) -> Column:
    """Tokens of the edit blocks over the reference's tokens: the greater side of each block counts."""
    wrong = F.aggregate(ops, F.lit(0), lambda s, o: s + F.when(o["op"] == "equal", 0).otherwise(F.greatest(o["i2"] - o["i1"], o["j2"] - o["j1"])))
    return wrong / F.greatest(F.size(reference), F.lit(1))


def blocks_in_window(ops: Column, lo: Column, hi: Column) -> Column:
    """Edit blocks that touch [lo, hi) of the second side; an empty block belongs to the window it stands in."""
    hit = lambda o: F.when(o["j1"] == o["j2"], (o["j1"] >= lo) & (o["j1"] < hi)).otherwise((o["j1"] < hi) & (o["j2"] > lo))
    return F.filter(ops, lambda o: (o["op"] != "equal") & hit(o))


def tfidf(docs: DataFrame, row_id: str, text: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """row, gram and weight: n-grams inside words padded by spaces; 1 + ln tf, smoothed idf over ``docs``, unit length."""
    from .sparse import gram_counts, vocabulary, weights

    counts = settled(gram_counts(docs, row_id, text, sizes), "grams")
    words = settled(vocabulary(counts, docs.count()), "words")
    x = weights(counts, words).select("row", F.explode("entries").alias("e"))
    return x.join(words, F.col("e.at") == F.col("at")).select("row", "gram", F.col("e.v").alias("weight"))
