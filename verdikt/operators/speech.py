"""Labels of transcript windows from aligned tokens, scores of judged windows, and term recall."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import expr as E
from .text import is_cjk, is_latin, join_tokens


def selected_mass(probs: Column, letters: list[str]) -> Column:
    """Sum of the letters' probabilities; NaN without probabilities."""
    some = F.coalesce(F.size(F.map_keys(probs)), F.lit(0)) > 0
    return F.when(some, sum((F.coalesce(probs[x], F.lit(0.0)) for x in letters), F.lit(0.0))).otherwise(F.lit(float("nan")))


def error_score(probs: Column, listed: Column, p_ok: Column, p_err: Column) -> Column:
    """How likely a window is wrong: one less the probability that all is right where words were listed, else the error's
    probability; 0 without an answer."""
    some = F.coalesce(F.size(F.map_keys(probs)), F.lit(0)) > 0
    return F.when(~some, 0.0).when(listed, 1.0 - p_ok).otherwise(F.coalesce(p_err, F.lit(0.0)))


def block_kind(op: Column, ref: Column, hyp: Column) -> Column:
    """Kind of an edit block: F4, F2 or F1 where a Latin word is lost, replaced by one, or by others; C or c1 where at least
    two characters, or fewer, of other scripts are replaced; else the operation's first three letters."""
    latin = F.exists(ref, is_latin)
    many = F.greatest(F.size(F.filter(ref, is_cjk)), F.size(F.filter(hyp, is_cjk))) >= 2
    lost = F.when(F.size(hyp) == 0, "F4").when(F.exists(hyp, is_latin), "F2").otherwise("F1")
    return F.when(latin, lost).when(op == "replace", F.when(many, "C").otherwise("c1")).otherwise(F.substring(op, 1, 3))


def window_labels(blocks: Column, ref: Column, hyp: Column) -> Column:
    """Struct of e (a Latin word is wrong), c and c_strong (two, or three, replaced characters), n (no edit) and kinds, from the
    edit blocks that touch a window."""
    part = lambda a, x, y: F.slice(a, x + 1, y - x)
    r, h = (lambda o: part(ref, o["i1"], o["i2"])), (lambda o: part(hyp, o["j1"], o["j2"]))
    latin = lambda o: F.exists(r(o), is_latin)
    cjk = lambda o: F.greatest(F.size(F.filter(r(o), is_cjk)), F.size(F.filter(h(o), is_cjk)))
    replaced = lambda n: F.exists(blocks, lambda o: ~latin(o) & (o["op"] == "replace") & (cjk(o) >= n))
    kinds = F.transform(blocks, lambda o: block_kind(o["op"], r(o), h(o)))
    return F.struct(F.exists(blocks, latin).alias("e"), replaced(2).alias("c"), replaced(3).alias("c_strong"), (F.size(blocks) == 0).alias("n"), kinds.alias("kinds"))


def window_class(labels: Column) -> Column:
    """The class of a window's labels: A nothing wrong, B a Latin word, C other characters, D both."""
    e, c = labels["e"], labels["c"]
    return F.when(e & c, "D").when(c, "C").when(e, "B").otherwise("A")


def edited_share(blocks: Column, size: Column) -> Column:
    """Tokens in the edit blocks of another transcript that touch a window, the greater side of each, over the window's tokens."""
    edited = F.aggregate(blocks, F.lit(0), lambda s, o: s + F.greatest(o["j2"] - o["j1"], o["i2"] - o["i1"]))
    return edited / size


def window_confidence(segments: Column) -> Column:
    """Struct of mean (weighted by tokens), min and low (the share of tokens of low probability) of a window's segments, structs
    of mean, min, n and n_low; null where a segment has no log-probabilities. Segments without tokens count as one together."""
    add = lambda f: F.aggregate(segments, F.lit(0.0), lambda s, x: s + f(x))
    n = F.greatest(add(lambda x: x["n"].cast("double")), F.lit(1.0))
    whole = (F.size(segments) > 0) & F.forall(segments, lambda x: x.isNotNull() & x["mean"].isNotNull())
    least = F.array_min(F.transform(segments, lambda x: x["min"]))
    return F.when(whole, F.struct((add(lambda x: x["mean"] * x["n"]) / n).alias("mean"), least.alias("min"), (add(lambda x: x["n_low"].cast("double")) / n).alias("low")))


def instances(tokens: Column, words: Column) -> Column:
    """Starts at which the words stand consecutively among the tokens."""
    n = F.size(words)
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: (n > 0) & (F.slice(tokens, i + 1, n) == words))


def tolerant_hit(hyp_tokens: Column, term: Column, variants: Column) -> Column:
    """Whether the joined transcript holds the term or a variant, with hyphens as they are or as spaces."""
    joined = F.lower(join_tokens(hyp_tokens))
    holds = lambda v: F.contains(joined, F.replace(F.lower(v), F.lit("-"), F.lit(" "))) | F.contains(joined, F.lower(v))
    return F.contains(joined, F.lower(term)) | F.exists(variants, holds)


def disagreement(p_a: Column, p_b: Column) -> Column:
    return E.max_abs_difference(p_a, p_b)
