"""Queries over texts: tokens, tags, rules, cue terms, TF-IDF, digests and token parity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import text as X
from . import tables as T
from .util import Query, tidy

RULES = [("all rights reserved|licensed under", "license"), ("[#$%&*]{3}", "junk"), ("https?://", "link"), (r"\|", "table")]


def rules_baseline(spark, d):
    """First matching rule of each document against its quality label: agreement and kappa by rule."""
    rule = E.first_rule(F.coalesce("text", F.lit("")), RULES, "none")
    docs = T.table(spark, d, "documents").select("doc_id", rule.alias("rule"))
    x = docs.join(T.table(spark, d, "labels").select("doc_id", "quality"), "doc_id").withColumn("said", F.when(F.col("rule").isin("junk", "table"), 0).otherwise(1))
    a = x.groupBy("rule").agg(F.count("*").alias("n"), F.avg((F.col("said") == F.col("quality")).cast("double")).alias("agreement"))
    k = M.kappa(x.withColumn("all", F.lit(1)), ["all"], "said", "quality").select("kappa")
    return tidy(a.crossJoin(F.broadcast(k)))


RULES_SQL = """with r as (select doc_id, case when regexp_matches(coalesce(text, ''), '(?i)all rights reserved|licensed under') then 'license' when regexp_matches(coalesce(text, ''), '[#$%&*]{3}') then 'junk' when regexp_matches(coalesce(text, ''), '(?i)https?://') then 'link' when regexp_matches(coalesce(text, ''), '\\|') then 'table' else 'none' end rule from documents),
x as (select rule, quality, case when rule in ('junk', 'table') then 0 else 1 end said from r join labels using (doc_id)), n as (select count(*)::double n, sum((said = quality)::int) same, sum(said) s1, sum(quality) q1 from x),
k as (select (same / n - (s1 * q1 + (n - s1) * (n - q1)) / (n * n)) / (1 - (s1 * q1 + (n - s1) * (n - q1)) / (n * n)) kappa from n)
select rule, count(*) n, round(avg((said = quality)::int), 6) agreement, round(max(kappa), 6) kappa from x, k group by rule"""


#: Strings with what the documents lack: characters of the CJK extension, digits of other scripts, apostrophes.
ODD = "㐀㐁漢字 ٣.٤ don't x-1 3.14 ４２ naïve"


def token_counts(spark, d):
    """Tokens of each document, with a tail of rare characters: how many, different ones, Latin ones and others."""
    x = T.table(spark, d, "documents").select("doc_id", F.explode(F.array(X.tokens(F.concat(F.coalesce("text", F.lit("")), F.lit(" " + ODD))))).alias("t"))
    return tidy(x.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("different"), F.size(F.filter("t", X.is_latin)).alias("latin"), F.size(F.filter("t", X.is_cjk)).alias("other")))


TOKENS = """with x as (select doc_id, list_transform(regexp_extract_all(coalesce(text, '') || ' """ + ODD.replace("'", "''") + """', '[A-Za-z][A-Za-z0-9''\\-]*|\\p{Nd}+(?:\\.\\p{Nd}+)?|[㐀-鿿]'), lambda v: lower(v)) t from documents)
select doc_id, len(t)::bigint n, len(list_distinct(t))::bigint different, len(list_filter(t, lambda v: regexp_matches(v, '^[A-Za-z]')))::bigint latin,
 len(list_filter(t, lambda v: regexp_matches(v, '^[^\\x00-\\x7F]')))::bigint other from x"""


def language_tags(spark, d):
    """The three tags of each document's text, of every second one with a word of another script before it."""
    x = T.table(spark, d, "documents").withColumn("t", F.concat(F.element_at(F.array(F.lit("漢字　"), F.lit("！"), F.lit("")), F.col("doc_id").cast("int") % 3 + 1), F.substring(F.coalesce("text", F.lit("")), 1, 12)))
    tags = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), X.language_tag(F.col("t"), r).alias("tag")) for r in ("any", "wide", "ratio"))))
    return tidy(x.select("lang", tags.alias("t")).groupBy("lang", "t.rule", "t.tag").agg(F.count("*").alias("n")))


TAGS = """with x as (select lang, case doc_id % 3 when 0 then '漢字　' when 1 then '！' else '' end || substr(coalesce(text, ''), 1, 12) t from documents),
r as (select lang, t, unnest(['any', 'wide', 'ratio']) "rule" from x)
select lang, "rule", case when ("rule" = 'any' and regexp_matches(t, '[一-鿿]')) or ("rule" = 'wide' and regexp_matches(t, '[　-￿]')) or ("rule" = 'ratio' and length(regexp_replace(t, '[^一-鿿]', '', 'g')) >= 0.3 * greatest(length(t), 1)) then 'zh' else 'en' end tag, count(*) n from r group by all"""


def answer_letters(spark, d):
    """Letters parsed from answers of six forms: named, named without an end, named but no option, after an I, in lower
    case, and beside characters of another script."""
    x = T.decisions(spark, d).select("id", "task", F.element_at(F.array(*map(F.lit, T.LETTERS)), F.col("gold") + 1).alias("letter"), F.floor(E.hash_unit("id", F.lit("f"), buckets=6) * 6.0 + 0.5).alias("form"))
    forms = ['{"answer": "{letter}"}', '{"answer" : " {letter}', '{"answer": "Z"} so {letter}', "I choose {letter}", "it is {lower} then", "選{letter}項"]
    said = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        before, _, after = form.replace("{letter}", "@").replace("{lower}", "%").partition("@" if "{letter}" in form else "%")
        said = F.when(F.col("form") == k, F.concat(F.lit(before), "letter" if "{letter}" in form else F.lower("letter"), F.lit(after))).otherwise(said)
    x = x.withColumn("parsed", X.parse_letter(said, T.LETTERS))
    return tidy(x.groupBy("task", "form").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("parsed") == F.col("letter"), F.lit(False)).cast("long")).alias("right"), F.sum(F.col("parsed").isNull().cast("long")).alias("none")))


#: Forms 0 to 2 give the letter. In the third I comes first, which is a letter but no option; then it is in lower case, and between
#: letters of one word.
ANSWERS = f"""{T.SQL}, x as (select task, floor({T.sql_unit("id || ':f'", 6)} * 6 + 0.5::double) form from dec where arm = 'A') select task, form::bigint form, count(*) n, sum((form < 3)::int)::bigint "right", sum((form >= 3)::int)::bigint "none" from x group by task, form"""


def cue_terms(spark, d):
    """The commonest cue terms of the benchmark."""
    x = T.table(spark, d, "benchmark").select(F.explode(X.cue_terms(F.coalesce("text", F.lit("")), ["the", "with", "from"])).alias("term"))
    n = x.groupBy("term").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "term").limit(50)


CUES = """with x as (select item_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{4,}'))) term from benchmark) select term, count(distinct item_id) n from x where term not in ('the', 'with', 'from') group by term order by n desc, term limit 50"""


def tfidf_weights(spark, d):
    """Length and sum of the benchmark items' TF-IDF vectors."""
    w = X.tfidf(T.table(spark, d, "benchmark"), "item_id", "text")
    return tidy(w.groupBy("row").agg(F.count("*").alias("grams"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"), F.sum("weight").alias("total")))


TFIDF = """with w as (select item_id, ' ' || unnest(regexp_split_to_array(trim(lower(text)), '\\s+')) || ' ' w from benchmark), w2 as (select * from w where w <> '  '),
g as (select item_id, substr(w, i, 1) g from (select item_id, w, unnest(range(1, length(w) + 1)) i from w2) union all select item_id, substr(w, i, 2) from (select item_id, w, unnest(range(1, length(w))) i from w2) union all select item_id, substr(w, i, 3) from (select item_id, w, unnest(range(1, length(w) - 1)) i from w2)),
tf as (select item_id, g, count(*) tf from g group by all), n as (select count(*) n from benchmark), df as (select g, ln((1 + max(n)) / (1 + count(*))::double) + 1 idf from tf, n group by g),
v as (select item_id, (1 + ln(tf)) * idf v from tf join df using (g)), l as (select item_id, sqrt(sum(v * v)) l from v group by item_id)
select item_id "row", count(*) grams, round(sqrt(sum(v / l * v / l)), 6) length, round(sum(v / l), 6) total from v join l using (item_id) group by item_id"""


def text_digests(spark, d):
    return T.table(spark, d, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("sha256"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("n"))


def token_parity(spark, d):
    """First word in which a turn differs from the turn before it in its conversation; null if they are equal."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = T.table(spark, d, "conversations").withColumn("t", F.split(F.coalesce("text", F.lit("")), " ")).withColumn("b", F.lag("t").over(w)).where("b is not null")
    return tidy(c.select("conv_id", "turn", Q.first_difference(F.col("t"), F.col("b")).alias("first_diff")))


PARITY = """with c as (select conv_id, turn, string_split(coalesce(text, ''), ' ') t, lag(string_split(coalesce(text, ''), ' ')) over (partition by conv_id order by turn) b from conversations),
x as (select conv_id, turn, t, b, unnest(range(1, greatest(len(t), len(b)) + 1)) i from c where b is not null), f as (select conv_id, turn, min(i) filter (t[i] is distinct from b[i]) - 1 first_diff from x group by conv_id, turn) select conv_id, turn, first_diff from f"""


def alignments(spark, d):
    """Error rate of each conversation's last user turn against its first, by token alignment."""
    c = T.table(spark, d, "conversations").where("role = 'user' and text is not null")
    x = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    x = x.select("conv_id", X.tokens(F.col("a")).alias("ref"), X.tokens(F.col("b")).alias("hyp")).withColumn("ops", X.opcodes("ref", "hyp"))
    return tidy(x.select("conv_id", X.error_rate(F.col("ops"), F.col("ref")).alias("error_rate"), F.size(X.blocks_in_window(F.col("ops"), F.lit(0), F.lit(10))).alias("early_blocks")))


QUERIES: dict[str, Query] = {
    "c27_rules": (rules_baseline, RULES_SQL),
    "f03_tokens": (token_counts, TOKENS),
    "f07_language_tags": (language_tags, TAGS),
    "f01_answer_letters": (answer_letters, ANSWERS),
    "f13_cue_terms": (cue_terms, CUES),
    "c29_tfidf": (tfidf_weights, TFIDF),
    "f20_digests": (text_digests, "select page_id, sha256(coalesce(html, '')) sha256, length(coalesce(html, '')) n from pages"),
    "g11_token_parity": (token_parity, PARITY),
    "f18_alignment": (alignments, None),
}
