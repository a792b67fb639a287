"""URL filter: host and path rules, and a list of canonical URLs behind a blocked Bloom filter and an exact join.

A URL's host is what follows its first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path what follows
the host up to ``?``, ``#`` or the end. A rule ``host/path`` fits the host itself and its subdomains where the URL's path
starts with the rule's; of the rules that fit the longest wins (of equally long ones that with the longer host, then the one
that blocks). Rules are a short list given by the caller, at most ``MOST_RULES``.

Where no rule fits, the list decides: a URL is blocked if its canonical form is listed. The canonical form leaves out the
scheme, user, ``www.``, default ports, a last dot of the host, repeated and last slashes, index pages, the fragment and
tracking parameters, and sorts the other parameters.

The list may be of any length. Its 256-bit filter blocks are a table of at most ``MOST_BLOCKS`` rows, whatever the list's
length, so it may be broadcast: a URL looks up one block and goes on to the exact join only if all of its eight bits are
set there. The join compares canonical texts, so no false positive is left; a longer list than the filter was made for only
lets more URLs go to the join. Rows that can't be listed are never shuffled, and a URL that stands on very many rows is
split by the join.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and isn't listed, so it is
allowed; so is every URL without a rule where the list is empty. An empty host fits no rule. Null and repeated URLs of the
list count once or not at all. Rows that repeat a page_id each get their row; null page_ids are kept; an empty table gives
no rows. URLs of any length are read whole. Only page_id and url are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Bits of the filter for each listed URL, and its blocks at most: 131,072 rows of five longs.
BITS, MOST_BLOCKS = 16, 1 << 17
MOST_RULES = 1000
#: Parameters that only say where a visitor came from.
TRACKING = r"^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)"
#: What a canonical host goes without, in this order: the user, a default port, a last dot, ``www.``.
HOST_DROPS = [r"(?s)^.*@", r":(?:80|443)?\z", r"\.\z", r"^www\."]
WORDS = 4
#: The rules of the query, as (verdict, rule).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form of a URL; null where it has no ``://`` or no host."""
    host = host_of(url)
    for dropped in HOST_DROPS:
        host = F.regexp_replace(host, dropped, "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/{2,}", "/"), r"(?:/index\.html?)?/?\z", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that decides and its verdict, null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: give them as a list of URLs")
    split = [(verdict, rule, *rule.partition("/")[::2]) for verdict, rule in rules]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text, its_host, its_path in sorted(split, key=lambda r: (len(r[1]), len(r[2]), r[0] == "block")):
        fits = ((host == its_host) | host.endswith(f".{its_host}")) & path.startswith(f"/{its_path}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Two bits in each word of the key's block, by eight parts of a hash of their own."""
    h = F.xxhash64(F.lit(1), key)
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * j).bitwiseOR(bit(2 * j + 1)) for j in range(WORDS)]


def bloom(listed: DataFrame, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of ``listed`` (canon, distinct) as a table (block, w0 to w3) and its number of blocks, a power of two."""
    blocks, wanted = 1, listed.count() * BITS // 256
    while blocks < min(wanted, most_blocks):
        blocks *= 2
    key = F.col("canon")
    rows = listed.select(_block(key, blocks).alias("block"), *(m.alias(f"w{j}") for j, m in enumerate(_masks(key))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS))), blocks


def judge(pages: DataFrame, urls: DataFrame, rules: list[tuple[str, str]] = RULES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, canon, possible (by the filter) and listed of each row of ``pages``.

    ``urls``: a column ``url`` of listed URLs, in any form.
    """
    listed = cut(urls.select(canonical(F.col("url")).alias("canon")).where("canon is not null").distinct(), "listed-urls")
    table, blocks = bloom(listed, most_blocks)
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", "canon", rule.alias("rule"), verdict.alias("ruled"))
    # at most MOST_BLOCKS rows, by construction
    rows = rows.withColumn("block", _block(F.col("canon"), blocks)).join(F.broadcast(table), "block", "left")
    inside = [F.col(f"w{j}").bitwiseAND(m) == m for j, m in enumerate(_masks(F.col("canon")))]
    possible = F.coalesce(inside[0] & inside[1] & inside[2] & inside[3] & F.col("canon").isNotNull(), F.lit(False))
    rows = rows.select("page_id", "host", "path", "canon", "rule", "ruled", possible.alias("possible"))
    sure = listed.select(F.col("canon").alias("listed_canon"))
    hits = rows.where("possible").join(sure, F.col("canon") == F.col("listed_canon"), "left")
    hits = hits.withColumn("listed", F.col("listed_canon").isNotNull()).drop("listed_canon")
    out = hits.unionByName(rows.where("not possible").withColumn("listed", F.lit(False)))
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canon", "possible", "listed")


def repeated(pages: DataFrame) -> DataFrame:
    """The list of the query: the URLs that the crawl has on two or more pages in their canonical form."""
    return pages.select("url", canonical(F.col("url")).alias("canon")).where("canon is not null").groupBy("canon").agg(F.count("*").alias("n"), F.min("url").alias("url")).where("n > 1").select("url")


def digest(out: DataFrame) -> DataFrame:
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


def _sql_canon(rest: str) -> str:
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for dropped in HOST_DROPS:
        host = f"regexp_replace({host}, '{dropped}', '')"
    path = rf"regexp_replace(regexp_replace(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g'), '(?:/index\.html?)?/?\z', '')"
    kept = rf"list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '{TRACKING}')))"
    return f"case when {host} <> '' then {host} || {path} || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end end"


_FITS = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{{{k}}}'" for k, (h, p) in enumerate(r.partition("/")[::2] for _, r in sorted(RULES, key=lambda r: -len(r[1]))))
_ORDERED = sorted(RULES, key=lambda r: -len(r[1]))
SQL = f"""
with parts as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end rest from pages),
judged as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path, {_sql_canon("rest")} canon from parts),
often as (select canon from judged where canon is not null group by canon having count(*) > 1)
select page_id, host, path, case {_FITS.format(*(r for _, r in _ORDERED))} end as rule,
  coalesce(case {_FITS.format(*(v for v, _ in _ORDERED))} end, case when o.canon is not null then 'block' else 'allow' end) as verdict, o.canon is not null as listed
from judged left join often o using (canon)
"""
