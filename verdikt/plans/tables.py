"""Decision tables derived from the driver's tables, as DataFrames and as the same SQL.

``decisions``: a row of option scores for each line item and arm. The true logits are a line's quantity, discount and tax;
the gold option is drawn from their softmax by a hash of the row's id, and the published logits are three times the true
ones, so a fitted temperature must come back near three. Arms B and C add hashed noise to arm A.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import hash_unit

LETTERS = ["A", "B", "C"]
#: How widely an arm's logits are moved; arm C reruns arm A nearly alike.
NOISE = {"B": 4.0, "C": 0.05}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noise(arm: str, j: int):
    """What an arm adds to a logit of arm A."""
    return (hash_unit("id", F.lit(f"{arm.lower()}{j}"), buckets=1000) - 0.5) * NOISE[arm] if arm in NOISE else F.lit(0.0)


def decisions(spark: SparkSession, sf_dir: str, arms: str = "A") -> DataFrame:
    """arm, task, id, group_id, hard_type, lang, latency_ms, gold, z0, z1, z2, logits."""
    li = table(spark, sf_dir, "lineitem")
    row_id = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    a = [F.col("l_quantity") / 10.0, 50.0 * F.col("l_discount"), 60.0 * F.col("l_tax")]
    rows = li.select(
        F.col("l_linestatus").alias("task"), row_id.alias("id"), F.col("l_orderkey").cast("string").alias("group_id"), F.col("l_returnflag").alias("hard_type"),
        F.year("l_shipdate").cast("string").alias("lang"), (F.col("l_extendedprice") / 100.0).alias("latency_ms"), *(x.alias(f"a{j}") for j, x in enumerate(a)),
    )
    e = [F.exp(f"a{j}") for j in range(3)]
    u, s = hash_unit("id", F.lit("u")), e[0] + e[1] + e[2]
    gold = F.when(u < e[0] / s, 0).when(u < (e[0] + e[1]) / s, 1).otherwise(2)
    keep = ["task", "id", "group_id", "hard_type", "lang", "latency_ms"]
    rows = rows.select(*keep, gold.alias("gold"), *(f"a{j}" for j in range(3)))
    out = []
    for arm in arms:
        z = [F.col(f"a{j}") * 3.0 + noise(arm, j) for j in range(3)]
        out.append(rows.select(F.lit(arm).alias("arm"), *keep, "gold", *(x.alias(f"z{j}") for j, x in enumerate(z))))
    df = out[0]
    for other in out[1:]:
        df = df.unionByName(other)
    return df.withColumn("logits", F.array("z0", "z1", "z2"))


def raw_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arm A as a readout file has it: a map of letters to log-probabilities, in which one letter in 25 is missing."""
    d = decisions(spark, sf_dir)
    d = d.withColumn("_s", F.log(F.exp("z0") + F.exp("z1") + F.exp("z2")))
    there = lambda j: hash_unit("id", F.lit(f"m{j}"), buckets=1000) >= 0.04
    d = d.withColumns({f"_v{j}": F.when(there(j), F.col(f"z{j}") - F.col("_s")) for j in range(len(LETTERS))})
    entries = F.array_compact(F.array(*(F.when(F.col(f"_v{j}").isNotNull(), F.struct(F.lit(x).alias("k"), F.col(f"_v{j}").alias("v"))) for j, x in enumerate(LETTERS))))
    return d.select("task", "id", "group_id", "gold", F.map_from_entries(entries).alias("raw_logprobs"))


def emb_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, gold, split and scores: 10 times the cosine with each label's centroid of the centroid half."""
    from ..operators.rank import centroids, scores

    e = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    e = e.withColumn("half", F.when(hash_unit("vec_id", F.lit("c")) < 0.5, "centroid").otherwise("test"))
    return scores(e.where("half = 'test'").select("vec_id", F.col("label").alias("gold"), "embedding"), centroids(e.where("half = 'centroid'")))


_HASH = "((cast('0x' || substr(md5({x}), 1, 8) as bigint) % {n}) / cast({n} as double))"


def sql_unit(x: str, buckets: int = 10_000) -> str:
    return _HASH.format(x=x, n=buckets)


_B = " , ".join(f"3 * a{j} + ({sql_unit(f'''id || ':b{j}' ''', 1000)} - 0.5::double) * 4 z{j}" for j in range(3))
#: CTEs base, golds and dec (both arms), then p (softmax columns p0 to p2) and spl (with the split of seed 0).
SQL = f"""
with base as (select l_linestatus task, concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar)) id,
  cast(l_orderkey as varchar) group_id, l_returnflag hard_type, cast(year(l_shipdate) as varchar) lang, l_extendedprice / 100::double latency_ms,
  l_quantity / 10::double a0, 50::double * l_discount a1, 60::double * l_tax a2 from lineitem),
g as (select *, exp(a0) + exp(a1) + exp(a2) s, {sql_unit("id || ':u'")} u from base),
golds as (select *, case when u < exp(a0) / s then 0 when u < (exp(a0) + exp(a1)) / s then 1 else 2 end gold from g),
dec as (select 'A' arm, task, id, group_id, hard_type, lang, latency_ms, gold, 3 * a0 z0, 3 * a1 z1, 3 * a2 z2 from golds
  union all select 'B', task, id, group_id, hard_type, lang, latency_ms, gold, {_B} from golds),
e as (select *, exp(z0 - greatest(z0, z1, z2)) e0, exp(z1 - greatest(z0, z1, z2)) e1, exp(z2 - greatest(z0, z1, z2)) e2 from dec),
pp as (select *, e0 / (e0 + e1 + e2) p0, e1 / (e0 + e1 + e2) p1, e2 / (e0 + e1 + e2) p2 from e),
p as (select *, greatest(p0, p1, p2) conf, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end chosen from pp),
grp as (select task, group_id, row_number() over (partition by task order by md5(group_id || ':0'), group_id) rk, count(*) over (partition by task) n from (select distinct task, group_id from dec)),
spl as (select p.*, chosen = gold correct, rk <= n // 2 cal from p join grp using (task, group_id))
"""

_C = " , ".join(f"3 * a{j} + ({sql_unit(f"id || ':c{j}' ", 1000)} - 0.5::double) * 0.05::double z{j}" for j in range(3))
#: The same with arm C.
SQL_C = SQL.replace("lang, latency_ms, gold, " + _B + " from golds)", "lang, latency_ms, gold, " + _B + " from golds union all select 'C', task, id, group_id, hard_type, lang, latency_ms, gold, " + _C + " from golds)")
