"""Documents for the operators' tests: words of a small invented language, from a seed."""

import random

DOCS = "doc_id long, text string"
#: Column names that the operators use inside.
CLASH = ["node", "key", "td", "starts", "spans", "lines", "w", "component", "class", "ws", "lang_pred", "kept", "set_hash", "kept_id", "good_id", "contaminated", "contaminated_id", "digest", "score", "x", "item_id", "canon", "r"]


def words(rng, n):
    return ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(words(rng, n))


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        for c in CLASH:
            df = df.withColumn(c, F.lit("x"))
    return df


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
