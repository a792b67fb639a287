"""TF-IDF over character n-grams with a vocabulary that is a table, and logistic regression on sparse rows.

Counts are rows of (row, gram, tf). The vocabulary holds every n-gram of the training rows, with its number, given by a range
sort over the cluster, and its idf from all training rows; nothing is cut off and neither counts nor n-grams come to the
driver. Rows become sparse vectors after the join with it. The regression is Spark's own, whose gradients are added up over
the partitions each iteration; what the driver holds is one number for each n-gram and class.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from .running import numbered

SIZES = (1, 2, 3)


def gram_counts(rows: DataFrame, key: str, text: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """row, gram and tf: the n-grams inside the lower-case words of a text, each word padded by a space at both ends. Null and
    blank texts have none. Texts are dealt by row once; everything up to the sums of a row then stays where it is."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, since texts are small beside their n-grams
    w = rows.select(F.col(key).alias("row"), F.col(text)).repartition(n, "row").select("row", F.explode(F.split(F.lower(F.col(text)), r"(?U)\s+")).alias("w")).where("w <> ''")
    w = w.groupBy("row", "w").agg(F.count("*").alias("n")).select("row", "n", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    cut = lambda n: F.when(F.length("w") >= n, F.transform(F.sequence(F.lit(1), F.length("w") - (n - 1)), lambda i: F.substring(F.col("w"), i, n))).otherwise(F.array().cast("array<string>"))
    return w.select("row", "n", F.explode(F.concat(*map(cut, sizes))).alias("gram")).groupBy("row", "gram").agg(F.sum("n").alias("tf"))


def vocabulary(counts: DataFrame, rows: int) -> DataFrame:
    """gram, at (from 0) and idf = 1 + ln((1 + rows) / (1 + df)) of every n-gram of ``counts``, the counts of ``rows`` rows."""
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    return numbered(df, ["gram"], "at").select("gram", (F.col("at") - 1).alias("at"), (F.log(F.lit(1.0 + rows) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weights(counts: DataFrame, words: DataFrame) -> DataFrame:
    """row, entries (at and weight, by at) of unit length: 1 + ln tf times idf; n-grams outside the vocabulary don't count."""
    x = counts.join(words, "gram").select("row", "at", ((1.0 + F.log("tf")) * F.col("idf")).alias("v"))
    # the length is a sum of the aggregation: inside the lambda Spark would add it up anew for every entry
    x = x.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("e"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_l"))  # a row's own n-grams
    return x.select("row", F.transform("e", lambda y: F.struct(y["at"].alias("at"), (y["v"] / F.col("_l")).alias("v"))).alias("entries"))


def sparse(entries: Column, size: int) -> Column:
    """Entries as a vector of Spark's ML library; null for none is the zero vector."""
    make = F.udf(lambda at, v: Vectors.sparse(size, at or [], v or []), VectorUDT())
    return make(entries["at"], entries["v"])


def tfidf_arm(rows: DataFrame, key: str, c: float = 10.0, sizes: tuple[int, ...] = SIZES, rounds: int = 200) -> DataFrame:
    """key, gold, said and p (the probability of ``said``) of the rows that aren't ``train``: a logistic regression on TF-IDF
    weights of character n-grams, learned from all train rows and all their n-grams. rows: key (unique), text, gold (int), train.

    With one class in the train rows that class is said with probability 1; without train rows null is. A text without a
    known n-gram is judged by the intercepts.
    """
    rows = rows.select(F.col(key).alias("_key"), "text", F.col("gold").cast("int").alias("gold"), "train")
    test = rows.where("not train")
    classes = sorted(r[0] for r in rows.where("train and gold is not null").select("gold").distinct().collect())  # a row a class
    if len(classes) < 2:
        one = F.lit(classes[0] if classes else None).cast("int")
        return test.select(F.col("_key").alias(key), "gold", one.alias("said"), F.when(one.isNotNull(), 1.0).alias("p"))
    train = rows.where("train and gold is not null")
    n = train.count()
    counts = gram_counts(train, "_key", "text", sizes)  # made twice, from texts: dealing the counts themselves would move far more
    words = settled(vocabulary(counts, n), "words")
    size = max(words.count(), 1)
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("gold")) - 1
    known = train.join(weights(counts, words), F.col("_key") == F.col("row"), "left")
    points = settled(known.select(label.cast("double").alias("label"), sparse(F.col("entries"), size).alias("features")), "points")
    fit = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=1e-9, family="binomial" if len(classes) == 2 else "multinomial").fit(points)
    judged = test.join(weights(gram_counts(test, "_key", "text", sizes), words), F.col("_key") == F.col("row"), "left")
    judged = fit.transform(judged.select("_key", "gold", sparse(F.col("entries"), size).alias("features")))
    p = vector_to_array("probability")
    said = F.get(F.array(*map(F.lit, classes)), F.col("prediction").cast("int"))
    return judged.select(F.col("_key").alias(key), "gold", said.alias("said"), F.get(p, F.col("prediction").cast("int")).alias("p"))
