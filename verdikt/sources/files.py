"""File sources and sinks: JSON lines with resume, catalogs, matrices, metrics text and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Rows of JSON lines; a missing path has none, and lines that don't parse are left out."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    held = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    r = spark.read
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    parsed = F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")
    return r.text(path).where("trim(value) <> ''").select(parsed).where("r._corrupt is null").select(*(F.col(f"r.`{f.name}`") for f in schema.fields))


def with_key(df: DataFrame, column: str) -> DataFrame:
    """Rows in which an optional key is present."""
    return df.where(F.col(column).isNotNull())


def last_by_id(df: DataFrame, row_id: str, order: str) -> DataFrame:
    """The last row of each id."""
    w = Window.partitionBy(row_id).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def named_by_file(df: DataFrame, column: str = "task") -> DataFrame:
    """Adds the base name of a row's file, without its extension. ``df`` is a file scan."""
    return df.withColumn(column, F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[A-Za-z0-9]+)*$", 1))


def without_controls(df: DataFrame, prefix: str = "control_") -> DataFrame:
    return df.where(~F.startswith("_metadata.file_name", F.lit(prefix)))


def union_arms(spark: SparkSession, roots: dict[tuple[str, str], str], schema: str) -> DataFrame:
    """Readouts of several (arm, dataset) folders with those two columns."""
    out = None
    for (arm, dataset), path in roots.items():
        one = read_jsonl(spark, path, schema, recursive=True).withColumns({"arm": F.lit(arm), "dataset": F.lit(dataset)})
        out = one if out is None else out.unionByName(one)
    return out


def read_catalog(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A whole-file JSON document."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def catalog_options(tasks: DataFrame, column: str = "options") -> DataFrame:
    """Options as an array of letter, label, criteria in letter order, from a map whose values are a text or a struct in JSON."""
    e = F.transform(F.map_entries(column), lambda x: F.struct(x["key"].alias("letter"), F.coalesce(F.get_json_object(x["value"], "$.label"), x["value"]).alias("label"), F.get_json_object(x["value"], "$.criteria").alias("criteria")))
    return tasks.withColumn(column, F.array_sort(e))


def matrix_rows(spark: SparkSession, path: str, array: str) -> DataFrame:
    """row and vector of a dense matrix in an .npz archive, read by ranges of rows."""
    from .matrices import read_matrix

    return read_matrix(spark, path, array).select("row", "vector")


def append_jsonl(df: DataFrame, path: str) -> None:
    """A bare append, which a repeated job repeats; ``appends.append`` commits batches by name."""
    df.write.mode("append").json(path)


def todo(rows: DataFrame, done: DataFrame, row_id: str = "id") -> DataFrame:
    """Rows whose id isn't among the done ones."""
    return rows.join(done.select(row_id).distinct(), row_id, "left_anti")


def metric_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """labels and value of the lines of a metrics text that belong to ``name``."""
    pattern = rf"^{name}(\{{[^}}]*\}})?\s+([-+0-9.eE]+)$"
    x = spark.read.text(path).where(F.rlike("value", F.lit(pattern)))
    return x.select(F.regexp_extract("value", pattern, 1).alias("labels"), F.regexp_extract("value", pattern, 2).cast("double").alias("value"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_report(df: DataFrame, path: str) -> None:
    """An aggregated table as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table as Markdown; for aggregates: more than ``most`` rows are refused. Nulls and NaN print as a dash."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    show = lambda v: "—" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


RUN = "seg string, cond string, transcript string, segments array<struct<start:double,end:double,text:string,logprob:struct<mean:double,min:double,n:int,n_low:int>>>"


def transcript_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each segment of stored recogniser runs, one run a JSON file: seg, cond, at (its place), start, end, text, and the
    log-probability's mean, min, n and n_low. A segment without an end ends where it starts; one without a start begins at 0."""
    runs = spark.read.schema(RUN).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    x = runs.select("seg", "cond", F.posexplode("segments").alias("at", "s"))
    start = F.coalesce("s.start", F.lit(0.0))
    logp = [F.col(f"s.logprob.{c}").alias(f"logp_{c}") for c in ("mean", "min", "n", "n_low")]
    return x.select("seg", "cond", "at", start.alias("start"), F.coalesce("s.end", start).alias("end"), F.coalesce("s.text", F.lit("")).alias("text"), *logp)
