"""Appending rows of JSON in numbered commits, and reading the last row of an id.

``append`` works in two phases. A Spark job writes the rows to a folder of its own under ``data``; tasks that fail or run twice are
settled by Spark's own file commit. Then a manifest ``commits/<number>.json`` that names the folder and the batch is created,
which succeeds once for a number: of two writers the slower takes the next one. Readers see folders that a manifest names,
so a job that died shows nothing, and what it left is ignored.

A batch has a name. A name that is committed already isn't written again, and where two writers of one batch raced, the one
with the smaller number counts, so a repeated job or stream batch has no effect.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 12


class Log:
    """The manifests of a table's folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.root):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(self.root))
        return sorted(int(n[:DIGITS]) for n in names if n[:DIGITS].isdigit() and n[DIGITS:] == ".json")

    def _file(self, number: int):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{number:0{DIGITS}d}.json")

    def commits(self) -> list[dict]:
        """commit, batch and folder, by number; of a batch its first commit only."""
        out, seen = [], set()
        for n in self.numbers():
            stream = self.fs.open(self._file(n))
            try:
                raw = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            try:
                made = json.loads(raw)
            except ValueError:  # a writer died while it wrote this manifest
                continue
            if made["batch"] not in seen:
                seen.add(made["batch"])
                out.append({"commit": n, **made})
        return out

    def add(self, batch: str, folder: str) -> int:
        """The number under which the folder was committed."""
        raw = bytearray(json.dumps({"batch": batch, "folder": folder}).encode())
        number = (self.numbers() or [-1])[-1] + 1
        while True:
            try:
                stream = self.fs.create(self._file(number), False)
            except Exception:
                if not self.fs.exists(self._file(number)):
                    raise
                number += 1
                continue
            stream.write(raw)
            stream.close()
            return number


def append(df: DataFrame, path: str, batch: str) -> bool:
    """Commit the rows of ``df`` under the batch's name; False, and nothing written, if that is committed already."""
    log = Log(df.sparkSession, path)
    if any(c["batch"] == batch for c in log.commits()):
        return False
    folder = uuid.uuid4().hex
    df.write.json(f"{log.path}/data/{folder}", ignoreNullFields=False)
    log.add(batch, folder)
    return True


def append_in_parts(rows: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, name: str, parts: int, row_id: str = "id") -> int:
    """``make(rows)`` appended in ``parts`` commits, a share of the ids by their hash in each; the number of parts that were still
    open. A job that starts again goes on with the first part that isn't committed, so at most one part's readouts are
    read again. The same rows and number of parts must be given again."""
    done = {c["batch"] for c in Log(rows.sparkSession, path).commits()}
    open_ = [k for k in range(parts) if f"{name}/{k}-{parts}" not in done]
    for k in open_:
        append(make(rows.where(F.pmod(F.xxhash64(row_id), F.lit(parts)) == k)), path, f"{name}/{k}-{parts}")
    return len(open_)


def append_batches(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: a batch that the stream repeats after a failure has no effect."""
    return lambda df, number: None if append(df, path, f"{name}/{number}") else None


def read_appended(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All committed rows, with ``commit``, the number of their commit; a table without commits has none."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    log = Log(spark, path)
    commits = log.commits()
    if not commits:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("commit", T.LongType())]))
    table = spark.createDataFrame([(c["folder"], c["commit"]) for c in commits], "_folder string, commit long")
    rows = spark.read.schema(schema).json([f"{log.path}/data/{c['folder']}" for c in commits])
    rows = rows.withColumn("_folder", F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/", 1))
    return rows.join(F.broadcast(table), "_folder").select(*schema.names, "commit")  # a row a commit


def last_committed(rows: DataFrame, row_id: str = "id") -> DataFrame:
    """The row of each id from its last commit; of several in that commit the one whose JSON text is greatest. Rows without an
    id are left out."""
    content = F.to_json(F.struct(*[c for c in rows.columns if c != "commit"]))
    w = Window.partitionBy(row_id).orderBy(F.desc("commit"), F.desc("_content"))
    ranked = rows.where(F.col(row_id).isNotNull()).withColumn("_content", content).withColumn("_rank", F.row_number().over(w))
    return ranked.where("_rank = 1").select(*rows.columns)
