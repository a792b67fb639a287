"""Readers, sinks, resume and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.sources import files, readers
from verdikt.streaming import resume

SCHEMA = "id string, x long"


def test_jsonl_missing_and_corrupt(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    p = tmp_path / "a" / "control_x.jsonl"
    p.parent.mkdir()
    p.write_text('{"id": "1", "x": 1}\nnot json\n\n{"id": "1", "x": 2}\n')
    (tmp_path / "a" / "task.jsonl").write_text('{"id": "2"}\n')
    df = files.read_jsonl(spark, str(tmp_path / "a"), SCHEMA)
    assert df.count() == 3
    assert files.with_key(df, "x").count() == 2
    assert files.last_by_id(df, "id", "x").where("id = '1'").first()["x"] == 2
    named = files.read_jsonl(spark, str(tmp_path / "a"), SCHEMA, pattern="task*")
    assert named.count() == 1


def test_catalog_and_matrix(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"task": "t", "options": {"B": "no", "A": json.dumps({"label": "yes", "criteria": "c"})}}))
    c = files.catalog_options(files.read_catalog(spark, str(tmp_path / "c.json"), "task string, options map<string,string>"))
    assert [(o["letter"], o["label"], o["criteria"]) for o in c.first()["options"]] == [("A", "yes", "c"), ("B", "no", None)]
    np.savez(tmp_path / "m.npz", s=np.arange(6).reshape(2, 3))
    assert files.matrix_rows(spark, str(tmp_path / "m.npz"), "s").orderBy("row").collect()[1]["vector"] == [3.0, 4.0, 5.0]


def test_metrics_text_and_reports(spark, tmp_path):
    (tmp_path / "m.txt").write_text('# help\nhits_total{a="1"} 3\nhits_total 4.5\nother 1\n')
    assert sorted(r["value"] for r in files.metric_lines(spark, str(tmp_path / "m.txt"), "hits_total").collect()) == [3.0, 4.5]
    df = spark.createDataFrame([("a", 0.12345, None)], "t string, v double, w double")
    assert files.markdown(df).splitlines()[-1] == "| a | 0.123 | — |"
    files.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    assert files.file_digests(spark, str(tmp_path / "m.txt")).first()["sha256"]


def test_acquire_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"p{i}") for i in range(10)], "id string, prompt string")
    out = readers.acquire(rows, "uniform", {"letters": ["A", "B"]}, batch=3, sort_by="prompt")
    assert out.where("error is null").count() == 10
    files.append_jsonl(out.where("id < '5'").select("id"), str(tmp_path / "done"))
    assert files.todo(rows, spark.read.json(str(tmp_path / "done")).select(F.col("id").cast("string"))).count() == 5
    stored = readers.from_table(rows, out.where("id < '3'"))
    assert stored.where("error = 'no readout'").count() == 7
    probs = spark.createDataFrame([({"A": 0.0},)], "probs map<string,double>")
    assert readers.joint_schema_logprobs(probs).first()["raw_logprobs"]["A"] < -27


class Broken:
    def read(self, prompts):
        raise RuntimeError("down")


def test_failed_reader_gives_error_rows(spark):
    readers.register("broken", Broken)
    rows = spark.createDataFrame([("1", "p")], "id string, prompt string")
    assert readers.acquire(rows, "broken").first()["error"] == "down"


def test_stream_keeps_one_row_an_id(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "x": 1}\n{"id": "1", "x": 1}\n{"id": "2", "x": 1}\n')
    q = resume.append(resume.readouts(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def answer(path, body):
    """What a server of each kind says: B is likeliest, C is missing from lists of likeliest tokens."""
    listed = [(" B", -0.1, 11), ("B", -3.0, 12), ("A", -2.5, 10), ("x", -4.0, 1)]
    if path == "/completion":
        if body["prompt"] == "old":
            return {"completion_probabilities": [{"probs": [{"tok_str": "A", "prob": 0.0}, {"tok_str": "B", "prob": 0.5}]}]}
        return {"completion_probabilities": [{"top_logprobs": [{"token": t, "logprob": p} for t, p, _ in listed]}], "tokens_evaluated": 7}
    if path == "/generate":
        ids = body.get("token_ids_logprob")
        one = lambda i: {"meta_info": {"output_top_logprobs": [[[p, n, t] for t, p, n in listed]], **({"output_token_ids_logprobs": [[[-float(n), n] for n in ids[i]]]} if ids else {})}}
        return [one(i) for i in range(len(body.get("text") or body["input_ids"]))]
    if path == "/v1/chat/completions":
        return {"choices": [{"message": {"content": {"json": '{"answer": "B"}', "other": '{"answer": "Z"} so C'}.get(body["messages"][0]["content"], "I cannot say")}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3}}
    q = body["questions"]["q"]
    return {"answers": {"q": {"noul": 0.25} if q["type"] == "noul" else {"probabilities": {"o2": 0.9, "o1": 0.1} if "criteria" in q else {"1": 1.0, "0": 0.0}}}}


def test_clients_read_what_servers_say(spark):
    import math
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    met = []

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            met.append(self.client_address)
            super().setup()

        def do_POST(self):  # noqa: N802
            raw = json.dumps(answer(self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))))).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        options = {"url": f"http://127.0.0.1:{server.server_port}/", "letters": ["A", "B", "C"]}
        rows = lambda *prompts: spark.createDataFrame([(str(i), p) for i, p in enumerate(prompts)], "id string, prompt string")
        got = lambda df: [r["raw_logprobs"] for r in df.orderBy("id").collect()]
        assert got(readers.acquire(rows("p", "old"), "completion", options)) == [{"A": -2.5, "B": -0.1}, {"A": math.log(1e-12), "B": math.log(0.5)}]
        assert got(readers.acquire(rows("p", "q", "r"), "generate", options, batch=2)) == [{"A": -2.5, "B": -0.1}] * 3
        assert got(readers.acquire(rows("p", "q"), "generate", {**options, "token_ids": {"A": 5, "B": 6, "C": 7}})) == [{"A": -5.0, "B": -6.0, "C": -7.0}] * 2
        assert got(readers.acquire(rows("json", "other", "none"), "chat", options)) == [{"B": 0.0}, {"C": 0.0}, {}]
        ask = lambda **q: json.dumps({"state": "s", "question": q})
        asked = [ask(type="noul"), ask(type="choice", criteria={"o1": "x", "o2": "y"}), ask(type="score", options=["low", "high"])]
        log = lambda **p: {k: math.log(max(v, 1e-12)) for k, v in p.items()}
        assert got(readers.acquire(rows(*asked), "schema", options)) == [log(A=0.25, B=0.75), log(A=0.1, B=0.9), log(A=0.0, B=1.0)]
        back = json.dumps({"state": "s", "question": {"type": "choice", "criteria": {"o1": "x", "o2": "y"}}, "letters": {"o1": "C", "o2": "A"}})
        assert got(readers.acquire(rows(back), "schema", options)) == [log(C=0.1, A=0.9)]
        bad = readers.acquire(rows(ask(type="choice", criteria={"o1": "x", "o3": "y"}), ask(type="choice", criteria=dict.fromkeys("abcd", "x"))), "schema", options, attempts=2, wait=0.0).orderBy("id").collect()
        assert [r["raw_logprobs"] for r in bad] == [None, None] and "o3" in bad[0]["error"] and all(r["error"] for r in bad)
        one = readers.acquire(rows("p"), "completion", options).first()
        assert one["first_token"] == " B" and one["top_tokens"] == [" B", "A", "B", "x"] and one["option_mass"] == pytest.approx(math.exp(-0.1) + math.exp(-2.5)) and one["prompt_tokens"] == 7
        said = readers.acquire(rows("other", json.dumps([{"role": "system", "content": "s"}, {"role": "user", "content": "json"}])), "chat", options).orderBy("id").collect()
        assert said[0]["content"].endswith("so C") and said[0]["finish_reason"] == "stop" and said[0]["prompt_tokens"] == 3 and said[1]["raw_logprobs"] == {}
        before = len(met)
        assert got(readers.acquire(rows(*"abcdefgh").coalesce(1), "completion", {**options, "workers": 1})) == [{"A": -2.5, "B": -0.1}] * 8
        assert len(met) == before + 1  # one connection for eight requests
        assert readers.acquire(rows("a", "bbb", "cc"), "uniform", {"letters": ["A"]}, budget=6).count() == 3
    finally:
        server.shutdown()
    down = readers.acquire(spark.createDataFrame([("1", "p")], "id string, prompt string"), "completion", {"url": "http://127.0.0.1:1", "letters": ["A"]}, attempts=2).first()
    assert down["raw_logprobs"] is None and down["error"]


def test_budget_batches():
    from verdikt.sources.clients import budget_batches

    assert budget_batches([5, 1, 3, 2, 9], 6) == [[1, 3], [2], [0], [4]]
    assert budget_batches([1] * 5, 100, 2) == [[0, 1], [2, 3], [4]] and budget_batches([], 5) == []


def test_transcript_segments_give_windows(spark, tmp_path):
    from verdikt.operators import series, text

    run = {"seg": "T1", "cond": "M0", "transcript": "a b", "segments": [{"start": 0.0, "end": 5.0, "text": "one two", "logprob": {"mean": -0.1, "min": -1.0, "n": 2, "n_low": 0}}, {"start": 5.0, "end": None, "text": "three"}, {"start": 9.0, "end": 10.0, "text": None}]}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "T1__M0.json").write_text(json.dumps(run, indent=1))
    (tmp_path / "r" / "T2__M0.json").write_text(json.dumps({**run, "seg": "T2", "segments": []}))
    x = files.transcript_segments(spark, str(tmp_path / "r"))
    assert [(r["at"], r["start"], r["end"], r["text"], r["logp_mean"]) for r in x.orderBy("at").collect()] == [(0, 0.0, 5.0, "one two", -0.1), (1, 5.0, 5.0, "three", None), (2, 9.0, 10.0, "", None)]
    w = series.greedy_windows(x.withColumn("n", F.size(text.tokens(F.col("text")))), ["seg", "cond"], ["at"], "start", "end", "n").orderBy("t0").collect()
    assert [(r["t0"], r["t1"], r["n_seg"]) for r in w] == [(0.0, 10.0, 3)]


MATRICES = {"z": np.arange(600, dtype=np.float32).reshape(200, 3) / 7, "one": np.arange(50), "deep": np.arange(48).reshape(4, 3, 4), "f": np.asfortranarray(np.arange(40.0).reshape(10, 4)), "ids": np.array(["a", "bé", "東"] * 5), "none": np.zeros((0, 3)), "flag": np.array([True, False])}


@pytest.mark.parametrize("packed", [False, True])
def test_matrices_are_read_by_ranges(spark, tmp_path, packed):
    from verdikt.sources.matrices import read_matrix

    path = str(tmp_path / "m.npz")
    (np.savez_compressed if packed else np.savez)(path, **MATRICES)
    for name, want in MATRICES.items():
        df = read_matrix(spark, path, name, task_bytes=240)
        got = {r["row"]: r["text"] if name == "ids" else r["vector"] for r in df.collect()}
        assert len(got) == len(want)
        assert all(got[i] == (str(x) if name == "ids" else np.asarray(x, float).ravel().tolist()) for i, x in enumerate(want))
    assert read_matrix(spark, path, "z", task_bytes=240).rdd.getNumPartitions() == (1 if packed else 10)
    assert files.matrix_rows(spark, path, "z").count() == 200
    with pytest.raises(Exception, match="no array"):
        read_matrix(spark, path, "missing")


def test_plain_arrays_and_objects(spark, tmp_path):
    from verdikt.sources.matrices import read_matrix

    np.save(tmp_path / "a.npy", MATRICES["z"])
    np.save(tmp_path / "b.npy", MATRICES["z"][:5])
    got = read_matrix(spark, [str(tmp_path / "a.npy"), str(tmp_path / "b.npy")], task_bytes=1000).groupBy("file").count().collect()
    assert {tuple(r) for r in got} == {("a.npy", 200), ("b.npy", 5)}
    np.savez(tmp_path / "o.npz", o=np.array([{}], object))
    with pytest.raises(Exception, match="aren't read"):
        read_matrix(spark, str(tmp_path / "o.npz"), "o")


ROW = "id string, x long"


def test_appends_are_committed_once_and_the_last_row_counts(spark, tmp_path):
    from verdikt.sources import appends as A

    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), ROW)
    assert A.read_appended(spark, path, ROW).count() == 0
    assert A.append(rows(("a", 1), ("b", 1)), path, "one") and not A.append(rows(("a", 9)), path, "one")
    assert A.append(rows(("a", 2), ("c", None), (None, 5)), path, "two")
    got = A.read_appended(spark, path, ROW)
    assert sorted((r["id"] or "", r["x"], r["commit"]) for r in got.where("x is not null").collect()) == [("", 5, 1), ("a", 1, 0), ("a", 2, 1), ("b", 1, 0)]
    assert {(r["id"], r["x"]) for r in A.last_committed(got).collect()} == {("a", 2), ("b", 1), ("c", None)}


def test_a_failed_job_shows_nothing_and_a_repeated_one_once(spark, tmp_path):
    from verdikt.sources import appends as A

    path, fails = str(tmp_path / "t"), F.udf(lambda x: 1 // (x - 3), "long")
    df = spark.range(8).select(F.col("id").cast("string").alias("id"), fails("id").alias("x"))
    with pytest.raises(Exception):
        A.append(df, path, "b")
    assert A.read_appended(spark, path, ROW).count() == 0
    assert A.append(df.where("id <> 3"), path, "b") and not A.append(df.where("id <> 3"), path, "b")
    assert A.read_appended(spark, path, ROW).count() == 7
    # two writers of one batch that raced: the first number counts, and numbers are never given twice
    log = A.Log(spark, path)
    df.where("id = 1").write.json(f"{path}/data/{'0' * 32}")
    assert log.add("b", "0" * 32) == 1 and log.add("c", "0" * 32) == 2
    assert [c["commit"] for c in log.commits()] == [0, 2] and A.read_appended(spark, path, ROW).count() == 8


def test_parts_go_on_where_a_job_stopped(spark, tmp_path):
    from verdikt.sources import appends as A

    path = str(tmp_path / "t")
    rows, made = spark.range(40).select(F.col("id").cast("string").alias("id")), []

    def make(df):
        made.append(1)
        if len(made) == 3:
            raise RuntimeError("stopped")
        return df.withColumn("x", F.lit(len(made)).cast("long"))

    with pytest.raises(RuntimeError):
        A.append_in_parts(rows, make, path, "job", 5)
    assert A.append_in_parts(rows, make, path, "job", 5) == 3 and A.append_in_parts(rows, make, path, "job", 5) == 0
    got = A.read_appended(spark, path, ROW)
    assert got.count() == 40 and got.select("commit").distinct().count() == 5


def test_stream_batches_are_appended_once(spark, tmp_path):
    from verdikt.sources import appends as A

    spark.range(6).select(F.col("id").cast("string").alias("id"), F.col("id").alias("x")).write.json(str(tmp_path / "in"))
    for again in range(2):  # the second run has lost its checkpoint and repeats batch 0
        q = spark.readStream.schema(ROW).json(str(tmp_path / "in")).writeStream.foreachBatch(A.append_batches(str(tmp_path / "t"), "s")).option("checkpointLocation", str(tmp_path / f"c{again}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert A.read_appended(spark, str(tmp_path / "t"), ROW).count() == 6
