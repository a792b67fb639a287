"""How often a plan reads its input: rows that are dear to make must not be made once for each branch."""

import pytest
from pyspark.sql import functions as F

from verdikt.operators import metrics as M


def stored(spark, tmp_path, df):
    path = str(tmp_path / "rows")
    df.write.parquet(path)
    return spark.read.parquet(path)


def reads(df, tmp_path):
    """Files of the stored rows that the plan of a result still reads."""
    return [f for f in df.inputFiles() if f"{tmp_path}/rows" in f]


def test_kappa_reads_rows_once(spark, tmp_path):
    rows = stored(spark, tmp_path, spark.range(40).select(F.lit("x").alias("t"), (F.col("id") % 2).alias("a"), (F.col("id") % 4 % 3).alias("b")))
    got = M.kappa(rows, ["t"], "a", "b")
    assert not reads(got, tmp_path)  # nothing but its counts
    assert abs(got.first()["agreement"] - 0.5) < 1e-12


def test_ordinal_ranks_read_rows_once(spark, tmp_path):
    from verdikt.operators import running

    rows = stored(spark, tmp_path, spark.range(300).select(F.lit("x").alias("t"), F.col("id").cast("string").alias("id"), (F.col("id") % 7 / 7.0).alias("s")))
    got = running.ordinal_ranks(rows, ["t"], "s", "id", "k", running.unit_bucket("s"))
    assert not reads(got, tmp_path)  # nothing but its sorted rows
    assert sorted(r["k"] for r in got.collect()) == list(range(1, 301))
    assert running.ordinal_ranks(rows.withColumn("s", F.when(F.col("id") != "0", F.col("s"))), ["t"], "s", "id", "k").count() == 299


def test_order_statistics_read_rows_once(spark, tmp_path):
    from verdikt.operators import running

    rows = stored(spark, tmp_path, spark.range(100).select(F.lit("x").alias("t"), F.when(F.col("id") > 0, F.col("id") % 10 / 10.0).alias("s")))
    got = running.order_statistics(rows, ["t"], "s", {"first": F.lit(1), "last": F.col("n"), "beyond": F.col("n") + 1}, running.unit_bucket("s"))
    assert not reads(got, tmp_path)  # nothing but its counted values
    assert tuple(got.first()) == ("x", 0.0, 0.9, None)


def test_guardrail_gathers_items_once(spark, tmp_path):
    from verdikt.operators import arms

    rows = spark.range(60).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("arm"), F.lit("x").alias("task"), F.floor(F.col("id") / 2).cast("string").alias("id"), F.lit(1).alias("chosen"), (F.col("id") % 3 > 0).alias("correct"), (F.col("id") / 60.0).alias("conf"))
    got = arms.guardrail(stored(spark, tmp_path, rows), ["task"], "A", "B")
    assert not reads(got, tmp_path)  # nothing but its vectors
    assert got.first()["n"] == 30


def test_text_weights_take_a_row_once(spark):
    from verdikt.operators import sparse

    text = " ".join(f"w{i}x" for i in range(40))
    counts = sparse.gram_counts(spark.createDataFrame([(1, text), (2, "w1x w2x")], "id int, text string"), "id", "text")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1  # texts are dealt, not their n-grams
    got = sparse.weights(counts, sparse.vocabulary(counts, 2))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan.lower().replace("aggregate [", "")  # no sum inside the entries' lambda
    for r in got.collect():
        assert abs(sum(e["v"] ** 2 for e in r["entries"]) - 1.0) < 1e-12


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_and_rotations_stay_in_their_row(spark, data):
    from verdikt.plans import registry

    for name in ("f22_all_orders", "p18_rotations", "p19_permutations"):
        plan = optimized(registry.queries()[name](spark, data))
        assert "Generate" not in plan and "transform(" not in plan  # no row a rotation or order, and no lambda over options


def test_readouts_are_made_once(spark, data):
    from verdikt.plans import registry

    assert optimized(registry.queries()["u05_probability_keys"](spark, data)).count("md5(") == 3  # one a letter


def test_softmax_binds_its_steps(spark):
    from verdikt.functions import expr as E

    z = F.array(*(F.col("id") * j for j in range(1, 4)))
    for f in (E.softmax, E.log_softmax):
        assert optimized(spark.range(3).select(f(z).alias("p"))).count("* 3)") == 1


def test_calibration_counts_equal_rows(spark):
    from verdikt.operators import calibrate as C

    rows = [("t", f"{i}", f"g{i % 11}", i % 3 if i % 5 else 0, [float(i % 3 == 0) * 2, float(i % 2), 0.5], i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "task string, id string, group_id string, gold int, logits array<double>, fold int").repartition(4)
    methods = ("temperature", "vector", "isotonic")
    x = C.equal_rows(df)
    assert x.count() < 110 and x.agg(F.sum("n")).first()[0] == 240  # work grows with the different rows
    many = {(r["method"], r["gold"], tuple(round(v, 6) for v in r["p"])) for r in C.cross_validated(df, methods).collect()}
    got = C.cross_validated_counts(df, methods).collect()
    assert {(r["method"], r["gold"], tuple(round(v, 6) for v in r["p"])) for r in got} == many and sum(r["n"] for r in got) == 240 * len(methods)
    own = C.fit_folds(df, methods)
    for f in (0, 1):  # against fits of all rows one by one
        rest = [r for r in rows if r[5] != f]
        want = C.vector_scaling(C.log_probs([r[4] for r in rest]), C.np.array([r[3] for r in rest]))
        p = C._softmax(C.log_probs([rows[0][4]]) @ want[0].T + want[1])[0]
        assert abs(C.apply_method(own["t", "vector", f], [rows[0][4]])[0] - p).max() < 1e-3


def test_learning_curve_orders_few_groups(spark):
    from verdikt.operators import calibrate as C

    rows = spark.range(3000).select(F.lit("t").alias("task"), F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("group_id"), (F.col("id") % 2).cast("int").alias("gold"), F.array(F.col("id") % 3 / 1.0, F.lit(0.5)).alias("logits"))
    got = C.learning_curve(rows, [8], 2, hold=5, methods=("temperature",))
    assert "Join" in optimized(got) and "row_number" not in optimized(got) and "broadcast" in optimized(got)  # chosen groups are few and written
    assert {(r["rep"], r["size"]) for r in got.collect()} == {(0, 8), (1, 8)}


def test_unit_buckets_part_values_near_the_ends(spark):
    from verdikt.operators import running

    x = spark.range(20001).select((F.col("id") / 20000.0).alias("v")).union(spark.range(1, 1001).select(1.0 - F.exp(-F.col("id") / 40.0)))
    got = x.select("v", running.unit_bucket("v").alias("b")).orderBy("v").collect()
    assert all(a["b"] <= b["b"] for a, b in zip(got, got[1:])) and len({r["b"] for r in got}) < 4000  # monotone
    assert len({r["b"] for r in got if r["v"] > 0.999}) > 100  # they were two


def test_paired_report_counts_items_before_scopes(spark):
    from verdikt.operators import compare as K

    made = [(arm, i, "tu"[i % 2], (i * (3 + k) + j) % 5 > 1) for i in range(40) for k, arm in enumerate("AB") for j in range(1 + (i % 7 == 0))]
    rows = spark.createDataFrame([*made, ("A", None, "t", True), ("B", None, "t", True)], "arm string, id int, task string, correct boolean")
    got = K.paired_report(rows, [("A", "B")], ["id", "task"], {"all": (F.lit(True), F.lit("")), "task": (F.lit(True), F.col("task")), "few": (F.col("id") < 9, F.lit(""))})
    plan = optimized(got)
    assert 0 < plan.index("Generate") < plan.index("AS _items")  # what is multiplied by scopes and pairs has been counted
    want = {}
    for a, i, t, x in made:
        for b, j, u, y in made:
            if (a, b) == ("A", "B") and (i, t) == (j, u):  # repeated rows meet as in a join, null keys don't
                for scope in [("all", ""), ("task", t)] + [("few", "")] * (i < 9):
                    want.setdefault(scope, []).append((x, y))
    assert {(r["scope"], r["part"]): (r["n"], round(r["acc_a"], 9), round(r["acc_b"], 9)) for r in got.collect()} == {s: (len(v), round(sum(x for x, _ in v) / len(v), 9), round(sum(y for _, y in v) / len(v), 9)) for s, v in want.items()}


def test_group_split_compares_rows_with_a_cut(spark, tmp_path):
    import hashlib

    from verdikt.operators import split as S

    made = [(t, None if t == "u" and g == 3 else f"{t}{g}", i) for t, n in (("t", 400), ("u", 7), ("v", 1)) for g in range(n) for i in range(1 + g % 3)]
    rows = stored(spark, tmp_path, spark.createDataFrame([*made, (None, "t1", 0)], "task string, group_id string, i int"))
    got = S.group_split(rows)
    assert optimized(got).count("Relation") == 2  # the rows and the cuts: no table of keys is joined to the rows
    want = {}
    for t in "tuv":
        keys = sorted({g for x, g, _ in made if x == t}, key=lambda g: (g is None, hashlib.md5(f"{g}:0".encode()).hexdigest(), g))
        want |= {(t, g): g is not None and k < len(keys) // 2 for k, g in enumerate(keys)}
    assert sorted(map(str, got.collect())) == sorted(map(str, [*(S_row(t, g, i, want[t, g]) for t, g, i in made), S_row(None, "t1", 0, False)]))


def S_row(task, group_id, i, cal):
    from pyspark.sql import Row

    return Row(task=task, group_id=group_id, i=i, cal=cal)


def test_parted_rows(spark):
    from verdikt.operators.running import parted

    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), (None, 2), (None, 2), ("c", 3)], "k string, n int")
    once, again = parted(rows, ["k", "n"])
    assert sorted(r["k"] for r in once.collect()) == ["a", "c"]
    assert sorted(map(str, (r["k"] for r in again.collect()))) == ["None", "None", "b", "b"]
    assert parted(once, ["k", "n"])[1] is None


def test_two_stage_with_repeated_items(spark, data, tmp_path):
    import duckdb

    from verdikt.plans import policies

    from .compare import table

    path = f"{tmp_path}/lineitem.parquet"
    duckdb.sql(f"copy (select * from '{data}/lineitem.parquet' union all select * from '{data}/lineitem.parquet' where l_partkey % 5 = 0) to '{path}' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{path}'")
    query, sql = policies.QUERIES["c17_two_stage"]
    assert table(query(spark, str(tmp_path)).toPandas()) == table(con.sql(sql).df())


def test_rendering_pairs_with_repeated_items(spark, data, tmp_path):
    import duckdb

    from verdikt.plans import comparison

    from .compare import table

    path = f"{tmp_path}/lineitem.parquet"
    duckdb.sql(f"copy (select * from '{data}/lineitem.parquet' union all select * from '{data}/lineitem.parquet' where l_partkey % 5 = 0 union all select * replace (null::varchar as l_returnflag) from '{data}/lineitem.parquet' where l_partkey % 9 = 0) to '{path}' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{path}'")
    query, sql = comparison.QUERIES["x25_rendering_pairs"]
    got = query(spark, str(tmp_path))
    assert "Generate" not in optimized(got).split("AS _items")[-1]  # renderings stay in an item's row
    assert table(got.toPandas()) == table(con.sql(sql).df())


def test_gate_keeps_an_items_arms_in_its_row(spark, data):
    from verdikt.operators import gate
    from verdikt.plans import comparison

    plan = optimized(comparison._gate_rows(spark, data))
    assert "Aggregate" not in plan and "Union" not in plan  # no row an arm, and none is gathered by its keys
    rows = spark.createDataFrame([("t", None if i % 3 else "N", i % 5 / 5.0, i % 2 == 0) for i in range(60)], "task string, flag string, s double, y boolean")
    got = gate.areas(rows, ["task"], ["s"], ["y"], "flag")
    assert {(r["whole"], r["condition"], r["n"]) for r in got.collect()} == {(True, None, 60), (False, None, 40), (False, "N", 20)}


@pytest.mark.parametrize("name", ["x21_speed_rules", "x25_rendering_table"])
def test_renderings_stay_in_their_row(spark, data, name, monkeypatch):
    from verdikt.operators import running
    from verdikt.plans import comparison, registry

    written = []
    for module in (running, comparison):
        monkeypatch.setattr(module, "settled", lambda df, what, f=running.settled: written.append(df.columns) or f(df, what))
    registry.queries()[name](spark, data)
    assert written and not any("arm" in columns or "z0" in columns for columns in written)  # latencies once, and no row a rendering


def test_percentiles_of_images(spark):
    from verdikt.operators import running

    df = spark.createDataFrame([("x", float(i)) for i in range(10)] + [("x", None)], "g string, v double")
    got = running.percentiles(df, ["g"], "v", {"p50": 0.5, "p9": 0.9}, images={"a": lambda c: c + 1.0, "b": lambda c: c / 2.0})
    assert got.columns == ["g", "p50_a", "p50_b", "p9_a", "p9_b"]
    assert tuple(round(v, 9) for v in got.first()[1:]) == (5.5, 2.25, 9.1, 4.05)


def test_noise_is_made_once(spark, data):
    from verdikt.plans import registry

    plan = optimized(registry.queries()["g03_renderings"](spark, data))
    assert plan.count("md5(") == 2  # the keys' digests and that of their number
    assert "lambdafunction(if" not in plan.replace(" ", "").lower() and "array_sort(" not in plan.lower()  # no comparison by a lambda


def test_sorted_auroc_shares_ties(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i * 7 % 11 / 11.0 if i % 13 else None, i % 4 == 0) for i in range(200)] + [("c", 0.5, True)], "g string, s double, y boolean").repartition(5)
    got, want = (sorted((r["g"], r["auroc"] and round(r["auroc"], 12)) for r in f(rows.where("s is not null"), ["g"], "s", F.col("y")).collect()) for f in (M.sorted_auroc, M.auroc))
    assert got == want and got[2] == ("c", None)


def test_glossary_arms_sort_rows_three_times(spark, data, monkeypatch):
    from verdikt.operators import running
    from verdikt.plans import construction, registry

    written = []
    for module in (running, construction):
        monkeypatch.setattr(module, "settled", lambda df, what, f=running.settled: written.append((what, df.columns)) or f(df, what))
    registry.queries()["x24_glossary_arms"](spark, data)
    assert [what for what, _ in written].count("numbered") == 3  # by A's score, by B's, and by B's among the likeliest wrong
    assert not any("id" in columns for _, columns in written)
