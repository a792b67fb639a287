import hashlib

from verdikt.llm import line_windows

from .fixtures import frame


def brute(rows):
    rows = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, {}
    for d, t in rows:
        ls, gone = t.split("\n"), set()
        for i in range(len(ls) - 2):
            w = "\n".join(ls[i : i + 3])
            if w.strip(" \t\r\n") and seen.setdefault(w, (d, i)) != (d, i):
                gone.update((i, i + 1, i + 2))
        kept = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        out[d] = (len(ls), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_equals_brute_force(spark):
    common = "alpha\nbeta\ngamma\ndelta"
    rows = [(1, "x\n" + common + "\ny"), (2, common), (3, "p\nq\n" + common[:16] + "\nz\n" + common), (4, "a\na\na\na\na"), (5, None), (6, ""), (7, "\n\n\n\n"), (8, "one\ntwo"), (9, "alpha\nbeta"), (2, common), (10, "l\n" * 30_000), (None, "m\nn\no")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in line_windows.digest(line_windows.drop_repeated_lines(frame(spark, rows))).collect()}
    assert got == brute(rows)


def test_columns_pass_through(spark):
    df = frame(spark, [(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, None)], clash=True)
    out = line_windows.drop_repeated_lines(df)
    assert out.columns == [*df.columns, "lines_"]
    assert {r["lines"] for r in out.collect()} == {"x"}
    assert sorted((r["doc_id"], r["text"], r["starts"]) for r in out.collect() if r["text"] is not None) == [(1, "a\nb\nc", "x"), (2, "d", "x")]
    assert out.where("doc_id = 3").first()["text"] is None
    assert line_windows.drop_repeated_lines(frame(spark, [])).count() == 0


def test_stays_in_the_jvm(spark):
    plan = line_windows.drop_repeated_lines(frame(spark, [(1, "a\nb\nc")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
