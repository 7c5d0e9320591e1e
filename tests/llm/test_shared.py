import numpy as np
import pyarrow as pa

from kindred.llm import queries, shared


def test_runs_keep_groups_whole():
    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 60, 1000))
    value = np.arange(1000)
    cut = sorted(rng.integers(0, 1000, 40).tolist())
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(value[a:b])], names=["k", "v"]) for a, b in zip([0, *cut], [*cut, 1000], strict=True)]
    seen = []
    for t, bounds in shared.runs(iter(batches), ["k"], 50):
        k = t.column("k").to_numpy()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            assert len(set(k[a:b].tolist())) == 1
            seen.append((int(k[a]), t.column("v").to_numpy()[a:b].tolist()))
    assert [k for k, _ in seen] == sorted(set(key.tolist()))
    assert [v for _, vs in seen for v in vs] == value.tolist()
    assert list(shared.runs(iter([]), ["k"], 5)) == []


def test_local_stars():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert shared.local_stars(linked).tolist() == [0, 1, 1, 0, 4, 0]


def test_native_queries_run_no_python(spark):
    for name in ("op7_secrets", "op8_mixing", "op2_chat"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_scans_read_only_what_is_asked_for(spark):
    plan = queries.op3_packing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_forget(spark):
    df = shared.stored(spark.range(3), "t")
    assert df.count() == 3 and shared.forget(spark) >= 1 and shared.forget(spark) == 0
