"""Programs, exchange, calls, sources, plans and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessel.operators as t
from tessel.operators import Receive, RouteError, Send, from_numpy
from tessel.plans.catalogue import Tables, runge_kutta
from tessel.plans.inspect import operators, plan, shuffles
from tessel.plans.program import NameClashError, Placeholder, Program, SizeParam, distribute, merged, named, solve_lengths
from tessel.sources.tables import load, write
from tessel.streaming.arrays import run_on_batches, windowed_sums


def test_lengths():
    sizes = {}
    solve_lengths(("2*m+1", "3*n", 4), (7, 6, 4), sizes)
    assert sizes == {"m": 3, "n": 2}
    for declared, actual in [(("m",), (4,)), (("2*m+1",), (6,)), ((5,), (4,)), (("n-3",), (1, 2)), (("x*y",), (1,))]:
        with pytest.raises(ValueError):
            solve_lengths(declared, actual, sizes)


def test_program(spark):
    a, x = np.arange(15.0).reshape(3, 5), np.arange(5.0)
    p = Program(lambda A, x, n: {"y": A @ x, "z": t.zeros(x.spark, n) + x}, A=Placeholder(("m", "n")), x=Placeholder(("n",)), n=SizeParam("n"))
    A, X = from_numpy(spark, a), from_numpy(spark, x)
    found = p(A=A, x=X)
    assert {r.i0: r.v for r in found["y"].collect()} == dict(enumerate(a @ x))
    assert found["z"].count() == 5
    bound = p.bind(A=A)
    assert bound.arrays(x=X)["y"].shape == (3,)
    with pytest.raises(TypeError):
        bound(A=A, x=X)
    with pytest.raises(TypeError):
        p(A=A)
    with pytest.raises(TypeError):
        p(A=A, x=X.astype("f4"))
    with pytest.raises(ValueError):
        p(A=A, x=X[:4])
    with pytest.raises(TypeError):
        p(A=A, x=X, q=1)
    with pytest.raises(ValueError):
        Program(lambda: None, _in0=Placeholder((1,)))
    assert list(Program(lambda A: A + 1, A=Placeholder((3, 5)))(A=A)) == ["_out"]


def test_bundles(spark):
    a = from_numpy(spark, np.arange(4))
    assert merged(named(x=a), named(x=a, y=a)).keys() == {"x", "y"}
    with pytest.raises(NameClashError):
        merged(named(x=a), named(x=a + 1))
    got = distribute(lambda x: t.sum(x), [(a, 2), (a * a, 3)])
    assert got.collect() == 2 * 6 + 3 * 14


def test_routes(spark):
    u = np.arange(12).reshape(4, 3)
    a = from_numpy(spark, u)
    sends = [Send(0, 1, "x"), Send(2, 3, "x"), Send(1, 0, "y")]
    receives = [Receive(s.source, s.target, s.tag) for s in sends]
    got = t.exchange(a, t.verified_routes(spark, sends, receives, 4))
    np.testing.assert_array_equal(got[0].collect(), [[0] * 3, u[0], [0] * 3, u[2]])
    np.testing.assert_array_equal(got[1].collect(), [u[1], [0] * 3, [0] * 3, [0] * 3])
    np.testing.assert_array_equal(t.ring(a).collect(), np.roll(u, -1, 0))
    assert shuffles(t.ring(a)) == 0
    for bad in (sends + sends[:1], sends[1:], [*sends, Send(0, 9, "x")]):
        with pytest.raises(RouteError):
            t.verified_routes(spark, bad, receives, 4)
    with pytest.raises(NotImplementedError):
        t.verified_routes(spark, [Send(1, 1)], [Receive(1, 1)], 4)
    assert t.number_tags(sends, receives, base=5) == {"x": 5, "y": 6}


def test_calls(spark):
    u = np.arange(6.0).reshape(2, 3)
    a = from_numpy(spark, u)
    assert t.trace_call(lambda x, k: (x * k, x + k), a, k=2)[0].shape == (2, 3)
    with pytest.raises(TypeError):
        t.trace_call(lambda x: 3, a)
    out = t.call_kernel(
        lambda x, y: {"s": x.sum() + y, "d": np.outer(x, x)}, {"s": ((), "float64"), "d": ((3, 3), "float64")}, a, a[:, 0]
    )
    np.testing.assert_allclose(out["s"].collect(), u.sum(1) + u[:, 0])
    np.testing.assert_allclose(out["d"].collect(), np.einsum("ri,rj->rij", u, u))
    np.testing.assert_allclose(t.map_kernel(lambda x, y: x * y + 1, "float64", a, a[0]).collect(), u * u[0] + 1)


def test_sources(spark, tmp_path):
    u = np.arange(24.0).reshape(4, 6)
    write(from_numpy(spark, u), f"file://{tmp_path}/a", partition_by="i0")
    a = load(spark, f"file://{tmp_path}/a", (4, 6), "float64")
    np.testing.assert_array_equal(a.collect(), u)
    assert "PartitionFilters: [isnotnull(i0" in plan(a[2]).replace("\n", " ")


def test_plans(spark, sf_dir):
    s = Tables(spark, sf_dir)
    fused = operators(s.E * 2 + t.sqrt(abs(s.E)) - 1)
    assert not fused["Exchange"] and not any("Join" in k for k in fused)
    gram = operators(t.gram(s.read("embeddings"), "embedding", 64))
    assert gram["Exchange"] == 1 and not any("Join" in k for k in gram)
    assert "PushedFilters: [" in plan(s.bal[5:9]) and "c_custkey" in plan(s.bal[5:9])
    assert shuffles(t.stack([s.E, s.E], 0).T[::2]) == 0
    assert not any("Cartesian" in k for k in operators(s.Q + s.Q[0]))


def test_runge_kutta(spark):
    """The upwind steps against NumPy, and against the exact wave at their order."""
    def steps(f, u, dt, n):
        for _ in range(n):
            k1 = f(u)
            k2 = f(u + dt / 2 * k1)
            k3 = f(u + dt / 2 * k2)
            u = u + dt / 6 * (k1 + 2 * k2 + 2 * k3 + f(u + dt * k3))
        return u

    u = np.sin(np.arange(8) * np.pi / 4)
    got = runge_kutta(lambda x: t.roll(x, 1, 0) - x, from_numpy(spark, u), 0.1, 2).collect()
    np.testing.assert_allclose(got, steps(lambda x: np.roll(x, 1) - x, u, 0.1, 2), rtol=1e-12)


def test_batches(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 10 AS i0", "id AS v", "id DIV 50 AS part")
    rows.write.partitionBy("part").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("i0 bigint, v bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    program = Program(lambda x: t.sum(x), x=Placeholder((10,), "int64"))
    seen = {}

    def to_array(batch):
        return t.from_relation(batch.groupBy("i0").agg(F.sum("v").alias("v")), (10,), "int64")

    query = run_on_batches(stream, program, to_array, "x", lambda out, k: seen.__setitem__(k, out["_out"].first().v), f"{tmp_path}/c")
    query.awaitTermination(120)
    assert sum(seen.values()) == sum(range(100))


def test_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")
    sums = windowed_sums(stream, "ts", "1 hour", "1 day", {"i0": F.col("user_id")}, F.lit(1), "int64")
    query = sums.writeStream.format("memory").queryName("daily").option("checkpointLocation", f"{tmp_path}/w").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.start, r.i0): r.v for r in spark.table("daily").collect()}
    days = timed.groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("i0")).agg(F.count("*").alias("v"))
    # All the windows that the watermark has passed, and no other.
    passed = timed.agg(F.expr("max(ts) - INTERVAL 1 HOUR")).first()[0]
    want = {(r.w.start, r.i0): r.v for r in days.collect() if r.w.end <= passed}
    assert got == want and want


def test_index_lambdas(spark):
    u, w = np.arange(12).reshape(3, 4), np.array([5, -1, 2, 0])
    a, b = from_numpy(spark, u), from_numpy(spark, w)
    stencil = lambda i, j, x, y: F.coalesce(x(i - 1, j), F.lit(0)) * 10 + x(i, 3 - j) + y(j)
    got = t.make_index_lambda(spark, stencil, (3, 4), "int64", x=a, y=b)
    up = np.vstack([np.zeros((1, 4), int), u[:-1]])
    np.testing.assert_array_equal(got.collect(), up * 10 + u[:, ::-1] + w)
    np.testing.assert_array_equal(t.make_index_lambda(spark, lambda i: i * i, (5,), "float64").collect(), np.arange(5.0) ** 2)
    np.testing.assert_array_equal(t.make_index_lambda(spark, lambda i, x: x() + i, (2,), "int64", x=from_numpy(spark, np.int64(4))).collect(), [4, 5])
    with pytest.raises(ValueError):
        t.make_index_lambda(spark, lambda i, x: x(i), (3,), "int64", x=a)
    with pytest.raises(Exception):
        t.make_index_lambda(spark, lambda i, y: y(i), (9,), "int64", y=b).collect()


def test_reduction_tags(spark):
    a = from_numpy(spark, np.arange(6).reshape(2, 3))
    s = t.einsum("ij,ij->i", a, a, reductions={"j": ["x"]}).with_tagged_reduction("j", "y").tagged("z")
    assert s.reduction_tags == {"j": {"x", "y"}}
    assert s.relation().schema["v"].metadata == {"reductions": {"j": ["x", "y"]}, "tags": ["z"]}
    np.testing.assert_array_equal(s.collect(), (np.arange(6).reshape(2, 3) ** 2).sum(1))
    for bad in (lambda: t.einsum("ij->i", a, reductions={"i": ["x"]}), lambda: s.with_tagged_reduction("i", "x")):
        with pytest.raises(ValueError):
            bad()


def test_exact_kernels(spark):
    """Whole numbers beyond doubles, unsigned and complex ones, and lengths taken from an argument."""
    for u in (np.array([[1 << 62, 3], [-(1 << 62) + 1, 5]]), np.array([[(1 << 64) - 1, 1], [7, 1 << 63]], np.uint64), np.array([[1 + 2j, 3], [4, 5j]])):
        out = t.call_kernel(lambda x: {"r": x[::-1]}, {"r": (((0, 1),), u.dtype)}, from_numpy(spark, u))["r"]
        assert out.shape == (2, 2) and out.collect().tolist() == u[:, ::-1].tolist()


def test_whole_products(spark):
    u = np.array([[2, -3, 1] * 5, [3, 0, 1 << 40] * 5])
    a = from_numpy(spark, u)
    with np.errstate(all="ignore"):
        np.testing.assert_array_equal(t.prod(a, 1).collect(), [(-6) ** 5, 0])
        assert t.prod(from_numpy(spark, np.full((3, 50), 1, "i4"))).collect() == 1
        np.testing.assert_array_equal(t.prod(from_numpy(spark, np.full(100, 3, "u8"))).collect(), pow(3, 100, 1 << 64))
    with pytest.raises(Exception):
        t.prod(from_numpy(spark, np.full(100, 3))).collect()


def test_starts_over_several_runs(spark, monkeypatch):
    from tessel.operators import sparse

    monkeypatch.setattr(sparse, "_RUN", 3)
    rows = spark.range(40).selectExpr("(id * 7) % 11 AS i0", "id AS i1", "id AS v")
    entries, starts = t.to_csr(t.from_coordinates(rows, (11, 40), "int64"))
    got = [r.start for r in starts.orderBy("row").collect()]
    counts = np.bincount([(k * 7) % 11 for k in range(40)])
    assert got == (np.cumsum(counts) - counts).tolist() and entries.count() == 40


def test_checked_keys(spark):
    from tessel.sources.tables import vector

    rows = spark.createDataFrame([(0, 1.0), (2, 2.0)], "k int, x double")
    assert vector(rows, "k", "x", "float64").shape == (2,)
    with pytest.raises(ValueError):
        vector(rows, "k", "x", "float64", check=True)
