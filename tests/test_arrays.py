"""Every operator against NumPy on small arrays: values, shapes, element types and density."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessel.operators as t
from tessel.functions.dtypes import item, spark_type
from tessel.operators import from_numpy
from tessel.plans.inspect import operators, shuffles


def check(a, want, rtol=1e-7):
    want = np.asarray(want)
    assert a.shape == want.shape and a.dtype == want.dtype, (a, want.shape, want.dtype)
    rows = a.relation().collect()
    assert len(rows) == want.size and len({tuple(r)[:-1] for r in rows}) == want.size  # dense, distinct
    assert all(r.v is not None for r in rows)
    np.testing.assert_allclose(a.collect(), want, rtol=rtol, atol=1e-12)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    named = {
        "f": rng.normal(size=(3, 4)),
        "g": rng.normal(size=(3, 4)).astype("f4"),
        "i": rng.integers(-9, 10, (3, 4)),
        "j": rng.integers(1, 5, (3, 4)),
        "b": rng.integers(0, 2, (3, 4)).astype(bool),
        "c": rng.normal(size=(3, 4)) + 1j * rng.normal(size=(3, 4)),
        "row": rng.normal(size=(4,)),
        "col": rng.integers(-3, 4, (3, 1)),
        "s": np.array(2.5),
        "cube": rng.integers(0, 50, (2, 3, 4)),
        "nan": np.array([[1.0, np.nan, -0.5, 0.0], [np.nan, np.nan, 2.0, 3.0], [np.inf, -np.inf, 5.0, -6.0]]),
    }
    return {k: (from_numpy(spark, v), v) for k, v in named.items()}


BINARY = ["+", "-", "*", "/"]


@pytest.mark.parametrize("op", BINARY)
@pytest.mark.parametrize("x,y", [("f", "f"), ("f", "g"), ("i", "j"), ("f", "row"), ("i", "col"), ("f", "s"), ("c", "f"), ("c", "c"), ("g", "g")])
def test_arithmetic(data, op, x, y):
    (a, u), (b, v) = data[x], data[y]
    check(eval(f"a {op} b"), eval(f"u {op} v"))


def test_integer_division(data, spark):
    a = np.arange(-7, 8)
    for b in (-3, -2, -1, 1, 2, 3):
        check(from_numpy(spark, a) // b, a // b)
        check(from_numpy(spark, a) % b, a % b)
    f = np.array([-7.5, -1.0, 0.0, 2.5, np.nan, np.inf])
    check(from_numpy(spark, f) // 2.0, f // 2.0)
    with np.errstate(all="ignore"):
        check(from_numpy(spark, f) % -2.0, f % -2.0)
        check(from_numpy(spark, f) / 0.0, f / 0.0)
        check(1.0 / from_numpy(spark, f), 1.0 / f)


TYPES = "bhilqBHILQfdFD"


def pair_of(rng, x, y):
    """Two arrays of these types whose operators raise nothing: signed results stay small."""
    out = []
    for c in (x, y):
        dtype = np.dtype(c)
        u = rng.integers(1 if dtype.kind == "u" else -9, 11, 12)
        if dtype.kind == "u" and dtype.itemsize * 8 > 8:
            u = u + np.where(np.arange(12) % 3 == 0, np.iinfo(dtype).max // 3 if np.dtype(y).kind == "u" == np.dtype(x).kind else 0, 0).astype(dtype)
        u = u.astype(dtype)
        out.append(u + (rng.integers(-3, 4, 12) * 1j).astype(dtype) if dtype.kind == "c" else u)
    out[1] = np.where(out[1] == 0, np.ones(1, out[1].dtype), out[1])
    return out


@pytest.mark.parametrize("x", TYPES)
def test_arithmetic_of_all_types(spark, x):
    """Operators over pairs of element types, all in one frame, against NumPy: values and result types."""
    rng = np.random.default_rng(ord(x))
    others = [TYPES[(TYPES.index(x) + k) % len(TYPES)] for k in (0, 1, 3, 6, 10)]  # over all x, both orders of most pairs
    pairs = [pair_of(rng, x, y) for y in others]
    columns = [w for p in pairs for w in p]
    cell = lambda c, d: (c.real.item(), c.imag.item()) if d.kind == "c" else item(c, d)
    schema = ", ".join(["i0 bigint", *[f"x{k} {spark_type(w.dtype)}" for k, w in enumerate(columns)]])
    df = spark.createDataFrame([(k, *[cell(w[k], w.dtype) for w in columns]) for k in range(12)], schema).coalesce(1)
    arrays = [t.Array(df, (12,), w.dtype, F.col(f"x{k}")) for k, w in enumerate(columns)]
    wants, gots = {}, []
    with np.errstate(all="ignore"):
        for k, (y, (u, v)) in enumerate(zip(others, pairs)):
            a, b = arrays[2 * k : 2 * k + 2]
            kinds = {u.dtype.kind, v.dtype.kind}
            ops = ["+", "-", "*", "/"] + ([] if "c" in kinds else ["//", "%"])
            ops += ["&", "|", "^"] if kinds <= set("iu") and np.result_type(u, v).kind != "f" else []
            for op in ops:
                want, got = eval(f"u {op} v"), eval(f"a {op} b")
                assert got.dtype == want.dtype, (x, y, op)
                wants[f"{y} {op}"] = want
                gots.append(got.value.alias(f"{y} {op}"))
    rows = sorted(df.select("i0", *gots).collect(), key=lambda r: r.i0)
    for name, want in wants.items():
        got = [r[name] for r in rows]
        if want.dtype.kind in "iu":
            assert list(map(int, got)) == list(map(int, want)), (x, name)
        else:
            got = [complex(c["re"], c["im"]) for c in got] if want.dtype.kind == "c" else got
            np.testing.assert_allclose(got, want, rtol=1e-5 if want.real.dtype == np.float32 else 1e-12, err_msg=f"{x} {name}")


@pytest.mark.parametrize("x", "BHILQ")
def test_unsigned_numbers_wrap(spark, x):
    top = np.iinfo(np.dtype(x)).max
    u = np.array([0, 1, 2, 200, top // 2, top - 1, top], np.dtype(x) if x != "B" else np.uint8)
    a = from_numpy(spark, u)
    with np.errstate(all="ignore"):
        for got, want in [(a + a, u + u), (a - u.dtype.type(3), u - u.dtype.type(3)), (a * a, u * u), (-a, -u), (a**3, u**3), (a // 7, u // 7), (a % 7, u % 7), (a & 6, u & 6), (a ^ a, u ^ u)]:
            rows = sorted(got.relation().collect())
            assert got.dtype == want.dtype and [int(r.v) for r in rows] == [int(c) for c in want]
        assert [int(r.v) for r in sorted((a**a).relation().collect())] == [pow(int(c), int(c), int(top) + 1) for c in u]
    assert [int(r.v) for r in sorted(from_numpy(spark, np.array([-1, 5])).astype(x).relation().collect())] == [top, 5]


def test_exact_division(spark):
    """Remainders and floors as IEEE has them, with scalars on either side."""
    inf, nan = math.inf, math.nan
    u = np.array([1e-20, -1e-20, -1e-17, 1.0, 5.0, -5.0, 7.5, 0.0, -0.0, inf, -inf, nan, 1e300, -1e300, 4503599627370497.0])
    a = from_numpy(spark, u)
    with np.errstate(all="ignore"):
        for b in (1.0, 0.1, -0.1, 3.0, -3.0, inf, -inf, 0.0, nan, 1e-3):
            for got, want in [(a % b, u % b), (a // b, u // b), (b % a, b % u), (b // a, b // u)]:
                np.testing.assert_array_equal(got.collect(), want)
    big = np.array([1 << 62, -(1 << 62), (1 << 63) - 1, 5])
    c = from_numpy(spark, big)
    for b in ((1 << 62) - 1, -(1 << 62) + 5, 3):
        check(c % b, big % b)
        check(c // b, big // b)
    z = np.array([3 + 4j, 1e200 + 1e200j, 1 - 1j])
    for w in (1e200 + 1e200j, 2j, 3.0, 1e-200 - 1e-200j):
        np.testing.assert_allclose((from_numpy(spark, z[::2]) / w).collect(), z[::2] / w, rtol=1e-12)
    for bad in (lambda: from_numpy(spark, z) // 2, lambda: from_numpy(spark, z) % 2):
        with pytest.raises(TypeError):
            bad()


def test_exact_powers(spark):
    u = np.array([3037000499, 94906267, -3, 0, 1, -1])
    a = from_numpy(spark, u)
    check(a**2, u**2)
    check(a**0, u**0)
    e = np.array([2, 2, 39, 0, 100, 101])
    check(a ** from_numpy(spark, e), u**e)
    check(2 ** from_numpy(spark, np.arange(62)), 2 ** np.arange(62))
    check(a**0.0, u**0.0)
    with pytest.raises(ValueError):
        a**-1
    for bad in (a**3, a ** from_numpy(spark, -e)):
        with pytest.raises(Exception):
            bad.collect()


def test_scalars_and_reversed(data):
    a, u = data["i"]
    f, w = data["f"]
    check(3 - a, 3 - u)
    check(2 * f + f * f - 1, 2 * w + w * w - 1)
    check(a**2, u**2)
    check(2.0 ** data["row"][0], 2.0 ** data["row"][1])
    check(-a, -u)
    check(+a, u)
    check(abs(a), abs(u))
    assert (a + 1).df is a.df  # fused: no join, no new frame
    assert operators(2 * f + f * f)["Exchange"] == 0


def test_bitwise_and_logic(data):
    (a, u), (b, v), (p, q) = data["i"], data["j"], data["b"]
    check(a & b, u & v)
    check(a | b, u | v)
    check(a ^ 6, u ^ 6)
    check(p ^ t.greater(a, 0), q ^ (u > 0))
    check(t.logical_and(a, p), np.logical_and(u, q))
    check(t.logical_or(a, p), np.logical_or(u, q))
    check(t.logical_not(a), np.logical_not(u))
    check(p & t.less(a, 0), q & (u < 0))
    check(p ^ t.less(a, 0), q ^ (u < 0))
    with pytest.raises(TypeError):
        p - p
    with pytest.raises(TypeError):
        data["f"][0] & 1


@pytest.mark.parametrize("name", ["equal", "not_equal", "less", "less_equal", "greater", "greater_equal", "maximum", "minimum"])
def test_comparison(data, name):
    (a, u), (b, v) = data["nan"], data["f"]
    check(getattr(t, name)(a, b), getattr(np, name)(u, v))
    check(getattr(t, name)(a, a), getattr(np, name)(u, u))
    check(getattr(t, name)(data["i"][0], 2), getattr(np, name)(data["i"][1], 2))


def test_where(data):
    (a, u), (p, q), (r, w) = data["f"], data["b"], data["row"]
    check(t.where(p, a, r), np.where(q, u, w))
    check(t.where(t.greater(a, 0), 1, 0.5), np.where(u > 0, 1, 0.5))
    assert t.where(True, 1, 2) == 1
    with pytest.raises(NotImplementedError):
        t.where(p)


REAL = ["sqrt", "exp", "log", "log10", "sin", "cos", "tan", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "abs"]


@pytest.mark.parametrize("name", REAL)
def test_functions(data, name):
    with np.errstate(all="ignore"):
        for x in ("f", "g", "nan"):
            a, u = data[x]
            want = getattr(np, name)(u)
            got = getattr(t, name)(a)
            assert got.dtype == want.dtype
            np.testing.assert_allclose(got.collect(), want, rtol=1e-6)
        if name not in ("log10", "arcsin", "arccos", "arctan"):
            check(getattr(t, name)(data["c"][0]), getattr(np, name)(data["c"][1]), 1e-6)
    if name != "abs":
        with pytest.raises(ValueError):
            getattr(t, name)(data["i"][0])


def test_other_functions(data):
    (a, u), (c, w), (n, m) = data["f"], data["c"], data["nan"]
    check(t.arctan2(a, a + 1), np.arctan2(u, u + 1))
    check(t.isnan(n), np.isnan(m).astype("i4"))
    check(c.real, w.real)
    check(c.imag, w.imag)
    check(c.conj(), w.conj())
    check(a.imag, np.zeros_like(u))
    check(a.conj(), u)
    check(data["i"][0].astype("f4"), data["i"][1].astype("f4"))
    check(data["b"][0].astype("i4"), data["b"][1].astype("i4"))
    check(a.astype("c16"), u.astype("c16"))
    with pytest.raises(NotImplementedError):
        a.astype(int)


def test_generators(spark, data):
    check(t.full(spark, (2, 3), 7), np.full((2, 3), 7))
    check(t.zeros(spark, 4), np.zeros(4))
    check(t.ones(spark, (2, 2), "i4"), np.ones((2, 2), "i4"))
    check(t.full(spark, (), 1.5), np.full((), 1.5))
    check(t.zeros(spark, (0, 3)), np.zeros((0, 3)))
    for n, m, k in itertools.product((3, 4), (2, 6, None), (-2, 0, 1)):
        check(t.eye(spark, n, m, k), np.eye(n, m, k))
    for args in [(5,), (2, 9), (9, 2, -3), (1, 1), (0, 10, 3)]:
        check(t.arange(spark, *args, dtype="i8"), np.arange(*args, dtype="i8"))
    check(t.arange(spark, 0.5, 3, 0.25, dtype="f8"), np.arange(0.5, 3, 0.25))
    check(t.zeros_like(data["i"][0]), np.zeros_like(data["i"][1]))
    check(t.ones_like(data["f"][0], "f4"), np.ones((3, 4), "f4"))
    for bad in (lambda: t.arange(spark, dtype="i8"), lambda: t.eye(spark, -1), lambda: t.full(spark, -2, 1), lambda: t.full(spark, 2, 1, order="F")):
        with pytest.raises((TypeError, ValueError)):
            bad()


REDUCTIONS = ["sum", "prod", "amax", "amin"]


@pytest.mark.parametrize("name", REDUCTIONS)
@pytest.mark.parametrize("axis", [None, 0, 1, (0, 2)])
def test_reductions(data, name, axis):
    a, u = data["cube"]
    if name == "prod":
        a, u = a % 5 + 1, u % 5 + 1
    check(getattr(t, name)(a, axis), getattr(np, name)(u, axis=axis))
    if axis != (0, 2):
        f, w = data["nan"]
        got = getattr(t, name)(f, axis).collect()
        with np.errstate(all="ignore"):
            np.testing.assert_allclose(got, getattr(np, name)(w, axis=axis))


def test_other_reductions(spark, data):
    b, u = data["b"]
    check(b.all(), u.all())
    check(b.any(1), u.any(1))
    check(t.sum(data["c"][0], 0), data["c"][1].sum(0))
    check(t.sum(data["g"][0], 1), data["g"][1].sum(1), 1e-5)
    empty = t.zeros(spark, (0, 3))
    check(t.sum(empty, 0), np.zeros(3))
    check(t.prod(empty), np.ones(()))
    check(t.amax(empty, 0, initial=-math.inf), np.full(3, -np.inf))
    check(t.sum(empty, 1), np.zeros(0))
    for bad in (lambda: t.amax(empty, 0), lambda: t.sum(b, -1), lambda: t.sum(data["f"][0], initial=3)):
        with pytest.raises(ValueError):
            bad()
    assert shuffles(t.sum(data["f"][0], 0)) == 1


def test_indexing(data):
    a, u = data["cube"]
    for k in [1, -1, (0, 2), (slice(None), slice(None, None, -1)), (..., slice(1, 10, 2)), (1, ..., -1), slice(5, 2), (0, slice(3, 0, -2), slice(-3, -1)), (slice(None, None, 2), 1, 3)]:
        check(a[k], u[k])
    for bad in (5, (0, 0, 0, 0), (..., ..., 0), (0, 3)):
        with pytest.raises(IndexError):
            a[bad]
    with pytest.raises(NotImplementedError):
        a[None]


def test_gather(spark, data):
    a, u = data["cube"]
    x, y = np.array([[-1], [1], [0]]), np.array([0, 2])
    s = slice(None)
    for k in [(s, x), (s, x, y), (x % 2, s, y), (s, 1, y), (1, s, y), (x % 2, y), (slice(None, None, -1), s, y), (0, x, slice(1, 3))]:
        check(a[k], u[k])
    lazy = tuple(from_numpy(spark, z) if isinstance(z, np.ndarray) else z for z in (s, x, y))
    check(a[lazy], u[:, x, y])
    check(a[np.zeros((0,), int)], u[np.zeros((0,), int)])
    with pytest.raises(IndexError):
        a[data["f"][0]]
    with pytest.raises(IndexError):
        t.checked_gather(a, from_numpy(spark, np.array([0, 7])))
    check(t.checked_gather(a, from_numpy(spark, np.array([0, -2]))), u[[0, -2]])


def test_reshaping(spark, data):
    a, u = data["cube"]
    for order, shape in itertools.product("CF", [(24,), (4, 6), (-1, 2), (3, -1, 2, 1), (24, 1)]):
        check(t.reshape(a, shape, order), u.reshape(shape, order=order))
    check(data["s"][0].reshape(1, 1), data["s"][1].reshape(1, 1))
    check(a[0:1, 0:1, 0:1].reshape(()), u[:1, :1, :1].reshape(()))
    check(t.zeros(spark, (1, 0, 2)).reshape(5, 3, 0), np.zeros((5, 3, 0)))
    for axes in itertools.permutations(range(3)):
        check(t.transpose(a, axes), u.transpose(axes))
    check(a.T, u.T)
    for shift, axis in itertools.product((-20, -1, 0, 1, 20), range(3)):
        check(t.roll(a, shift, axis), np.roll(u, shift, axis))
    check(t.expand_dims(a, (0, -1)), np.expand_dims(u, (0, -1)))
    check(t.squeeze(data["col"][0]), data["col"][1].squeeze())
    check(t.squeeze(t.expand_dims(a, 1), 1), u)
    check(t.broadcast_to(data["col"][0], (2, 3, 4)), np.broadcast_to(data["col"][1], (2, 3, 4)))
    for axis in range(4):
        check(t.stack([a, a + 1], axis), np.stack([u, u + 1], axis))
    check(t.concatenate([a, a[:, :1], data["cube"][0].astype("f8")], 1), np.concatenate([u, u[:, :1], u.astype("f8")], 1))
    for bad in (
        lambda: a.reshape(5, 5), lambda: a.reshape(-1, -1), lambda: t.transpose(a, (0, 0, 1)), lambda: t.squeeze(a, 0),
        lambda: t.broadcast_to(a, (2, 3, 5)), lambda: t.stack([]), lambda: t.concatenate([a], 3), lambda: t.roll(a, 1, -1),
    ):
        with pytest.raises(ValueError):
            bad()
    assert shuffles(t.roll(a, 1, 0).T.reshape(24)[::2]) == 0


def test_pad(data):
    a, u = data["i"]
    for width, values in [(1, 0), ((2, 0), 5), (((1, 2), (0, 3)), ((1, 2), (3, 4))), (0, 0), (((0, 0), (1, 1)), 7)]:
        got, want = t.pad(a, width, constant_values=values), np.pad(u, width, constant_values=values)
        check(got, want)
    with pytest.raises(NotImplementedError):
        t.pad(a, 1, mode="edge")
    with pytest.raises(ValueError):
        t.pad(a, 1, stat_length=3)


EINSUM = [
    ("ij->ij", "f"), ("ij->", "i"), ("ij->ji", "f"), ("ij,ij->ij", "f i"), ("ij,kj->ik", "f f"), ("ij,jk->ik", "f T"),
    ("ij,ij->", "i i"), ("i,j->ij", "row row"), ("ij,j->i", "f row"), ("ii->i", "sq"), ("ii->", "sq"), ("dij,ij->d", "cube i"),
    ("dij,ej,ei->dei", "cube i2 i3"), ("ij,ik,kl->jl", "f col sq1"), ("ij,ij,ij->i", "c c c"), ("i j -> j", "b"),
]


@pytest.mark.parametrize("spec,names", EINSUM)
def test_einsum(spark, data, spec, names):
    more = {
        "T": (data["f"][0].T, data["f"][1].T),
        "sq": (data["f"][0][:3, :3], data["f"][1][:3, :3]),
        "sq1": (data["f"][0][:1, :], data["f"][1][:1, :]),
        "i2": (data["i"][0][:2], data["i"][1][:2]),
        "i3": (data["j"][0][:2, :3], data["j"][1][:2, :3]),
    } | data
    arrays, values = zip(*[more[n] for n in names.split()])
    check(t.einsum(spec, *arrays), np.einsum(spec.replace(" ", ""), *values))


def test_einsum_errors(data):
    a, u = data["f"]
    for spec, args in [("ij->k", [a]), ("ij->ii", [a]), ("ij,jk->ik", [a, a]), ("ij->ij", [a, a]), ("i->i", [a]), ("ij", [a])]:
        with pytest.raises(ValueError):
            t.einsum(spec, *args)
    with pytest.raises(NotImplementedError):
        t.einsum("...j->j", a)
    check(t.einsum("ij,ij->ij", a, data["col"][0]), u * data["col"][1])


def test_products(spark):
    rng = np.random.default_rng(2)
    shapes = [((5,), (5,)), ((3, 5), (5,)), ((5,), (5, 2)), ((3, 5), (5, 2)), ((2, 3, 5), (5, 4)), ((2, 3, 5), (2, 5, 4)), ((2, 1, 3, 5), (2, 5, 4)), ((5,), (2, 5, 3))]
    for s, r in shapes:
        u, v = rng.normal(size=s), rng.normal(size=r)
        a, b = from_numpy(spark, u), from_numpy(spark, v)
        check(a @ b, u @ v)
        check(t.dot(a, b), np.dot(u, v))
    z = rng.normal(size=(2, 3)) + 1j * rng.normal(size=(2, 3))
    check(t.vdot(from_numpy(spark, z), from_numpy(spark, z)), np.vdot(z, z))
    check(t.dot(2, from_numpy(spark, z)), 2 * z)
    with pytest.raises(ValueError):
        from_numpy(spark, z) @ 2
    with pytest.raises(ValueError):
        from_numpy(spark, z) @ from_numpy(spark, z)


def test_sparse(spark):
    dense = np.zeros((6, 5))
    dense[[0, 0, 2, 5], [1, 4, 0, 3]] = [1.5, -2, 3, 4]
    starts, cols, values = np.array([0, 2, 2, 3, 3, 3, 4]), np.array([1, 4, 0, 3]), np.array([1.5, -2, 3, 4])
    s = t.make_csr_matrix((6, 5), *[from_numpy(spark, x) for x in (values, cols, starts)])
    check(s.dense(), dense)
    for shape in [(5,), (5, 2), (5, 2, 3)]:
        x = np.arange(np.prod(shape), dtype=float).reshape(shape)
        check(s @ from_numpy(spark, x), np.tensordot(dense, x, 1))
    entries, rows = t.to_csr(s)
    assert [r.start for r in rows.orderBy("row").collect()] == starts[:-1].tolist()
    assert [(r.i1, r.v) for r in entries.orderBy("at").collect()] == list(zip(cols.tolist(), values.tolist()))
    with pytest.raises(ValueError):
        s @ from_numpy(spark, np.zeros(4))
    with pytest.raises(ValueError):
        t.make_csr_matrix((6, 5), *[from_numpy(spark, x) for x in (values, cols, starts[:-1])])


def test_types(spark):
    kinds = ["bool", "i1", "i2", "i4", "i8", "u1", "u2", "u4", "f4", "f8", "c16"]
    for x, y in itertools.product(kinds, repeat=2):
        a, b = np.array([1, 0, 3], x), np.array([1, 1, 2], y)
        got = from_numpy(spark, a) + from_numpy(spark, b)
        assert got.dtype == (a + b).dtype, (x, y)
    check(from_numpy(spark, np.array([1, 2, 3], "i2")) * 2, np.array([1, 2, 3], "i2") * 2)
    check(from_numpy(spark, np.array([1, 2], "f4")) * 0.5, np.array([1, 2], "f4") * 0.5)
    with pytest.raises(Exception, match="OVERFLOW"):
        (from_numpy(spark, np.array([100], "i1")) + from_numpy(spark, np.array([100], "i1"))).collect()


def test_misuse(data):
    a, _ = data["f"]
    with pytest.raises(TypeError):
        a + "x"
    with pytest.raises(ValueError):
        bool(a)
    with pytest.raises(t.CannotBroadcastError):
        a + data["cube"][0][:, :2, :]
    with pytest.raises(TypeError):
        len(data["s"][0])
    assert len(a) == 3 and a.size == 12 and a.ndim == 2


def test_tags(data):
    a, u = data["f"]
    b = a.with_tagged_axis(0, "row").tagged("x")
    assert (b * 2 + a).axis_tags[0] == {"row"} and t.sum(b, 1).axis_tags == (frozenset({"row"}),)
    assert b.T.axis_tags[1] == {"row"} and b.without_tags("x").tags == frozenset()
    assert b.relation().schema["i0"].metadata == {"tags": ["row"]}
    check(b, u)


@pytest.mark.parametrize("seed", range(12))
def test_random_programs(spark, seed):
    """One expression, built in NumPy and lazily."""
    rng, n = random.Random(seed), 4
    source = np.random.default_rng(seed)
    pool = [(from_numpy(spark, u), u) for u in (source.integers(-5, 6, (n, n)) for _ in range(3))]
    steps = [
        lambda x, y: (x[0] + y[0], x[1] + y[1]),
        lambda x, y: (x[0] * 2 - y[0], x[1] * 2 - y[1]),
        lambda x, y: (x[0].T, x[1].T),
        lambda x, y: (t.roll(x[0], 1, 1), np.roll(x[1], 1, 1)),
        lambda x, y: (x[0] @ y[0] % 11, x[1] @ y[1] % 11),
        lambda x, y: (x[0][::-1], x[1][::-1]),
        lambda x, y: (t.where(t.less(x[0], y[0]), x[0], y[0]), np.where(x[1] < y[1], x[1], y[1])),
        lambda x, y: (t.maximum(x[0], y[0]), np.maximum(x[1], y[1])),
        lambda x, y: (t.broadcast_to(t.sum(x[0], 0), (n, n)), np.broadcast_to(x[1].sum(0), (n, n))),
        lambda x, y: (t.stack([x[0][0], y[0][1], x[0][2], y[0][3]]), np.stack([x[1][0], y[1][1], x[1][2], y[1][3]])),
        lambda x, y: (x[0].reshape(2, 8).reshape(n, n, order="F"), x[1].reshape(2, 8).reshape((n, n), order="F")),
    ]
    for _ in range(6):
        pool.append(rng.choice(steps)(rng.choice(pool), rng.choice(pool)))
    check(*pool[-1])


@pytest.mark.parametrize("small", [8 << 20, 0])
def test_products_larger_than_their_operands(spark, monkeypatch, small):
    """Cells of a product that outnumber the operands' are made in one place: nothing is summed after the rows met."""
    from tessel.operators import linalg

    monkeypatch.setattr(linalg, "BROADCAST_BYTES", small)
    monkeypatch.setattr(linalg, "TASK_CELLS", 200, raising=False)
    x, y = np.arange(-60, 60).reshape(40, 3), np.arange(75.0).reshape(3, 25) / 7
    a, b = from_numpy(spark, x), from_numpy(spark, y)
    found = a @ b
    np.testing.assert_allclose(found.collect(), x @ y, rtol=1e-12)
    lines = found.df._jdf.queryExecution().simpleString().splitlines()
    joins = [k for k, s in enumerate(lines) if "Join" in s or "CartesianProduct" in s]
    assert joins and not any("Aggregate" in s or "Exchange" in s for s in lines[: joins[0]])
    np.testing.assert_array_equal((a @ a.T).collect(), x @ x.T)
    p, q = np.arange(120).reshape(2, 20, 3), np.arange(126).reshape(2, 3, 21)
    np.testing.assert_array_equal((from_numpy(spark, p) @ from_numpy(spark, q)).collect(), p @ q)
    r, s = np.arange(96).reshape(16, 2, 3), np.arange(90).reshape(3, 15, 2)
    got = t.einsum("aij,jbi->ba", from_numpy(spark, r), from_numpy(spark, s))
    np.testing.assert_array_equal(got.collect(), np.einsum("aij,jbi->ba", r, s))
    with pytest.raises(Exception, match="(?i)overflow"):
        (from_numpy(spark, np.full((9, 2), 1 << 62)) @ from_numpy(spark, np.full((2, 9), 2))).collect()


def test_large_products_take_little_room_when_written(spark, tmp_path):
    """Their cells come in runs and repetitions of coordinates, and equal rows of operands follow one another."""
    import pyarrow.parquet as pq

    x, y = (np.arange(120) * 7 % 11).reshape(60, 2), (np.arange(60_000) * 5 % 997).reshape(2, 30_000)
    a, b = (t.arange(spark, 120, dtype="int64") * 7 % 11).reshape(60, 2), (t.arange(spark, 60_000, dtype="int64") * 5 % 997).reshape(2, 30_000)
    (a @ b).relation().write.parquet(f"{tmp_path}/cells")
    cells = pq.read_table(f"{tmp_path}/cells").to_pydict()
    got = np.full((60, 30_000), -1)
    got[cells["i0"], cells["i1"]] = cells["v"]
    assert len(cells["v"]) == got.size
    np.testing.assert_array_equal(got, x @ y)
    assert sum(f.stat().st_size for f in (tmp_path / "cells").glob("*.parquet")) < got.size
    np.testing.assert_array_equal((b.T @ a.T)[5:9].collect(), (x @ y).T[5:9])
