"""Arrays as coordinate relations.

An `Array` is a dense N-d array held by a DataFrame with a row a cell: coordinates i0, i1, ... (bigint) and any
other columns, over which `value` is a Column that is not evaluated yet.  Operators only build DataFrames, so
nothing runs before an action, and Catalyst sees whole programs.  Elementwise operators on arrays of one frame
combine their values in one projection, without a join; only arrays of different frames are joined, on the
coordinates that both really have.

Shapes are known when an array is built: every dense array has exactly prod(shape) rows, distinct coordinates
and no null value.  Tags say something about an array or an axis and never change a result.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Hashable, Sequence
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import scalar
from tessel.functions.dtypes import item, literal, normal, result_type, spark_type
from tessel.operators.shapes import broadcast_shapes, grid, normal_shape, unflatten

#: A side of a join is broadcast if its cells take less than this by its shape, which is known exactly.
BROADCAST_BYTES = 8 << 20

Scalar = bool | int | float | complex | np.generic


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine, where the session names none, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster's session has to name a shared folder in spark.checkpoint.dir")
    return named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def is_scalar(x) -> bool:
    return isinstance(x, (bool, int, float, complex, np.generic))


def coord_names(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


class Array:
    __array_priority__ = 100

    def __init__(
        self,
        df: DataFrame,
        shape,
        dtype,
        value: Column | None = None,
        tags=frozenset(),
        axis_tags=None,
        reduction_tags: dict[str, frozenset] | None = None,
    ):
        self.df, self.shape, self.dtype = df, normal_shape(shape), normal(dtype)
        self.value = F.col("v") if value is None else value
        self.tags = frozenset(tags)
        self.axis_tags: tuple[frozenset, ...] = tuple(axis_tags or (frozenset(),) * len(self.shape))
        #: Tags of the letters that an einsum has summed to give this array.
        self.reduction_tags = dict(reduction_tags or {})

    # -- what it is ---------------------------------------------------------------------------------------

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def __len__(self) -> int:
        if not self.ndim:
            raise TypeError("an array without axes has no length")
        return self.shape[0]

    def __bool__(self) -> bool:
        raise ValueError("the truth of a lazy array is not known")

    def __repr__(self) -> str:
        return f"Array(shape={self.shape}, dtype={self.dtype})"

    def __iter__(self):
        raise TypeError("a lazy array can't be gone through; use its relation()")

    # -- tags ---------------------------------------------------------------------------------------------

    def _copy(self, **new) -> Array:
        old = {"df": self.df, "shape": self.shape, "dtype": self.dtype, "value": self.value}
        kept = {"tags": self.tags, "axis_tags": self.axis_tags, "reduction_tags": self.reduction_tags}
        return Array(**old | kept | new)

    def tagged(self, *tags: Hashable) -> Array:
        return self._copy(tags=self.tags | set(tags))

    def without_tags(self, *tags: Hashable) -> Array:
        return self._copy(tags=self.tags - set(tags))

    def with_tagged_axis(self, axis: int, *tags: Hashable) -> Array:
        axes = list(self.axis_tags)
        axes[axis] = axes[axis] | set(tags)
        return self._copy(axis_tags=axes)

    def with_tagged_reduction(self, letter: str, *tags: Hashable) -> Array:
        """Tags for a letter that the einsum of this array sums."""
        if letter not in self.reduction_tags:
            raise ValueError(f"{letter!r} is not summed")
        return self._copy(reduction_tags=self.reduction_tags | {letter: self.reduction_tags[letter] | set(tags)})

    # -- as a relation ------------------------------------------------------------------------------------

    def relation(self) -> DataFrame:
        """(i0, ..., v); tags of axes are in the metadata of their columns, those of the array and its sums in v's."""
        names = [
            F.col(c).alias(c, metadata={"tags": sorted(map(str, t))}) if t else F.col(c)
            for c, t in zip(coord_names(self.ndim), self.axis_tags)
        ]
        held = {x: sorted(map(str, t)) for x, t in self.reduction_tags.items() if t} | {"": sorted(map(str, self.tags))}
        said = {"reductions": held, "tags": held.pop("")}
        said = {k: v for k, v in said.items() if v}
        return self.df.select(*names, self.value.alias("v", metadata=said) if said else self.value.alias("v"))

    def plain(self) -> Array:
        """The same over its own relation, so that its value is a column."""
        return self._copy(df=self.relation(), value=F.col("v"))

    def stored(self) -> Array:
        """Kept once computed: for an array that several outputs use.  Only results repeat; its cells spill to
        disk, and are computed anew where an executor is lost."""
        return self._copy(df=self.relation().persist(), value=F.col("v"))

    def released(self) -> None:
        """Gives up what `stored` keeps."""
        self.df.unpersist()

    def checkpointed(self) -> Array:
        """Written to the checkpoint folder, with its lineage cut: for loops whose plans would grow.

        The folder is the one that the session names in spark.checkpoint.dir; only where it names none (on one
        machine) is it a temporary one.
        """
        context = self.spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_folder(self.spark))
        return self._copy(df=self.relation().checkpoint(), value=F.col("v"))

    def small(self) -> bool:
        return self.size * 8 * (self.ndim + 1) <= BROADCAST_BYTES

    def with_coords(self, shape, coords: Sequence[Column], where: Column | None = None, axis_tags=None) -> Array:
        """Other coordinates for (some of) the cells: a projection, no shuffle."""
        df = self.df if where is None else self.df.filter(where)
        names = [c.cast("bigint").alias(f"i{k}") for k, c in enumerate(coords)]
        return Array(df.select(*names, self.value.alias("v")), shape, self.dtype, tags=self.tags, axis_tags=axis_tags)

    def collect(self) -> np.ndarray:
        """The whole array on the driver: for tests and small results."""
        out = np.zeros(self.shape, self.dtype)
        for *at, v in self.relation().collect():
            out[tuple(at)] = complex(v["re"], v["im"]) if self.dtype.kind == "c" else int(v) if self.dtype.kind == "u" else v
        return out

    # -- operators ----------------------------------------------------------------------------------------

    def _binary(self, other, f: Callable, reverse: bool = False):
        if not isinstance(other, Array) and not is_scalar(other):
            return NotImplemented
        return f(other, self) if reverse else f(self, other)

    def __add__(self, other):
        return self._binary(other, add)

    def __radd__(self, other):
        return self._binary(other, add, True)

    def __sub__(self, other):
        return self._binary(other, subtract)

    def __rsub__(self, other):
        return self._binary(other, subtract, True)

    def __mul__(self, other):
        return self._binary(other, multiply)

    def __rmul__(self, other):
        return self._binary(other, multiply, True)

    def __truediv__(self, other):
        return self._binary(other, divide)

    def __rtruediv__(self, other):
        return self._binary(other, divide, True)

    def __floordiv__(self, other):
        return self._binary(other, floor_divide)

    def __rfloordiv__(self, other):
        return self._binary(other, floor_divide, True)

    def __mod__(self, other):
        return self._binary(other, modulo)

    def __rmod__(self, other):
        return self._binary(other, modulo, True)

    def __pow__(self, other):
        return self._binary(other, power)

    def __rpow__(self, other):
        return self._binary(other, power, True)

    def __and__(self, other):
        return self._binary(other, bitwise_and)

    __rand__ = __and__

    def __or__(self, other):
        return self._binary(other, bitwise_or)

    __ror__ = __or__

    def __xor__(self, other):
        return self._binary(other, bitwise_xor)

    __rxor__ = __xor__

    def __neg__(self):
        if self.dtype.kind == "c":
            return multiply(self, -1)
        if self.dtype.kind == "b":
            raise TypeError("booleans have no negative")
        if self.dtype.kind == "u":
            return subtract(self.dtype.type(0), self)
        return elementwise(lambda x: -x, self.dtype, self)

    def __pos__(self):
        return self

    def __abs__(self):
        from tessel.operators.elementwise import abs as absolute

        return absolute(self)

    def __matmul__(self, other):
        from tessel.operators.linalg import matmul

        return matmul(self, other)

    def __rmatmul__(self, other):
        from tessel.operators.linalg import matmul

        return matmul(other, self)

    def __getitem__(self, index):
        from tessel.operators.indexing import index_into

        return index_into(self, index)

    @property
    def T(self):
        from tessel.operators.reshaping import transpose

        return transpose(self)

    def reshape(self, *shape, order: str = "C"):
        from tessel.operators.reshaping import reshape

        return reshape(self, shape[0] if len(shape) == 1 else shape, order)

    @property
    def real(self):
        from tessel.operators.elementwise import real

        return real(self)

    @property
    def imag(self):
        from tessel.operators.elementwise import imag

        return imag(self)

    def conj(self):
        from tessel.operators.elementwise import conj

        return conj(self)

    def all(self, axis=None):
        from tessel.operators.reductions import all as all_

        return all_(self, axis)

    def any(self, axis=None):
        from tessel.operators.reductions import any as any_

        return any_(self, axis)

    def astype(self, dtype) -> Array:
        dtype = normal(dtype)
        return self if dtype == self.dtype else elementwise(lambda x: scalar.to_dtype(x, self.dtype, dtype), dtype, self)


# -- sources ------------------------------------------------------------------------------------------------


def from_relation(df: DataFrame, shape, dtype, coords: Sequence[str] | None = None, value: str = "v") -> Array:
    """A dense array of a DataFrame that has a row a cell: `coords` name its coordinates, in order."""
    shape = normal_shape(shape)
    names = list(coords) if coords is not None else coord_names(len(shape))
    if len(names) != len(shape):
        raise ValueError(f"{len(names)} coordinates for {len(shape)} axes")
    cells = [F.col(c).cast("bigint").alias(f"i{k}") for k, c in enumerate(names)]
    return Array(df.select(*cells, F.col(value).cast(spark_type(dtype)).alias("v")), shape, dtype)


def from_numpy(spark: SparkSession, data) -> Array:
    """A small array from the driver, as literal rows."""
    data = np.asarray(data)
    dtype = normal(data.dtype)
    flat = data.ravel()
    cells = [[complex(x).real, complex(x).imag] if dtype.kind == "c" else item(x, dtype) for x in flat]
    rows = [(k, tuple(v) if dtype.kind == "c" else v) for k, v in enumerate(cells)]
    df = spark.createDataFrame(rows, f"flat bigint, v {spark_type(dtype)}")
    names = [c.alias(f"i{k}") for k, c in enumerate(unflatten(F.col("flat"), data.shape))]
    return Array(df.select(*names, "v"), data.shape, dtype)


def full(spark: SparkSession, shape, fill_value: Scalar, dtype=None, order: str = "C") -> Array:
    if order != "C":
        raise ValueError("only C order")
    shape = normal_shape(shape)
    dtype = normal(dtype or np.asarray(fill_value).dtype)
    return Array(grid(spark, shape), shape, dtype, literal(fill_value, dtype))


def zeros(spark: SparkSession, shape, dtype=float) -> Array:
    return full(spark, shape, 0, dtype)


def ones(spark: SparkSession, shape, dtype=float) -> Array:
    return full(spark, shape, 1, dtype)


def zeros_like(a: Array | Scalar, dtype=None):
    """Over the frame of `a`, whose values Catalyst prunes."""
    if is_scalar(a):
        return np.zeros((), dtype or np.asarray(a).dtype)[()]
    dtype = normal(dtype or a.dtype)
    return a._copy(dtype=dtype, value=literal(0, dtype))


def ones_like(a: Array | Scalar, dtype=None):
    if is_scalar(a):
        return np.ones((), dtype or np.asarray(a).dtype)[()]
    dtype = normal(dtype or a.dtype)
    return a._copy(dtype=dtype, value=literal(1, dtype))


class Accessor:
    """A named array in an index lambda: called with coordinates, it is the array's value there."""

    def __init__(self, a: Array, calls: list):
        self.a, self.calls = a, calls

    def __call__(self, *coords: Column | int) -> Column:
        if len(coords) != self.a.ndim:
            raise ValueError(f"{len(coords)} coordinates for {self.a.ndim} axes")
        name = f"x{len(self.calls)}"
        self.calls.append((self.a, [c if isinstance(c, Column) else F.lit(c) for c in coords], name))
        return F.col(name)


def make_index_lambda(spark: SparkSession, f: Callable[..., Column], shape, dtype, **arrays: Array) -> Array:
    """The array whose cell at coordinates i0, i1, ... is f(i0, i1, ..., **arrays), an expression of Columns.

    In f the arrays are called with expressions of the coordinates: f = lambda i, x: x(i) + 2 * x(i - 1).  Each such
    access is an equality join of the coordinates with the array; outside of an array's box it is null, so f has
    to give another value there (F.when, F.coalesce).  Arrays in the result are dense: a cell that is null raises.
    """
    shape, dtype = normal_shape(shape), normal(dtype)
    calls: list = []
    value = f(*[F.col(f"i{k}") for k in range(len(shape))], **{k: Accessor(a, calls) for k, a in arrays.items()})
    names, df = coord_names(len(shape)), grid(spark, shape)
    for a, coords, name in calls:
        cells = a.df.select(*[F.col(f"i{k}").alias(f"a{k}") for k in range(a.ndim)], a.value.alias(name))
        keyed = df.select("*", *[c.cast("bigint").alias(f"k{k}") for k, c in enumerate(coords)])
        on = [F.col(f"k{k}") == F.col(f"a{k}") for k in range(a.ndim)]
        side = F.broadcast(cells) if a.small() else cells
        df = keyed.join(side, on, "left") if on else keyed.crossJoin(side)  # an array without axes: one row
        df = df.drop(*[f"{x}{k}" for k in range(a.ndim) for x in "ka"])
    none = F.raise_error(F.lit("an index lambda has no value at a cell")).cast(spark_type(dtype))
    value = value.cast(spark_type(dtype)) if dtype.kind != "c" else value
    return Array(df, shape, dtype, F.coalesce(value, none))


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0, dtype=float) -> Array:
    m, dtype = n if m is None else m, normal(dtype)
    if n < 0 or m < 0:
        raise ValueError("negative size")
    value = F.when(F.col("i1") - F.col("i0") == k, literal(1, dtype)).otherwise(literal(0, dtype))
    return Array(grid(spark, (n, m)), (n, m), dtype, value)


def arange(spark: SparkSession, *args, dtype=None) -> Array:
    """start + i * step; the dtype must be given."""
    if not 1 <= len(args) <= 3:
        raise TypeError("arange takes a stop, or a start, a stop and a step")
    if dtype is None:
        raise ValueError("arange needs a dtype")
    start, stop, step = (0, args[0], 1) if len(args) == 1 else (*args, 1)[:3]
    if step == 0:
        raise ValueError("the step is 0")
    span = (stop - start) / step
    n, dtype = max(0, math.ceil(span.real)), normal(dtype)
    if dtype.kind == "c":
        start, step = complex(start), complex(step)
        at = F.col("i0").cast("double")
        value = F.struct((start.real + at * step.real).alias("re"), (start.imag + at * step.imag).alias("im"))
    else:
        value = (F.lit(start) + F.col("i0") * F.lit(step)).cast(spark_type(dtype))
    return Array(grid(spark, (n,)), (n,), dtype, value)


# -- elementwise --------------------------------------------------------------------------------------------


def elementwise(f: Callable[..., Column], dtype, *args: Array | Column) -> Array:
    """f of the arrays' values, cell by cell, after broadcasting.  Arguments that are Columns are literals."""
    arrays = [a for a in args if isinstance(a, Array)]
    frame = align(arrays)
    values = iter(frame.values)
    value = f(*[next(values) if isinstance(a, Array) else a for a in args])
    tags = [frozenset() for _ in frame.shape]
    for a in arrays:
        for k, t in enumerate(a.axis_tags, len(tags) - a.ndim):
            tags[k] = tags[k] | t
    return Array(frame.df, frame.shape, dtype, value, axis_tags=tags)


class Frame:
    """Arrays over one DataFrame: their values are Columns of it."""

    def __init__(self, df: DataFrame, shape: tuple[int, ...], values: list[Column]):
        self.df, self.shape, self.values = df, shape, values


def align(arrays: Sequence[Array]) -> Frame:
    """One frame for arrays that broadcast together; a join for each frame beyond the first."""
    shape = broadcast_shapes(*[a.shape for a in arrays])
    groups: list[list[int]] = []
    for k, a in enumerate(arrays):
        for g in groups:
            if arrays[g[0]].df is a.df and arrays[g[0]].shape == a.shape:
                g.append(k)
                break
        else:
            groups.append([k])
    if len(groups) == 1 and arrays[0].shape == shape:
        return Frame(arrays[0].df, shape, [a.value for a in arrays])
    n, joined, lengths = len(shape), None, ()
    for g in sorted(groups, key=lambda g: -arrays[g[0]].size):
        first = arrays[g[0]]
        own = (1,) * (n - first.ndim) + first.shape
        coords = [F.lit(0).cast("bigint") if d < n - first.ndim else F.col(f"i{d - n + first.ndim}") for d in range(n)]
        values = [arrays[k].value.alias(f"x{k}") for k in g]
        if joined is None:
            joined = first.df.select(*[c.alias(f"i{d}") for d, c in enumerate(coords)], *values)
            lengths = own
            continue
        right = first.df.select(*[c.alias(f"r{d}") for d, c in enumerate(coords)], *values)
        both = [d for d in range(n) if lengths[d] == own[d] != 1]
        held = [c for c in joined.columns if c.startswith("x")]
        side = F.broadcast(right) if first.small() else right
        if both:
            on = [F.col(f"i{d}") == F.col(f"r{d}") for d in both]
            joined = joined.join(side, on)
        else:
            joined = joined.crossJoin(side)  # an outer product: as many rows as the result has cells
        names = [F.col(f"r{d}" if lengths[d] == 1 else f"i{d}").alias(f"i{d}") for d in range(n)]
        joined = joined.select(*names, *held, *[f"x{k}" for k in g])
        lengths = broadcast_shapes(lengths, own)
    return Frame(joined, shape, [F.col(f"x{k}") for k in range(len(arrays))])


def _converted(a: Array | Scalar, dtype) -> Array | Column:
    dtype = normal(dtype)
    if isinstance(a, Array):
        return a if a.dtype == dtype else a._copy(dtype=dtype, value=_recast(a, dtype))
    return literal(a, dtype)


def _recast(a: Array, dtype: np.dtype) -> Column:
    if a.dtype.kind == "b" and dtype.kind in "iu":
        return a.value.cast("int").cast(spark_type(dtype))
    return scalar.to_dtype(a.value.cast("int") if a.dtype.kind == "b" and dtype.kind in "fc" else a.value, a.dtype, dtype)


def common_type(*args: Array | Scalar) -> np.dtype:
    return result_type(*[a.dtype if isinstance(a, Array) else a for a in args])


def binary(name: str, f: Callable[[Column, Column, str], Column], a, b, out=None) -> Array | Scalar:
    """The operands in their common type; two scalars are computed at once."""
    if is_scalar(a) and is_scalar(b):
        return getattr(np, name)(a, b)
    dtype = common_type(a, b)
    out = normal(out or dtype)

    def g(x: Column, y: Column) -> Column:
        if out.kind == "u":
            return _unsigned(name, f, x, y, out)
        found = f(x, y, dtype.kind)
        return found if out.kind in "cb" else found.cast(spark_type(out))

    return elementwise(g, out, _converted(a, dtype), _converted(b, dtype))


def _unsigned(name: str, f: Callable, x: Column, y: Column, dtype: np.dtype) -> Column:
    """An operator of unsigned numbers, modulo 2**bits."""
    bits = 8 * dtype.itemsize
    if name == "multiply":
        return scalar.unsigned_multiply(x, y, bits).cast(spark_type(dtype))
    if name.startswith("bitwise") and bits == 64:
        x, y = (scalar.as_signed(c) for c in (x, y))
        return scalar.wrapped(f(x, y, "i"), bits)
    if name in ("add", "subtract"):
        wide = "bigint" if bits < 64 else "decimal(38,0)"
        x, y = x.cast(wide), y.cast(wide)
    found = f(x, y, "u" if bits == 64 else "i")
    return scalar.wrapped(found, bits).cast(spark_type(dtype))


def add(a, b):
    return binary("add", scalar.add, a, b)


def subtract(a, b):
    if not (is_scalar(a) and is_scalar(b)) and common_type(a, b).kind == "b":
        raise TypeError("booleans can't be subtracted")
    return binary("subtract", scalar.subtract, a, b)


def multiply(a, b):
    return binary("multiply", scalar.multiply, a, b)


def divide(a, b):
    """True division: integers give float64."""
    if is_scalar(a) and is_scalar(b):
        return np.true_divide(a, b)
    dtype = common_type(a, b)
    if dtype.kind in "iub":
        dtype = np.dtype("float64")

    def g(x: Column, y: Column) -> Column:
        found = scalar.divide(x, y, dtype.kind)
        return found if dtype.kind == "c" else found.cast(spark_type(dtype))

    return elementwise(g, dtype, _converted(a, dtype), _converted(b, dtype))


def _real(name: str, a, b):
    if not (is_scalar(a) and is_scalar(b)) and common_type(a, b).kind in "cb":
        raise TypeError(f"{name} takes real numbers, not {common_type(a, b)}")


def floor_divide(a, b):
    _real("floor_divide", a, b)
    return binary("floor_divide", scalar.floor_divide, a, b)


def modulo(a, b):
    _real("mod", a, b)
    return binary("mod", scalar.modulo, a, b)


def power(a, b):
    """Of integers exact, by repeated squares; of other numbers in doubles."""
    if is_scalar(a) and is_scalar(b):
        return np.power(a, b)
    dtype = common_type(a, b)
    if dtype.kind == "c":
        raise NotImplementedError("powers of complex values")
    if dtype.kind == "b":
        raise TypeError("powers of booleans")
    if dtype.kind == "f":
        f = lambda x, y: scalar.power(x.cast("double"), y.cast("double")).cast(spark_type(dtype))
        return elementwise(f, dtype, *[a if isinstance(a, Array) else literal(a, np.asarray(a).dtype) for a in (a, b)])
    if is_scalar(b) and b < 0:
        raise ValueError("integers to negative integer powers")
    bits = 8 * dtype.itemsize

    def whole(x: Column, y: Column) -> Column:
        if dtype.kind == "i":
            return scalar.whole_power(x.cast("bigint"), y.cast("bigint"), lambda p, q: p * q).cast(spark_type(dtype))
        if bits == 64:
            # Exponents from 64 on wrap like others; they are taken as they are, a bit at a time.
            one, half = F.lit(Decimal(1)).cast("decimal(20,0)"), F.lit(Decimal(1 << 32)).cast("decimal(20,0)")
            parts = ((y % half).cast("bigint"), ((y - y % half) / half).cast("bigint"))
            return _wrapped_power(x, parts, one, bits)
        return _wrapped_power(x, (y.cast("bigint"),), F.lit(1).cast("bigint"), bits).cast(spark_type(dtype))

    return elementwise(whole, dtype, _converted(a, dtype), _converted(b, dtype))


def _wrapped_power(x: Column, parts: Sequence[Column], one: Column, bits: int) -> Column:
    """Modulo 2**bits, by a square for each bit of the exponent; `parts` are its halves of 32 bits, lower first."""
    times = lambda p, q: scalar.unsigned_multiply(p, q, bits)
    found = F.struct(one.alias("out"), (x if bits == 64 else x.cast("bigint")).alias("square"))
    for e in parts:

        def step(acc: Column, k: Column) -> Column:
            out = F.when(F.getbit(e, k) == 1, times(acc["out"], acc["square"])).otherwise(acc["out"])
            return F.struct(out.alias("out"), times(acc["square"], acc["square"]).alias("square"))

        found = F.aggregate(F.sequence(F.lit(0), F.lit(31)), found, step)
    return found["out"]


def _bits(name: str, op: str, a, b):
    if not (is_scalar(a) and is_scalar(b)) and common_type(a, b).kind not in "iub":
        raise TypeError("bitwise operators take integers or booleans")
    return binary(name, lambda x, y, kind: scalar.bitwise(op, x, y, kind), a, b)


def bitwise_and(a, b):
    return _bits("bitwise_and", "and", a, b)


def bitwise_or(a, b):
    return _bits("bitwise_or", "or", a, b)


def bitwise_xor(a, b):
    return _bits("bitwise_xor", "xor", a, b)
