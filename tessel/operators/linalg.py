"""Contractions: joins on shared letters, and sums as soon as a letter is no longer needed."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Hashable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions import scalar
from tessel.functions.dtypes import result_type, spark_type
from tessel.operators.array import BROADCAST_BYTES, Array, _converted, is_scalar, multiply
from tessel.operators.elementwise import conj
from tessel.operators.reshaping import ravel

#: The longest sums that are written out term by term, the cells of a product that a task makes, an operand's rows in a
#: block, and how many times its operands' cells a product has that is made of blocks.
UNROLLED, TASK_CELLS, BLOCK_ROWS, BLOCK_TIMES = 64, 4_000_000, 256, 16


def _parse(spec: str, operands: list[Array]) -> tuple[list[str], str]:
    spec = spec.replace(" ", "")
    if "." in spec:
        raise NotImplementedError("ellipsis in einsum")
    if not re.fullmatch(r"[A-Za-z]*(?:,[A-Za-z]*)*->[A-Za-z]*", spec):
        raise ValueError(f"{spec!r} is no explicit einsum specification")
    ins, out = spec.split("->")
    parts = ins.split(",")
    if len(parts) != len(operands):
        raise ValueError(f"{len(operands)} operands for {len(parts)} terms")
    if len(set(out)) < len(out):
        raise ValueError("a letter twice in the output")
    if set(out) - set(ins):
        raise ValueError("an output letter that no operand has")
    for p, a in zip(parts, operands):
        if len(p) != a.ndim:
            raise ValueError(f"term {p!r} for {a.ndim} axes")
    return parts, out


class _Term:
    """An operand with letters for coordinates, c_x for the letter x, and its cells in column v."""

    def __init__(self, df: DataFrame, letters: str, lengths: dict[str, int], kind: str):
        self.df, self.letters, self.lengths, self.kind = df, letters, lengths, kind

    def cells(self, letters=None) -> int:
        return math.prod(self.lengths[x] for x in (self.letters if letters is None else letters))

    def without(self, gone: set[str], to: str) -> _Term:
        """Summed over letters."""
        if not gone & set(self.letters):
            return self
        left = "".join(x for x in self.letters if x not in gone)
        if self.kind == "c":
            total = F.struct(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"))
        elif self.kind == "b":
            total = F.bool_or("v")
        else:
            total = F.sum("v").cast(to)
        return _Term(self.df.groupBy(*[f"c_{x}" for x in left]).agg(total.alias("v")), left, self.lengths, self.kind)

    def times(self, other: _Term) -> _Term:
        shared = [x for x in self.letters if x in other.letters]
        right = other.df.select(*[F.col(f"c_{x}").alias(f"o_{x}") for x in other.letters], F.col("v").alias("w"))
        left = self.df
        if other.cells() * 8 * (len(other.letters) + 1) <= BROADCAST_BYTES:
            right = F.broadcast(right)
        elif self.cells() * 8 * (len(self.letters) + 1) <= BROADCAST_BYTES:
            left = F.broadcast(left)
        on = [F.col(f"c_{x}") == F.col(f"o_{x}") for x in shared]
        both = left.join(right, on) if on else left.crossJoin(right)  # an outer product
        new = [x for x in other.letters if x not in shared]
        value = scalar.multiply(F.col("v"), F.col("w"), self.kind)
        df = both.select(*[f"c_{x}" for x in self.letters], *[F.col(f"o_{x}").alias(f"c_{x}") for x in new], value.alias("v"))
        return _Term(df, self.letters + "".join(new), self.lengths, self.kind)

    def _vectors(self, over: str, name: str, parts: int = 0) -> DataFrame:
        """A row for each set of the other coordinates, with the cells along the letters `over` as columns."""
        keys = [F.col(f"c_{x}").alias(f"{name}_{x}") for x in self.letters if x not in over]
        place = F.lit(0).cast("bigint")
        for x in over:
            place = place * self.lengths[x] + F.col(f"c_{x}")
        rows = self.df.select(*keys, place.alias("place"), "v")
        names = [f"{name}_{x}" for x in self.letters if x not in over]
        if parts > 1:
            rows = rows.repartition(parts, *names)
        return rows.groupBy(*names).agg(*[F.sum(F.when(F.col("place") == k, F.col("v"))).alias(f"{name}{k}") for k in range(self.cells(over))])

    def _blocks(self, over: str, name: str, parts: int) -> DataFrame:
        """The rows of `_vectors` as lists in the column `name`, in order of their values, over `parts` partitions: equal
        rows are next to one another."""
        rows = self._vectors(over, name)
        keys = [f"{name}_{x}" for x in self.letters if x not in over]
        fields = [*[c for c in rows.columns if c not in keys], *keys]
        blocks = parts * math.ceil(self.cells() / self.cells(over) / parts / BLOCK_ROWS)
        rows = rows.repartitionByRange(blocks, *fields).withColumn("block", F.spark_partition_id()).repartition(parts, "block")
        # Parts meet in pairs: no more of them than these, also where a session repartitions more finely.
        return rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)).select(name).coalesce(parts)

    def product(self, other: _Term, gone: set[str], to: str) -> _Term | None:
        """`times`, summed over the shared letters `gone`, where the result has more cells than the operands: rows of
        one meet rows of the other, and a cell of the result is made in one place and not shuffled.  None where that
        does not pay.

        Cells of a much larger result come block by block: a row of `other` meets each row of a block in turn, and equal
        rows follow one another.  What is written of them is in runs and repetitions, which files pack."""
        over = "".join(x for x in self.letters if x in gone and x in other.letters)
        both = "".join(x for x in self.letters if x in other.letters and x not in gone)
        own = [x for x in self.letters if x not in over and x not in both]
        new = [x for x in other.letters if x not in over and x not in both]
        size, inner = self.cells([*both, *own, *new]), self.cells(over)
        if self.kind not in "if" or not (over and own and new) or inner > UNROLLED or size <= self.cells() + other.cells():
            return None
        row = [other.cells() // inner * (inner + len(other.letters)) * 8, self.cells() // inner * (inner + len(self.letters)) * 8]
        if row[1] < row[0] and row[1] <= BROADCAST_BYTES:
            return other.product(self, gone, to)
        small = row[0] <= BROADCAST_BYTES
        if both and not small:
            return None
        tasks = math.ceil(size / TASK_CELLS)
        if both or small and size < BLOCK_TIMES * (self.cells() + other.cells()):
            left, right = self._vectors(over, "a", tasks), F.broadcast(other._vectors(over, "b"))
            met = left.join(right, [F.col(f"a_{x}") == F.col(f"b_{x}") for x in both]) if both else left.crossJoin(right)
        else:  # each part of the one meets each part of the other
            most = [t.cells() // inner for t in (self, other)]
            more = min(most[1], math.ceil(tasks / min(most[0], math.ceil(tasks**0.5))))
            right = other._blocks(over, "b", more).select(F.inline("b"))
            left = self._blocks(over, "a", min(most[0], math.ceil(tasks / more)))
            met = left.crossJoin(right.hint("shuffle_replicate_nl")).select(*right.columns, F.inline("a"))
        wide = "bigint" if self.kind == "i" else "double"
        products = [scalar.multiply(F.col(f"a{k}").cast(to), F.col(f"b{k}").cast(to), self.kind) for k in range(inner)]
        value = sum((F.coalesce(p.cast(wide), F.lit(0).cast(wide)) for p in products[1:]), F.coalesce(products[0].cast(wide), F.lit(0).cast(wide)))
        names = [F.col(f"a_{x}").alias(f"c_{x}") for x in [*both, *own]] + [F.col(f"b_{x}").alias(f"c_{x}") for x in new]
        return _Term(met.select(*names, value.cast(to).alias("v")), "".join([*both, *own, *new]), self.lengths, self.kind)


def _term(a: Array, letters: str, lengths: dict[str, int], dtype) -> _Term:
    """Equal letters become a filter; an axis of length 1 whose letter is longer elsewhere is no coordinate."""
    a = _converted(a, dtype)
    df, first = a.df, {}
    for k, x in enumerate(letters):
        if a.shape[k] == 1 != lengths[x]:
            continue
        if x in first:
            df = df.filter(F.col(f"i{k}") == F.col(f"i{first[x]}"))
        else:
            first[x] = k
    names = [F.col(f"i{k}").alias(f"c_{x}") for x, k in first.items()]
    return _Term(df.select(*names, a.value.alias("v")), "".join(first), lengths, dtype.kind)


def einsum(spec: str, *operands: Array, reductions: Mapping[str, Iterable[Hashable]] | None = None) -> Array:
    """Explicit einsum.  Operands are contracted two at a time, those first whose result is smallest by their
    shapes, and a letter that nothing else needs is summed before the next join.  The two operands of one row's
    cells never meet more often than the result needs them.

    `reductions` has tags for letters that are summed; they say something about the sum and change no result.  The
    result keeps them (`reduction_tags`), and in its value's metadata."""
    operands = list(operands)
    parts, out = _parse(spec, operands)
    if unknown := [x for x in reductions or () if x in out or not any(x in p for p in parts)]:
        raise ValueError(f"{unknown} are not summed")
    tags = {x: frozenset((reductions or {}).get(x, ())) for p in parts for x in p if x not in out}
    lengths: dict[str, int] = {}
    for p, a in zip(parts, operands):
        for x, n in zip(p, a.shape):
            if lengths.get(x, 1) != 1 and n not in (1, lengths[x]):
                raise ValueError(f"letter {x} has lengths {lengths[x]} and {n}")
            lengths[x] = max(lengths.get(x, 1), n) if 0 not in (n, lengths.get(x, 1)) else 0
    dtype = result_type(*[a.dtype for a in operands])
    to, shape = spark_type(dtype), tuple(lengths[x] for x in out)
    if 0 in lengths.values():
        from tessel.operators.array import full

        return full(operands[0].spark, shape, 0, dtype)._copy(reduction_tags=tags)
    terms = [_term(a, p, lengths, dtype) for p, a in zip(parts, operands)]

    def finish(rest: list[_Term]) -> list[_Term]:
        held = Counter(x for t in rest for x in t.letters)
        return [t.without({x for x in t.letters if held[x] == 1 and x not in out}, to) for t in rest]

    terms = finish(terms)
    while len(terms) > 1:
        pairs = [(i, j) for i in range(len(terms)) for j in range(i + 1, len(terms))]

        def left(pair):
            i, j = pair
            others = set(out).union(*[t.letters for k, t in enumerate(terms) if k not in pair])
            both = set(terms[i].letters) | set(terms[j].letters)
            return terms[i].cells(both & others), terms[i].cells(both), pair

        i, j = min(pairs, key=left)
        others = [t for k, t in enumerate(terms) if k not in (i, j)]
        gone = set(terms[i].letters + terms[j].letters).difference(out, *[t.letters for t in others])
        terms = finish([terms[i].product(terms[j], gone, to) or terms[i].times(terms[j]), *others])
    found = terms[0]
    df = found.df
    for x in out:  # a letter of length 1 everywhere may have no coordinate left
        if x not in found.letters:
            df = df.withColumn(f"c_{x}", F.lit(0).cast("bigint"))
    names = [F.col(f"c_{x}").alias(f"i{k}") for k, x in enumerate(out)]
    value = F.col("v") if dtype.kind in "cb" else F.col("v").cast(to)
    return Array(df.select(*names, value.alias("v")), shape, dtype, reduction_tags=tags)


def gram(rows: DataFrame, column: str, width: int, dtype="float64", scale=None) -> Array:
    """The Gram matrix of rows held as arrays: einsum("ri,rj->ij", E, E) where a row's cells are in one place.

    Each row meets itself only, so nothing is joined; products are summed in the task before one small shuffle
    of width x width cells a task.
    """
    vector = F.col(column) if scale is None else F.transform(column, scale)
    rows = rows.select(F.transform(vector, lambda x: x.cast(spark_type(dtype))).alias("xs"))
    left = rows.select(F.posexplode("xs").alias("i", "x"), "xs")
    both = left.select("i", "x", F.posexplode("xs").alias("j", "y"))
    found = both.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).cast(spark_type(dtype)).alias("v"))
    return Array(found.select(F.col("i").cast("bigint").alias("i0"), F.col("j").cast("bigint").alias("i1"), "v"), (width, width), dtype)


def matmul(a, b) -> Array:
    from tessel.operators.sparse import CSRMatrix

    if isinstance(a, CSRMatrix):
        return a @ b
    if is_scalar(a) or is_scalar(b) or not a.ndim or not b.ndim:
        raise ValueError("matmul takes no scalars")
    if a.shape[-1] != b.shape[-2 if b.ndim > 1 else 0]:
        raise ValueError(f"shapes {a.shape} and {b.shape} don't go together")
    stack = max(a.ndim, b.ndim) - 2
    letters = "abcdefghijklmnop"[: max(0, stack)]
    x = letters[len(letters) - max(0, a.ndim - 2) :] + ("yz" if a.ndim > 1 else "z")
    y = letters[len(letters) - max(0, b.ndim - 2) :] + ("zw" if b.ndim > 1 else "z")
    out = (letters if stack > 0 else "") + ("y" if a.ndim > 1 else "") + ("w" if b.ndim > 1 else "")
    return einsum(f"{x},{y}->{out}", a, b)


def dot(a, b) -> Array:
    if is_scalar(a) or is_scalar(b) or not a.ndim or not b.ndim:
        return multiply(a, b)
    x = "abcdefghijklm"[: a.ndim - 1]
    y = "nopqrstuvwxy"[: b.ndim - 1]
    inner = f"{y[:-1]}z{y[-1]}" if b.ndim > 1 else "z"
    return einsum(f"{x}z,{inner}->{x}{y}", a, b)


def vdot(a: Array, b: Array) -> Array:
    return dot(ravel(conj(a)), ravel(b))


def distribute_einsum(spec: str, sums: Sequence[Sequence[tuple[Array, complex]]]) -> Array:
    """An einsum whose operands are sums of scaled arrays, by the distributive law: each operand is a list of
    (array, factor), and one einsum runs for each choice of terms.  It pays where the terms have fewer cells
    together than their sum (a row and a column), for then each product meets fewer."""
    total = None
    for choice in itertools.product(*sums):
        factor = math.prod(c for _, c in choice)
        part = einsum(spec, *[x for x, _ in choice]) * factor
        total = part if total is None else total + part
    if total is None:
        raise ValueError("no terms")
    return total


__all__ = ["distribute_einsum", "einsum", "gram", "matmul", "dot", "vdot"]
