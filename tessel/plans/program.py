"""Programs: functions of named arrays that are checked once and run on any tables that fit."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessel.functions.dtypes import normal
from tessel.operators.array import Array
from tessel.operators.shapes import normal_shape

#: What an output is called that has no name.
OUTPUT = "_out"
_LENGTH = re.compile(r"(?:(\d+)\s*\*\s*)?([A-Za-z]\w*)\s*(?:([+-])\s*(\d+))?")
_NAME = re.compile(r"(?!_(?:out|in|r)?\d*$)[A-Za-z_]\w*")


class NameClashError(ValueError):
    pass


def solve_lengths(declared: tuple, actual: tuple[int, ...], sizes: dict[str, int]) -> None:
    """Adds to `sizes` what the actual lengths say of lengths like 7, "n" or "2*n+1"; contradictions raise."""
    if len(declared) != len(actual):
        raise ValueError(f"{len(actual)} axes for {len(declared)}")
    for want, n in zip(declared, actual):
        if isinstance(want, int):
            if want != n:
                raise ValueError(f"length {n}, not {want}")
            continue
        if not (m := _LENGTH.fullmatch(want.strip())):
            raise ValueError(f"length {want!r} is not affine in one name")
        times, offset = int(m[1] or 1), int(f"{m[3] or '+'}{m[4] or 0}")
        size, rest = divmod(n - offset, times)
        if rest or size < 0 or sizes.setdefault(m[2], size) != size:
            raise ValueError(f"length {n} contradicts {want} with {sizes}")


@dataclass(frozen=True)
class Placeholder:
    """What an input must be: lengths are numbers, or affine in a named size."""

    shape: tuple
    dtype: str = "float64"


@dataclass(frozen=True)
class SizeParam:
    """A named length; without a value it follows from the inputs' shapes."""

    name: str


class Program:
    """f(inputs...) -> an array, or a dict of named arrays."""

    def __init__(self, f: Callable, **inputs: Placeholder | SizeParam | Array):
        for name in inputs:
            if not _NAME.fullmatch(name):
                raise ValueError(f"{name!r} is no name for an input")
        self.f, self.inputs, self.bound = f, inputs, {k: v for k, v in inputs.items() if isinstance(v, Array)}

    def bind(self, **values) -> Program:
        """The same program with some inputs given."""
        unknown = set(values) - set(self.inputs)
        if unknown:
            raise TypeError(f"no inputs {sorted(unknown)}")
        if twice := set(values) & set(self.bound):
            raise TypeError(f"inputs {sorted(twice)} are bound already")
        out = Program(self.f, **self.inputs)
        out.bound = self.bound | values
        return out

    def arrays(self, **values) -> dict[str, Array]:
        given = self.bind(**values).bound
        sizes: dict[str, int] = {}
        for name, spec in self.inputs.items():
            if isinstance(spec, Placeholder):
                if name not in given:
                    raise TypeError(f"input {name} is missing")
                a = given[name]
                if a.dtype != normal(spec.dtype):
                    raise TypeError(f"input {name} is {a.dtype}, not {spec.dtype}")
                solve_lengths(tuple(spec.shape), a.shape, sizes)
            elif isinstance(spec, SizeParam) and name in given:
                if sizes.setdefault(spec.name, given[name]) != given[name]:
                    raise ValueError(f"size {spec.name} is {sizes[spec.name]}, not {given[name]}")
        for name, spec in self.inputs.items():
            if isinstance(spec, SizeParam):
                if spec.name not in sizes:
                    raise TypeError(f"size {spec.name} is missing")
                given = given | {name: sizes[spec.name]}
        found = self.f(**given)
        found = found if isinstance(found, Mapping) else {OUTPUT: found}
        if bad := [k for k, v in found.items() if not isinstance(v, Array)]:
            raise TypeError(f"outputs {bad} are no arrays")
        return dict(found)

    def __call__(self, **values) -> dict[str, DataFrame]:
        """The outputs as lazy relations."""
        return {name: a.relation() for name, a in self.arrays(**values).items()}


def named(**arrays: Array) -> dict[str, Array]:
    """A bundle of outputs: what several of them use is best `stored()` in the function that builds them."""
    for name in arrays:
        if not name.isidentifier():
            raise ValueError(f"{name!r} is no name")
    return arrays


def merged(*bundles: Mapping[str, Array]) -> dict[str, Array]:
    """Bundles as one; two different arrays of one name clash."""
    out: dict[str, Array] = {}
    for b in bundles:
        for name, a in b.items():
            if out.setdefault(name, a) is not a:
                raise NameClashError(f"two arrays are called {name}")
    return out


def distribute(f: Callable[[Array], Array], terms: list[tuple[Array, float]]) -> Array:
    """A linear f of a sum of scaled arrays, applied to each array: sum(c * f(x)).  It pays where f of each part
    is needed elsewhere anyway, or a part is far smaller than the sum."""
    total = None
    for x, c in terms:
        part = f(x) * c
        total = part if total is None else total + part
    if total is None:
        raise ValueError("no terms")
    return total
