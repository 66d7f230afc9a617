"""What Spark makes of an array: its plan, counted by operator."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from tessel.operators.array import Array


def plan(a: Array | DataFrame, mode: str = "formatted") -> str:
    df = a.relation() if isinstance(a, Array) else a
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def operators(a: Array | DataFrame) -> Counter:
    """How often each physical operator occurs: Exchange for shuffles, joins by kind, and so on."""
    tree = plan(a, "simple")
    return Counter(m[1] for line in tree.splitlines() if (m := re.match(r"[\s:+\-*()\d]*([A-Z]\w+)", line)))


def shuffles(a: Array | DataFrame) -> int:
    return operators(a)["Exchange"]
