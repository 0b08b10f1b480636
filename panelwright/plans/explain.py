"""What a physical plan holds: for tests and for looking at a query before it meets 100 TB."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    """The formatted plan, before adaptive changes."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def operators(df: DataFrame) -> Counter:
    """How often each operator stands in the plan."""
    return Counter(re.findall(r"^\(\d+\) (\w+)", text(df), re.M))


def scans(df: DataFrame) -> list[tuple[str, str, str]]:
    """(file, columns read, filters pushed) of every scan."""
    out = []
    for block in re.split(r"\n\n+", text(df)):
        if "ReadSchema:" in block:
            place = re.search(r"Location: .*?([^/\]]+)\]", block)
            pushed = re.search(r"PushedFilters: \[(.*?)\]\n", block + "\n")
            out.append((place[1] if place else "", re.search(r"ReadSchema: struct<(.*)>", block)[1], pushed[1] if pushed else ""))
    return out


def every_pair_joins(df: DataFrame) -> int:
    """Joins without an equality: products and nested loops."""
    found = operators(df)
    return found["CartesianProduct"] + found["BroadcastNestedLoopJoin"]
