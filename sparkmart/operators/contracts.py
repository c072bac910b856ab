"""Checks of the library itself: models bind to what sources declare, plans hold no Python, functions can be listed."""

from __future__ import annotations

import inspect
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .. import functions
from ..plans import MODELS, Graph
from ..sources import SCHEMAS, Source, contract
from ..sources.registry import schema

#: What models may not hold: SQL text as a whole query, row-at-a-time or Arrow functions, RDDs, results on the driver.
FORBIDDEN = (r"\.sql\(", r"\budf\b", r"pandas_udf", r"applyIn\w+", r"mapIn\w+", r"\.rdd\b", r"\.collect\(", r"\.toPandas\(", r"\bspark\.read\b", r"select\(\s*[\"']\*[\"']\s*\)")


def empty_sources(spark: SparkSession) -> Source:
    return Source({n: (lambda n=n: spark.createDataFrame([], schema(n))) for n in SCHEMAS})


def unbound_models(spark: SparkSession) -> list[str]:
    """Models that can't be analysed over empty tables of the declared schemas."""
    out, graph = [], Graph(empty_sources(spark), spark)
    for name in MODELS:
        try:
            graph[name].schema  # noqa: B018  analysis is what is asked for
        except Exception as e:  # noqa: BLE001
            out.append(f"{name}: {e}")
    return out


def broken_sources(source: Source) -> list[str]:
    """What the sources at hand break of the declared schemas; wall clocks are accepted for instants."""
    out = []
    for n in SCHEMAS:
        found = source.table(n).schema
        out += [f"{n}: {x}" for x in contract(found, schema(n)) if not re.search(r"is timestamp_ntz, declared timestamp$", x)]
    return out


def lint(folder: str | None = None) -> list[str]:
    """Forbidden constructs in the models' files, as file:line: text."""
    out = []
    for p in sorted(Path(folder or Path(__file__).parents[1] / "plans").glob("*.py")):
        if p.name == "sql.py":
            continue
        for i, line in enumerate(p.read_text().splitlines(), 1):
            if any(re.search(f, line) for f in FORBIDDEN):
                out.append(f"{p.name}:{i}: {line.strip()}")
    return out


def python_in_plan(df: DataFrame) -> list[str]:
    """Operators of a physical plan that leave the JVM."""
    return re.findall(r"\w*(?:Python|Pandas|InArrow)\w*", df._jdf.queryExecution().executedPlan().toString())


def function_listing() -> list[str]:
    """name(arguments): first line of what it does, for each column function."""
    out = []
    for name in functions.__all__:
        f = getattr(functions, name)
        if inspect.isfunction(f):
            args = ", ".join(p.name for p in inspect.signature(f).parameters.values())
            out.append(f"{name}({args}): {(inspect.getdoc(f) or '').splitlines()[0] if f.__doc__ else ''}".rstrip(": "))
    return out
