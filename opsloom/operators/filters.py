"""Search filters as plain column predicates, so that they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.text import all_of


def between(col: str, bounds: tuple | None) -> Column | None:
    """Closed range, either end may be missing."""
    if not bounds:
        return None
    low, high = bounds
    tests = ([F.col(col) >= low] if low is not None else []) + ([F.col(col) <= high] if high is not None else [])
    return all_of(tests)


def one_of(col: str, values: str | Sequence[str] | None) -> Column | None:
    """One value is equality, several are alternatives; ``*`` in a value is a wildcard."""
    if values is None:
        return None
    values = [values] if isinstance(values, str) else list(values)
    plain = [v for v in values if "*" not in v]
    tests = [F.col(col).isin(plain)] if plain else []
    tests += [F.col(col).like(v.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%"))
              for v in values if "*" in v]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def search_filter(service=None, host=None, log_file=None, lines=None, times=None, source_type=None, level=None,
                  category=None, keywords=None) -> Column:
    """All given filters at once; none given keeps every row."""
    tests = [
        one_of("service_name", service), one_of("hostname", host), one_of("log_file", log_file),
        between("line_number", lines), between("timestamp", times), one_of("source_type", source_type),
        one_of("log_level", level), one_of("category", category),
        F.arrays_overlap("keywords", F.array(*[F.lit(k) for k in keywords])) if keywords else None,
    ]
    return all_of(t for t in tests if t is not None)


def made_once(df: DataFrame) -> DataFrame:
    """The same rows, for filters on costly columns.

    A filter is pushed below the columns it reads by copying their expressions
    into it, down to the scan and before any repartition. It stays above a
    generator, where it reads the columns as made. Select what is needed first.
    """
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def entity_filter(kind: str | None = None, props: dict[str, str] | None = None) -> Column:
    """Type and any property equalities over an open property map."""
    tests = [F.col("type") == kind] if kind else []
    tests += [F.col("props")[k] == v for k, v in (props or {}).items()]
    return all_of(tests)


def has_service(col: str = "service_name") -> Column:
    """Evidence that names a real service."""
    return ~F.coalesce(F.trim(F.col(col)), F.lit("")).isin("", "unknown", "documentation")


def has_both_ends(source: str = "from_service", target: str = "to_service") -> Column:
    return all_of(F.col(c).isNotNull() & ~F.col(c).isin("null", "") for c in (source, target))


def timeline(df: DataFrame, service: str, start, end) -> DataFrame:
    """Rows of one service strictly between two times, oldest first."""
    return df.filter((F.col("service_name") == service) & (F.col("timestamp") > start)
                     & (F.col("timestamp") < end)).orderBy("timestamp")
