"""String functions as Catalyst expressions, with the semantics of the reference's runtime where they differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_all(c: Column) -> Column:
    """Without any white space at either end (Spark's trim takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def code_tokens(c: Column) -> Column:
    """Text as blank-separated lower-case code tokens: camel, snake and kebab case, and letters and digits, are parted."""
    for pattern, to in (
        ("([a-z])([A-Z])", "$1 $2"),
        ("_+", " "),
        ("-+", " "),
        (r"([a-zA-Z])(\d)", "$1 $2"),
        (r"(\d)([a-zA-Z])", "$1 $2"),
        (r"[^\w\s]", " "),
        (r"\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(F.lower(c))


def sql_code_tokens(x: str) -> str:
    """The same in DuckDB's SQL."""
    for pattern, to in (
        ("([a-z])([A-Z])", r"\1 \2"),
        ("_+", " "),
        ("-+", " "),
        (r"([a-zA-Z])([0-9])", r"\1 \2"),
        (r"([0-9])([a-zA-Z])", r"\1 \2"),
        (r"[^a-zA-Z0-9_\t\n\f\r\x0B ]", " "),
        (r"[\t\n\f\r\x0B ]+", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim(lower({x}), ' ')"
