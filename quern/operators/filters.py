"""The filter language of the store: a small grammar parsed into a Column, so that predicates reach the scan and nothing is spliced."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.paths import checked_extensions

TOKENS = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>-?\d+(?:\.\d+)?)|(?P<op>==|!=|<=|>=|<|>|&&|\|\||[()\[\],!])|(?P<word>[A-Za-z_]\w*))""")
#: Names of the store's fields and their columns.
FIELDS = {"id": "id", "content": "content", "relativePath": "relative_path", "startLine": "start_line", "endLine": "end_line", "fileExtension": "file_extension", "metadata": "metadata"}


class FilterError(ValueError):
    """A filter expression that cannot be read."""


def parse(text: str, fields: dict[str, str] = FIELDS) -> Column | None:
    """The Column of an expression with ==, !=, <, <=, >, >=, in, not in, like, and, or, not and brackets; None for an empty one.

    Raises FilterError for anything else, also for unknown fields.
    """
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text.rstrip()):
        m = TOKENS.match(text, at)
        if not m:
            raise FilterError(f"cannot read filter at {text[at : at + 20]!r}")
        kind = m.lastgroup or ""
        tokens.append((kind, m[kind]))
        at = m.end()
    if not tokens:
        return None
    position = 0

    def peek() -> str:
        return tokens[position][1].lower() if position < len(tokens) and tokens[position][0] != "str" else ""

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal position
        if position >= len(tokens) or (expected is not None and peek() != expected):
            raise FilterError(f"expected {expected or 'more'} in filter")
        position += 1
        return tokens[position - 1]

    def literal() -> object:
        kind, value = take()
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "num":
            return float(value) if "." in value else int(value)
        if value.lower() in ("true", "false"):
            return value.lower() == "true"
        raise FilterError(f"expected a value, not {value!r}")

    def some() -> Column:
        out = every()
        while peek() in ("or", "||"):
            take()
            out = out | every()
        return out

    def every() -> Column:
        out = single()
        while peek() in ("and", "&&"):
            take()
            out = out & single()
        return out

    def single() -> Column:
        if peek() in ("not", "!"):
            take()
            return ~single()
        if peek() == "(":
            take()
            out = some()
            take(")")
            return out
        kind, name = take()
        if kind != "word" or name not in fields:
            raise FilterError(f"unknown field {name!r}")
        column = F.col(fields[name])
        op = take()[1].lower()
        if op == "not":
            take("in")
            return ~column.isin(*items())
        if op == "in":
            return column.isin(*items())
        if op == "like":
            return column.like(str(literal()))
        value = literal()
        table = {"==": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}
        if op not in table:
            raise FilterError(f"unknown operator {op!r}")
        return table[op]

    def items() -> list[object]:
        take("[")
        out = [literal()] if peek() != "]" else []
        while peek() == ",":
            take()
            out.append(literal())
        take("]")
        return out

    out = some()
    if position < len(tokens):
        raise FilterError(f"unexpected {tokens[position][1]!r} in filter")
    return out


def of_extensions(given: list[str]) -> str:
    """The filter expression for a list of extensions; '' for an empty one."""
    found = checked_extensions(given)
    return "fileExtension in [" + ", ".join(f"'{e}'" for e in found) + "]" if found else ""


def of_path(path: str) -> str:
    """The filter expression for one file."""
    return 'relativePath == "' + path.replace("\\", "\\\\").replace('"', '\\"') + '"'
