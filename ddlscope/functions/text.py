"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


WHITESPACE = " \t\n\r\x0b\x0c"


def py_strip(c: Column) -> Column:
    """Remove leading/trailing whitespace (space, tab, newline, CR, VT, FF — Java's \\s).

    Plain SQL ``trim`` only removes spaces; a trim set keeps it a string scan.
    """
    return F.trim(c, F.lit(WHITESPACE))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def fill(template: str, **cols: Column) -> Column:
    """Fill a '{name}' template with column values (native concat)."""
    import re

    parts = []
    for tok in re.split(r"(\{\w+\})", template):
        if not tok:
            continue
        m = re.fullmatch(r"\{(\w+)\}", tok)
        parts.append(cols[m.group(1)].cast("string") if m else F.lit(tok))
    return F.concat(*parts) if len(parts) > 1 else parts[0]
