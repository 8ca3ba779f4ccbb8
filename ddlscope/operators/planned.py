"""Checks planned from the scripts (V1-V3 driven by P5): what each migration's own constraints and types would meet in the data.

1. ``planned_checks`` reads off every operation what it demands of rows that exist:
   the column and parent of a FOREIGN KEY, the predicate of a CHECK or SET NOT NULL,
   the new type of an ALTER COLUMN.  Row-local pattern expressions.
2. The distinct demands, schema-sized and independent of the number of migrations,
   are settled together: one scan of a table for all its predicates and types
   (``BATCH`` of them at a time), and one join for all foreign keys: the keys of all
   child columns, counted first, against the distinct keys of all parents.
3. The results go back to the operations by a join on the demand.

A script's CHECK text is only evaluated if it is made of the table's columns,
literals, comparisons and a few plain functions.

Status: ok, violated, or why a demand isn't settled: missing_table, missing_column,
type_mismatch (a key against another kind of key, a timestamp as a number),
unsupported (several key columns, other types or predicates).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ddlscope.functions import lexer
from ddlscope.operators.checks import NUMERIC_TYPES, lossy

#: Demands settled in one scan.
BATCH = 100
_PART = lexer.PART
FOREIGN_KEY = rf"(?is)\bFOREIGN\s+KEY\s*(?:\w+\s*)?\(([^)]*)\)\s*REFERENCES\s+({lexer.NAME})\s*(?:\(([^)]*)\))?"
CHECK = r"(?is)\bCHECK\s*\((.*)\)[^()]*$"
SET_NOT_NULL = rf"(?is)\bALTER\s+(?:COLUMN\s+)?{_PART}\s+SET\s+NOT\s+NULL\b"
NEW_TYPE = (rf"(?is)\b(?:ALTER\s+(?:COLUMN\s+)?{_PART}\s+(?:SET\s+DATA\s+)?TYPE|MODIFY\s+(?:COLUMN\s+)?{_PART})\s+"
            r"(DOUBLE\s+PRECISION|CHARACTER\s+VARYING\s*(?:\([^)]*\))?|\w+\s*(?:\([^)]*\))?)")
SPARK_TYPES = {"INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT", "SMALLINT": "SMALLINT", "TINYINT": "TINYINT", "REAL": "FLOAT", "FLOAT": "DOUBLE",
               "DOUBLE": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "BOOLEAN": "BOOLEAN", "TEXT": "STRING"}
WORDS = {"AND", "OR", "NOT", "IS", "NULL", "IN", "BETWEEN", "LIKE", "TRUE", "FALSE", "LENGTH", "LOWER", "UPPER", "ABS", "COALESCE", "TRIM"}
DEMAND = ["check_kind", "table_name", "column_name", "argument"]
RESULT = "check_kind string, table_name string, column_name string, argument string, status string, checked_rows long, violating_rows long"


def planned_checks(ops: DataFrame) -> DataFrame:
    """``ops`` with check_kind, table_name, column_name, argument; only operations that demand something."""
    sql, keys = F.col("raw_sql"), F.regexp_extract("raw_sql", FOREIGN_KEY, 1)
    parent = lexer.name_of(F.regexp_extract("raw_sql", FOREIGN_KEY, 2))
    single = ~keys.contains(",")
    foreign = F.struct(F.lit("foreign_key").alias("check_kind"), F.when(single, lexer.name_of(F.trim(keys))).otherwise(keys).alias("column_name"),
                       F.concat(parent, F.lit("."), lexer.name_of(F.trim(F.regexp_extract("raw_sql", FOREIGN_KEY, 3)))).alias("argument"))
    check = F.struct(F.lit("check").alias("check_kind"), F.lit("").alias("column_name"), F.trim(F.regexp_extract("raw_sql", CHECK, 1)).alias("argument"))
    not_null = F.struct(F.lit("not_null").alias("check_kind"), F.col("target_column").alias("column_name"), F.lit("").alias("argument"))
    new_type = F.struct(F.lit("type").alias("check_kind"), F.col("target_column").alias("column_name"),
                        F.upper(F.trim(F.regexp_replace(F.regexp_extract("raw_sql", NEW_TYPE, 1), r"\s+", " "))).alias("argument"))
    of = F.col("op_class")
    found = (F.when((of == "ADD_FOREIGN_KEY") & sql.rlike(FOREIGN_KEY), foreign)
             .when((of == "ADD_CONSTRAINT") & sql.rlike(CHECK), check)
             .when((of == "ALTER_COLUMN") & sql.rlike(SET_NOT_NULL), not_null)
             .when((of == "ALTER_COLUMN") & sql.rlike(NEW_TYPE), new_type))
    planned = ops.select("migration_id", "stmt_pos", "action_pos", "op_class", F.col("target_table").alias("table_name"),
                         F.explode(F.array_compact(F.array(found))).alias("_d"))
    return planned.select("migration_id", "stmt_pos", "action_pos", "op_class", "table_name", "_d.*")


def _predicate(text: str, columns: list[str]) -> str | None:
    """A CHECK text if it is made of known parts only."""
    rest = re.sub(r"'[^']*'|\b\d+(?:\.\d+)?\b", " ", text)
    names = re.findall(r"[A-Za-z_]\w*", rest)
    known = {c.lower() for c in columns}
    if not names or any(n.upper() not in WORDS and n.lower() not in known for n in names):
        return None
    return text if re.fullmatch(r"[\w\s(),.<>=!+*/%-]*", rest) and "--" not in rest and "/*" not in rest else None


def _spark_type(target: str) -> str | None:
    if re.fullmatch(r"(?:NUMERIC|DECIMAL) ?\( ?\d+ ?(?:, ?\d+ ?)?\)", target) or re.fullmatch(r"(?:VAR)?CHAR(?:ACTER)?(?: VARYING)? ?\( ?\d+ ?\)", target):
        return target.replace(" ", "")
    return SPARK_TYPES.get(target)


def _family(kind: str) -> str:
    return "number" if kind in NUMERIC_TYPES or kind.startswith("decimal") else kind


def _rows(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT)


def _struct(demand: tuple, checked: Column, bad: Column) -> Column:
    return F.struct(*(F.lit(x).alias(n) for n, x in zip(DEMAND, demand)), F.when(bad > 0, "violated").otherwise("ok").alias("status"),
                    checked.alias("checked_rows"), bad.alias("violating_rows"))


def _scans(df: DataFrame, demands: list[tuple], unsettled: list[tuple]) -> list[DataFrame]:
    """One scan of a table for ``BATCH`` predicates and types."""
    types, names = dict(df.dtypes), {c.lower(): c for c in df.columns}
    settled = []
    for d in demands:
        kind, _, column, argument = d
        name = names.get((column or "").lower())
        if kind == "check":
            text = _predicate(argument, df.columns)
            bad = None if text is None else ~F.coalesce(F.expr(text), F.lit(True))  # a null result does not violate
            checked = F.count(F.lit(1))
        elif name is None:
            unsettled.append((*d, "missing_column", None, None))
            continue
        elif kind == "not_null":
            bad, checked = F.col(name).isNull(), F.count(F.lit(1))
        else:
            target = _spark_type(argument)
            if target and types[name].startswith("timestamp") and re.match(r"(?:NUMERIC|DECIMAL|.*INT|FLOAT|DOUBLE)", target):
                unsettled.append((*d, "type_mismatch", None, None))
                continue
            bad, checked = (None if target is None else lossy(F.col(name), types[name], target)), F.count(name)
        if bad is None:
            unsettled.append((*d, "unsupported", None, None))
        else:
            settled.append((d, checked, F.count_if(bad)))
    out = []
    for at in range(0, len(settled), BATCH):
        some = settled[at:at + BATCH]
        facts = df.agg(*(x.alias(f"{n}{i}") for i, (_, checked, bad) in enumerate(some) for n, x in (("n", checked), ("v", bad))))
        out.append(facts.select(F.inline(F.array(*(_struct(d, F.col(f"n{i}"), F.col(f"v{i}")) for i, (d, _, _) in enumerate(some))))))
    return out


def _foreign_keys(demands: list[tuple], table: Callable[[str], DataFrame | None], unsettled: list[tuple]) -> list[DataFrame]:
    """All foreign keys in one join; a table is read once for all its columns, as child and as parent."""
    children, parents, keys = {}, {}, {}
    for at, d in enumerate(demands):
        _, child, column, argument = d
        parent, _, key = argument.rpartition(".")
        c, p = table(child), table(parent)
        if c is None or p is None:
            unsettled.append((*d, "missing_table", None, None))
            continue
        kinds = [{n.lower(): (n, t) for n, t in x.dtypes}.get(name.lower()) for x, name in ((c, column), (p, key))]
        if "," in column or not key:
            unsettled.append((*d, "unsupported", None, None))
        elif None in kinds:
            unsettled.append((*d, "missing_column", None, None))
        elif _family(kinds[0][1]) != _family(kinds[1][1]):
            unsettled.append((*d, "type_mismatch", None, None))
        else:
            to = keys.setdefault(f"{parent}.{kinds[1][0]}".lower(), len(keys))
            children.setdefault(child, []).append((at, *kinds[0], to))
            parents.setdefault(parent, {})[to] = kinds[1]

    # demands and parents by number, a value as a number or as text: narrow keys to count, move and join by
    def value(name: str, kind: str) -> list[Column]:
        number = _family(kind) == "number"
        return [(F.col(name) if number else F.lit(None)).cast("double").alias("kn"), (F.lit(None) if number else F.col(name)).cast("string").alias("kt")]

    if not children:
        return []
    child_rows = [table(t).select(F.inline(F.array(*(F.struct(F.lit(at).alias("at"), F.lit(to).alias("to"), *value(name, kind))
                                                       for at, name, kind, to in some)))) for t, some in children.items()]
    counted = [x.groupBy("at", "to", "kn", "kt").agg(F.count(F.lit(1)).alias("n")) for x in child_rows]  # a hot key is one row for each task
    parent_rows = [table(t).select(F.inline(F.array(*(F.struct(F.lit(to).alias("to"), *value(name, kind)) for to, (name, kind) in some.items()))))
                   for t, some in parents.items()]
    known = _union(parent_rows).distinct().select(*(F.col(c).alias(f"_{c}") for c in ("to", "kn", "kt")), F.lit(True).alias("_hit"))
    same = (F.col("to") == F.col("_to")) & F.col("kn").eqNullSafe(F.col("_kn")) & F.col("kt").eqNullSafe(F.col("_kt"))
    j = _union(counted).join(known.hint("merge"), same, "left")
    orphan = (F.col("kn").isNotNull() | F.col("kt").isNotNull()) & F.col("_hit").isNull()
    bad = F.sum(F.when(orphan, F.col("n")).otherwise(0))
    found = j.groupBy("at").agg(F.when(bad > 0, "violated").otherwise("ok").alias("status"), F.sum("n").alias("checked_rows"), bad.alias("violating_rows"))
    named = found.sparkSession.createDataFrame([(at, *d) for at, d in enumerate(demands)], "at int, " + ", ".join(f"{c} string" for c in DEMAND))
    return [found.join(F.broadcast(named), "at").select(*DEMAND, "status", "checked_rows", "violating_rows")]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def settle_checks(planned: DataFrame, table: Callable[[str], DataFrame | None]) -> DataFrame:
    """``planned`` with status, checked_rows and violating_rows.

    ``table`` gives the data of a table name, None where there is none.
    """
    spark = planned.sparkSession
    demands = sorted(tuple("" if x is None else x for x in r) for r in planned.select(*DEMAND).distinct().toLocalIterator())
    unsettled: list[tuple] = []
    results = _foreign_keys([d for d in demands if d[0] == "foreign_key"], table, unsettled)
    by_table: dict[str, list[tuple]] = {}
    for d in demands:
        if d[0] != "foreign_key":
            by_table.setdefault(d[1], []).append(d)
    for name, some in by_table.items():
        df = table(name)
        if df is None:
            unsettled += [(*d, "missing_table", None, None) for d in some]
        else:
            results += _scans(df, some, unsettled)
    results = _union([*results, _rows(spark, unsettled)])
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in DEMAND]
    rest = [c for c in planned.columns if c not in DEMAND]
    return planned.select(*rest, *keys).join(results, DEMAND, "left")
