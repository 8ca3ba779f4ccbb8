"""Quotes, comments and batches by dialect, lists of names, and long lists in linear time."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from ddlscope.functions import lexer
from ddlscope.operators import extract
from helpers import parse, scripts

# (dialect, script, [(statement, class, table, column, index)])
CASES = [
    ("mysql", r"ALTER TABLE t ADD c TEXT DEFAULT 'it\'s; DROP TABLE users; x';", [("ADD_COLUMN", "t", "c", None)]),
    ("mysql", 'ALTER TABLE t ADD c TEXT DEFAULT "a\\"; DROP TABLE u;"; DROP TABLE v;', [("ADD_COLUMN", "t", "c", None), ("DROP_TABLE", "v", None, None)]),
    ("mysql", "# old\nDROP TABLE t; # DROP TABLE u;", [("DROP_TABLE", "t", None, None)]),
    ("mysql", "/* a /* b */ DROP TABLE t;", [("DROP_TABLE", "t", None, None)]),
    ("mysql", "RENAME TABLE a TO b, `c d` TO e;", [("RENAME_TABLE", "a", None, None), ("RENAME_TABLE", "c d", None, None)]),
    ("mysql", "DROP TEMPORARY TABLE IF EXISTS x, y;", [("DROP_TABLE", "x", None, None), ("DROP_TABLE", "y", None, None)]),
    ("mysql", "CREATE FULLTEXT INDEX f ON t(a);", [("CREATE_INDEX", "t", None, "f")]),
    ("postgres", "/* a /* b */ DROP TABLE ghost; */ DROP TABLE z;", [("DROP_TABLE", "z", None, None)]),
    ("postgres", "/* 1 /* 2 /* 3 */ */ DROP TABLE a; */ DROP TABLE b; /* /* */ DROP TABLE c;", [("DROP_TABLE", "b", None, None)]),
    ("postgres", "ALTER TABLE t ADD c TEXT DEFAULT E'it\\'s; DROP TABLE u;';", [("ADD_COLUMN", "t", "c", None)]),
    ("postgres", "ALTER TABLE t ADD c TEXT DEFAULT 'a\\'; DROP TABLE u;", [("ADD_COLUMN", "t", "c", None), ("DROP_TABLE", "u", None, None)]),
    ("postgres", "DROP INDEX CONCURRENTLY IF EXISTS a, s.b;", [("DROP_INDEX", "", None, "a"), ("DROP_INDEX", "", None, "b")]),
    ("postgres", "TRUNCATE TABLE a, ONLY b;", [("TRUNCATE_TABLE", "a", None, None), ("TRUNCATE_TABLE", "b", None, None)]),
    ("postgres", "# DROP TABLE a;\nDROP TABLE b;", [("DROP_TABLE", "b", None, None)]),
    ("postgres", "SELECT ARRAY[1; DROP TABLE a;", [("DROP_TABLE", "a", None, None)]),
    ("tsql", "ALTER TABLE a DROP COLUMN b\nGO\nDROP TABLE c\r\n  go 2\r\nDROP TABLE d", [("DROP_COLUMN", "a", "b", None), ("DROP_TABLE", "c", None, None), ("DROP_TABLE", "d", None, None)]),
    ("tsql", "ALTER TABLE [a;b] ADD [c d] TEXT DEFAULT 'x\nGO\n;'; /* \nGO\n /* */ */ DROP TABLE [go]", [("ADD_COLUMN", "a;b", "c d", None), ("DROP_TABLE", "go", None, None)]),
    ("tsql", "DROP TABLE t GO\nDROP TABLE u", [("DROP_TABLE", "t", None, None)]),
    ("tsql", "DROP INDEX i ON t, j ON [u v];", [("DROP_INDEX", "t", None, "i"), ("DROP_INDEX", "u v", None, "j")]),
    ("sqlite", "ALTER TABLE [a;b] ADD c TEXT DEFAULT 'x\\'; DROP TABLE d;", [("ADD_COLUMN", "a;b", "c", None), ("DROP_TABLE", "d", None, None)]),
    ("postgres", "ALTER TABLE a DROP COLUMN b\nGO\nDROP TABLE c", [("DROP_COLUMN", "a", "b", None)]),
    ("postgres", "DROP TABLE 'never closed; DROP TABLE b;", [("DROP_TABLE", "", None, None), ("DROP_TABLE", "b", None, None)]),
]


def test_scripts_of_each_dialect(spark):
    rows = [(i, t, d) for i, (d, t, _) in enumerate(CASES)]
    ops = extract.extract_operations(spark.createDataFrame(rows, "migration_id long, text string, dialect string"))
    found = {}
    for r in ops.orderBy("migration_id", "stmt_pos", "action_pos").collect():
        found.setdefault(r.migration_id, []).append((r.op_class, r.target_table, r.target_column, r.target_index))
    for i, (dialect, text, want) in enumerate(CASES):
        assert found.get(i, []) == want, (dialect, text)


def test_parentheses_deeper_than_the_pattern(spark):
    for depth in (3, lexer.DEPTH, lexer.DEPTH + 1, 60):
        body = "(" * depth + "1, 2" + ")" * depth
        ops = parse(spark, f"ALTER TABLE t ADD a INT DEFAULT {body} NOT NULL, ADD b INT, ADD c INT CHECK (c IN {body} AND c IS NOT NULL)")
        assert [(o.target_column, o.has_not_null, o.has_default) for o in ops] == [("a", True, True), ("b", False, False), ("c", False, False)]


@pytest.mark.parametrize("item", ["ADD COLUMN c{} NUMERIC(10,2) DEFAULT 'a,b'", "DROP COLUMN c{}"])
def test_a_list_takes_time_as_its_length(spark, item):
    def seconds(n):
        text = "ALTER TABLE t " + ", ".join(item.format(i) for i in range(n)) + ";"
        df = extract.extract_operations(scripts(spark, text))
        began = time.perf_counter()
        assert df.agg(F.count("*"), F.max("action_pos")).first()[:] == (n, n - 1)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 2.2 * seconds(20_000) + 1
