"""Pre-flight checks with the caller's types, predicates and keys (V1-V3)."""

from __future__ import annotations

from ddlscope.operators import checks


def test_cast_audit_to_the_callers_types(spark):
    df = spark.createDataFrame([("12", 1.5, "2024-02-03"), ("x", 2.0, "nope"), ("1234", -0.125, "2024-02-30"), (None, None, None)],
                               "code string, amount double, day string")
    got = {(r.column_name, r.target_type): (r.non_null_rows, r.lossy_rows, r.first_lossy) for r in checks.cast_audit_to(
        df, {"code": "INT", "amount": "INT", "day": "DATE"}).collect()}
    assert got == {("code", "INT"): (3, 1, "x"), ("amount", "INT"): (3, 2, "-0.125"), ("day", "DATE"): (3, 2, "2024-02-30")}
    got = [tuple(r) for r in checks.cast_audit_to(df, {"code": "VARCHAR(3)", "amount": "NUMERIC(6, 2)"}).collect()]
    assert got == [("code", "VARCHAR(3)", 3, 1, "1234"), ("amount", "NUMERIC(6, 2)", 3, 1, "-0.125")]


def test_check_predicates(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (None, 7), (9, None)], "a int, b int")
    got = {r.check_name: r.violating_rows for r in checks.check_violations(df, {"positive": "b > 0", "small": "a < 5 AND b < 100"}).collect()}
    assert got == {"positive": 1, "small": 1}


def test_orphan_sample(spark):
    child = spark.createDataFrame([(1,), (7,), (7,), (8,), (9,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert [tuple(r) for r in checks.orphan_keys(child, "fk", parent, "id", 2).collect()] == [(7, 2), (8, 1)]
