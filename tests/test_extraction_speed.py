"""Extraction runs as compiled code: sessions from a launcher too, and no generator over interpreted functions."""

import re

from ddlscope.operators import extract
from ddlscope.plans.analysis import Analysis

NAME = "spark.sql.codegen.hugeMethodLimit"


def _scripts(spark, texts, file_name="V1__migration.sql"):
    rows = [(i, file_name, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "migration_id long, file_name string, text string")


def test_method_limit_of_any_session(spark):
    before = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, "65535")
        empty = spark.createDataFrame([], "schema_id string, text string")
        Analysis(spark, _scripts(spark, []), empty, empty)
        assert int(spark.conf.get(NAME)) <= 8000
    finally:
        spark.conf.set(NAME, before)


def test_generators_are_over_plain_expressions(spark):
    plan = extract.extract_operations(_scripts(spark, ["DROP TABLE a;"]))._jdf.queryExecution().optimizedPlan().toString()
    generators = re.findall(r"^[ :+-]*Generate .*$", plan, re.M)
    assert len(generators) >= 6
    assert not [g for g in generators if "lambda" in g]


def test_marks_in_a_script_stay(spark):
    ops = extract.extract_operations(_scripts(spark, ["/* x */ CREATE TABLE a\u0001b (c INT); -- y\nALTER TABLE t DROP\u0001 c, ADD d TEXT;"])).collect()
    assert [r.raw_sql for r in ops] == ["CREATE TABLE a\u0001b (c INT)", "ALTER TABLE t DROP\u0001 c", "ALTER TABLE t ADD d TEXT"]
    lone = extract.extract_operations(_scripts(spark, ["DROP TABLE a '--x\n;"])).collect()
    assert [(r.target_table, r.raw_sql) for r in lone] == [("a", "DROP TABLE a '")]


def test_words_are_written_once(spark):
    plan = extract.extract_operations(_scripts(spark, ["DROP TABLE a;"]))._jdf.queryExecution().optimizedPlan().toString()
    projections = [line for line in plan.splitlines() if re.match(r"^[ :+-]*Project \[", line)]
    # every projection writes its columns anew: the lists of words end with the one that reads the words that decide
    assert len([p for p in projections if " AS _up#" in p or re.search(r"[\[ ]_up#\d+[,\]]", p)]) == 1
    assert not [p for p in projections if "parser_notes" in p and "lambda" in p]


def test_words_with_the_separator(spark):
    ops = extract.extract_operations(_scripts(spark, ["alter table a\u0001 add b int; create unique index concurrently i on only t (c); drop table \u0001"])).collect()
    assert [(r.op_class, r.target_table, r.is_concurrent) for r in ops] == [
        ("ADD_COLUMN", "a", False), ("CREATE_INDEX", "t", True), ("DROP_TABLE", "", False)]


def test_scripts_are_put_together_by_compiled_functions(spark):
    from ddlscope.sources import corpus

    for build in (corpus.migration_scripts, corpus.query_log_chunks):
        assert "lambda" not in build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
