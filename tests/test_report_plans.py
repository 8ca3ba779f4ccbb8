"""Reports extract the operations once, and read a record's kind without parsing the record."""

from ddlscope.functions import patterns
from ddlscope.operators import querylog
from ddlscope.plans import queries

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_report_columns_read_written_operations(spark):
    plan = _plan(queries.q_report_columns(spark, SF))
    assert "regexp_extract_all" not in plan and "RLIKE" not in plan


def test_kinds_without_parsing(spark):
    assert "get_json_object" not in _plan(queries.q_report_counts(spark, SF))


def test_patterns_only_where_their_words_are(spark):
    texts = ["SELECT a::int FROM t FOR UPDATE", "select b from u for no key update of u", "SELECT trim(both FROM x) FROM v", "SELECT c FROM w",
             "SELECT extract(year from d) FROM y WHERE e IS NOT distinct from f", "SELECT convert(g USING utf8) FROM [z]",
             "INSERT INTO s (h) VALUES ('FROM q') on duplicate key update h = 1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "log_id long, query string")
    plan = _plan(querylog.with_references(df))
    # the words are looked for before the pattern runs
    assert plan.count("Contains(upper(") >= 8 and plan.count(patterns.LOCKING[:30]) == 1
    got = {r.log_id: sorted(r.ref_tables) for r in querylog.with_references(df).collect()}
    assert got == {0: ["t"], 1: ["u"], 2: ["v"], 3: ["w"], 4: ["y"], 5: ["z"], 6: ["s"]}


def test_numbers_are_turned_to_text_per_table(spark):
    plan = _plan(queries.q_lock_lookup(spark, SF))
    assert "format_number" not in plan and "format_string" not in plan


def test_heads_come_from_one_aggregation(spark):
    plan = _plan(queries.q_analysis_payload(spark, SF))
    # one reading for scores and rollback together, one for the operations themselves
    assert len([x for x in plan.splitlines() if "Relation [" in x and "parser_notes" in x]) == 2
    plan = _plan(queries.q_json_report(spark, SF))
    # heads, changes, and operations with their rollback steps
    assert len([x for x in plan.splitlines() if "Relation [" in x and "parser_notes" in x]) == 3


def test_log_entries_of_any_line_ends(spark):
    texts = {1: "SELECT 1\r\nselect 2 \x0bSELECT 3  SELECT 4\x1dxSELECT 5\n\n\tUPDATE t SET a = 1\x0c", 2: "x SELECT 1,\n2 ;\nSELECT 3;;\nSELECT 4",
             3: "SELECT 1\nnote\n  SELECT 2  "}
    logs = spark.createDataFrame([(k, 0, v) for k, v in texts.items()], "log_id long, chunk_id long, text string")
    got = {}
    for r in querylog.log_entries(logs).orderBy("pos").collect():
        got.setdefault((r.log_id, r.terminated), []).append(r.query)
    assert got == {(1, False): ["SELECT 1", "select 2", "SELECT 3", "SELECT 4", "UPDATE t SET a = 1"], (2, True): ["SELECT 1,\n2 ;", "SELECT 3;"],
                   (2, False): ["SELECT 3;;", "SELECT 4"], (3, False): ["SELECT 1", "SELECT 2"]}
