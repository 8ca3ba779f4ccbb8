"""Query-log extraction (Q1-Q4), references (Q5) and impact matching (Q6-Q11)."""

from __future__ import annotations

from ddlscope.operators import querylog


def logs(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "log_id long, chunk_id long, text string")


def queries_of(spark, text):
    rows = querylog.extract_queries(logs(spark, text)).orderBy("first_chunk", "first_pos").collect()
    return [r.query for r in rows]


def test_terminated_entries_and_their_frequency(spark):
    log = "# host a\nDELETE FROM crates WHERE w > 4;\nnoise\nWITH c AS (SELECT 1) SELECT * FROM c;\nDELETE FROM crates WHERE w > 4;\n"
    rows = querylog.extract_queries(logs(spark, log)).orderBy("first_pos").collect()
    assert [(r.query, r.first_pos, r.frequency) for r in rows] == [
        ("DELETE FROM crates WHERE w > 4;", 0, 2), ("WITH c AS (SELECT 1) SELECT * FROM c;", 1, 1)]


def test_logs_without_queries(spark):
    assert queries_of(spark, "") == [] and queries_of(spark, "WARN disk nearly full\nselected 3 rows\n") == []


def test_each_log_has_its_own_mode(spark):
    rows = querylog.extract_queries(logs(spark, "SELECT a FROM t;\n", "SELECT b FROM u WHERE x = 1\nSELECT c FROM u\n")).collect()
    assert sorted((r.log_id, r.query) for r in rows) == [
        (0, "SELECT a FROM t;"), (1, "SELECT b FROM u WHERE x = 1"), (1, "SELECT c FROM u")]


def test_long_queries_are_kept_or_counted(spark):
    long = f"SELECT a FROM t WHERE b IN ({', '.join(map(str, range(900)))});"
    df = logs(spark, f"SELECT 1;\n{long}\n")
    assert sorted(r.query for r in querylog.extract_queries(df).collect()) == sorted(["SELECT 1;", long])
    assert [r.query for r in querylog.extract_queries(df, max_chars=2000).collect()] == ["SELECT 1;"]
    assert [(r.log_id, r.dropped) for r in querylog.dropped_queries(df, 2000).collect()] == [(0, 1)]


def test_line_logs_are_scanned_in_linear_time(spark):
    import time

    def seconds(n):
        df = logs(spark, "\n".join(f"SELECT c{i} FROM t WHERE x = {i}" for i in range(n)))
        t0 = time.perf_counter()
        assert querylog.extract_queries(df).count() == n
        return time.perf_counter() - t0

    seconds(100)
    assert seconds(40_000) < 30      # a scan to the end from every verb takes many minutes


def test_line_mode_without_terminators(spark):
    log = "LOG: duration 3 ms\nSELECT a FROM t WHERE x = 1\n  update t set a = 2\nnoise"
    assert queries_of(spark, log) == ["SELECT a FROM t WHERE x = 1", "update t set a = 2"]


def test_terminated_mode_spans_lines_and_first_seen_order(spark):
    log = "# Time: 1\nSELECT a,\n  b FROM t;\n# x\nUPDATE t SET a = 1;\nSELECT a,\n  b FROM t;\n"
    rows = querylog.extract_queries(logs(spark, log)).orderBy("first_pos").collect()
    assert [(r.query, r.frequency) for r in rows] == [("SELECT a,\n  b FROM t;", 2), ("UPDATE t SET a = 1;", 1)]


def test_chunked_log_equals_whole_log(spark):
    whole = "SELECT a FROM t;\nSELECT b FROM t;\nSELECT a FROM t;\n"
    chunked = spark.createDataFrame([(7, 0, "SELECT a FROM t;\nSELECT b FROM t;"), (7, 1, "SELECT a FROM t;")],
                                    "log_id long, chunk_id long, text string")
    a = sorted((r.query, r.frequency) for r in querylog.extract_queries(logs(spark, whole)).collect())
    b = sorted((r.query, r.frequency) for r in querylog.extract_queries(chunked).collect())
    assert a == b


def refs_of(spark, query):
    df = spark.createDataFrame([(0, query)], "log_id long, query string")
    long = querylog.references_long(querylog.with_references(df), ["log_id"]).collect()
    return sorted((r.table_key, r.column_name or "") for r in long)


def test_references_with_aliases_literals_and_functions(spark):
    q = ("SELECT u.email, name, count(*) AS n FROM users u JOIN Orders o ON u.id = o.user_id "
         "WHERE status = 'x from y' AND price > 100")
    assert refs_of(spark, q) == sorted([
        ("users", ""), ("Orders", ""), ("u", "email"), ("u", "id"), ("o", "user_id"),
        ("*", "name"), ("*", "status"), ("*", "price")])


def test_select_star_has_no_column(spark):
    assert refs_of(spark, "SELECT * FROM users WHERE email = 'x@y.com'") == [("*", "email"), ("users", "")]


def test_references_after_using_only_and_in_quotes(spark):
    rows = [
        ("DELETE FROM public.users USING orders o, items WHERE o.uid = users.id",
         ["users", "orders", "items"], {"o.uid", "users.id"}, []),
        ('SELECT "user name", "order" FROM "my table" WHERE "my table"."a,b" = 3', ["my table"], {"my table.a,b"}, ["order", "user name"]),
        ("SELECT [user name] FROM [dbo].[my, table] AS [m t], `x y` z", ["my, table", "x y"], set(), ["user name"]),
        ("MERGE INTO stock USING moves ON stock.id = moves.id", ["stock", "moves"], {"stock.id", "moves.id"}, None),
        ("SELECT a FROM ONLY t JOIN u USING (id) FOR UPDATE OF t SKIP LOCKED", ["t", "u"], set(), ["a", "id"]),
        ("INSERT INTO t (a) VALUES (1) ON DUPLICATE KEY UPDATE a = 2", ["t"], set(), ["a"]),
        ("SELECT CONVERT(a USING utf8) FROM t", ["t"], set(), ["a"]),
        ('SELECT a FROM "order"', ["order"], set(), ["a"]),
    ]
    df = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(rows)], "log_id int, query string")
    found = {r.log_id: r for r in querylog.with_references(df).collect()}
    for i, (q, tables, columns, star) in enumerate(rows):
        r = found[i]
        assert r.ref_tables == tables, q
        assert {f"{k.key}.{c}" for k in r.key_cols for c in k.cols} == columns, q
        assert star is None or sorted(r.star_cols) == star, q


def test_references_of_qualified_listed_and_quoted_tables(spark):
    assert refs_of(spark, "SELECT id FROM wh.users WHERE wh.users.email = 'a'") == [("*", "id"), ("users", ""), ("users", "email")]
    assert refs_of(spark, "SELECT a.x FROM users a, wh.orders AS o WHERE a.id = o.uid") == sorted([
        ("users", ""), ("orders", ""), ("a", "x"), ("a", "id"), ("o", "uid")])
    assert refs_of(spark, 'SELECT "email" FROM "users" JOIN `orders` USING (id)') == sorted([
        ("users", ""), ("orders", ""), ("*", "email"), ("*", "id")])
    assert refs_of(spark, "SELECT EXTRACT(year FROM created_at) FROM users -- FROM ghosts g") == [("*", "created_at"), ("users", "")]
    assert refs_of(spark, "SELECT n::text FROM (SELECT n FROM t) s WHERE a IS DISTINCT FROM b /* c */") == [
        ("*", "a"), ("*", "b"), ("*", "n"), ("t", "")]


def changes_df(spark, rows):
    return spark.createDataFrame(
        [(0, 0, 0, kind, ct, t, c, i, cols) for kind, ct, t, c, i, cols in rows],
        "migration_id long, stmt_pos int, action_pos int, object_kind string, change_type string, "
        "table_name string, column_name string, index_name string, index_columns array<string>")


def impacts(spark, queries, change_rows):
    q = spark.createDataFrame([(0, x) for x in queries], "log_id long, query string")
    m = spark.createDataFrame([(0, 0)], "migration_id long, db_id long")
    return querylog.match_impacts(querylog.with_references(q), changes_df(spark, change_rows), m).collect()


REMOVED_EMAIL = [("column", "removed", "users", "email", None, None)]
REMOVED_INDEX = [("index", "removed", "users", None, "idx_users_email", ["email"])]


def test_removed_column_breaks_queries_that_name_it(spark):
    query = "SELECT email, " + ", ".join(f"c{i}" for i in range(200)) + " FROM users"
    (hit,) = impacts(spark, [query, "SELECT 1 FROM crates", "SELECT id FROM users"], REMOVED_EMAIL)
    assert (hit.impact_type, hit.severity, hit.affected_table, hit.affected_column) == ("column_missing", "critical", "users", "email")
    assert hit.query == query                # the whole text
    assert impacts(spark, [], REMOVED_EMAIL) == [] and impacts(spark, [query], []) == []


def test_removed_index_slows_queries_on_its_columns(spark):
    (hit,) = impacts(spark, ["UPDATE users SET n = 1 WHERE users.email = 'q'", "SELECT users.id FROM users"], REMOVED_INDEX)
    assert (hit.impact_type, hit.severity, hit.affected_table) == ("index_missing", "medium", "users")


def test_summary_counts_what_the_list_has(spark):
    queries = ["SELECT email FROM users", "SELECT email, id FROM users u", "SELECT users.email FROM users, crates", "SELECT 1"]
    rows = [*REMOVED_EMAIL, *REMOVED_INDEX, ("column", "renamed", "users", "id", None, None)]
    q = spark.createDataFrame([(0, x) for x in queries], "log_id long, query string")
    m = spark.createDataFrame([(0, 0), (1, 0)], "migration_id long, db_id long")
    refs, changes = querylog.with_references(q), changes_df(spark, rows)
    listed = querylog.match_impacts(refs, changes, m).groupBy("impact_type").count().collect()
    summary = {r.migration_id: r for r in querylog.impact_summary(refs, changes, m).collect()}
    for r in listed:
        assert summary[0][r.impact_type] == r["count"]
    assert summary[0].n_impacts == sum(r["count"] for r in listed) and summary[0].worst_impact == "critical"
    assert summary[1].n_impacts == 0 and summary[1].worst_impact is None


def test_rename_and_type_change_and_case(spark):
    rows = [("column", "renamed", "Users", "Email", None, None),
            ("column", "type_changed", "users", "id", None, None)]
    r = impacts(spark, ["SELECT users.EMAIL, id FROM users"], rows)
    assert sorted((i.impact_type, i.severity, i.affected_column) for i in r) == [
        ("column_renamed", "high", "EMAIL"), ("type_mismatch", "medium", "id")]


def test_alias_is_not_resolved(spark):
    assert impacts(spark, ["SELECT u.email FROM users u"], REMOVED_EMAIL) == []


def test_index_overlap_rules(spark):
    rows = [("index", "removed", "users", None, "idx_name", ["name"])]
    # qualified columns that miss the index: no impact; unqualified-only query on the table: impact
    assert impacts(spark, ["SELECT users.email FROM users"], rows) == []
    assert len(impacts(spark, ["SELECT email FROM users"], rows)) == 1
    assert len(impacts(spark, ["SELECT users.name FROM users"], rows)) == 1
