"""Whole documents: shape, order, pieces of bounded size, one file per migration."""

from __future__ import annotations

import glob
import json
import time

import pytest

from ddlscope.plans import documents, report
from ddlscope.plans.analysis import Analysis

SCHEMA = """CREATE TABLE users (id BIGINT PRIMARY KEY, email VARCHAR(255) NOT NULL);
CREATE INDEX idx_users_email ON users (email);
"""
FIRST = "ALTER TABLE users DROP COLUMN email;\nDROP INDEX idx_users_email;\nCREATE TABLE a (\"quote \"\"x\" TEXT DEFAULT 'b\\c');\n"
LOG = "SELECT email FROM users;\nSELECT id FROM users WHERE email = 'é\"';\n"


@pytest.fixture(scope="module")
def analysis(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("inputs")
    (d / "schema.sql").write_text(SCHEMA)
    (d / "slow.log").write_text(LOG)
    (d / "m").mkdir()
    (d / "m" / "1_first.sql").write_text(FIRST)
    (d / "m" / "2_none.sql").write_text("SELECT 1;")
    (d / "m" / "3_many.sql").write_text("".join(f"ALTER TABLE t{i} ADD COLUMN c{i} INT;\n" for i in range(400)))
    return Analysis.from_files(spark, str(d / "m" / "*.sql"), str(d / "schema.sql"), str(d / "slow.log")).shared()


def _docs(pieces):
    return {d["migration_file"]: d for d in (json.loads(r.document) for r in documents.whole(pieces).collect())}


def test_report_holds_everything_in_order(analysis):
    docs = _docs(documents.report_pieces(analysis, schema_file="schema.sql"))
    assert sorted(docs) == ["1_first.sql", "2_none.sql", "3_many.sql"]
    first = docs["1_first.sql"]
    assert list(first) == ["migration_file", "schema_file", "query_log_file", "generated_at", "dialect", "db_version", "operations", "query_impacts",
                           "rollback", "plain_english_summary", "stakeholder_summary", "safe_rewrite_sql"]
    assert [o["operation_class"] for o in first["operations"]] == ["DROP_COLUMN", "DROP_INDEX", "CREATE_TABLE"]
    assert first["operations"][2]["raw_sql"] == "CREATE TABLE a (\"quote \"\"x\" TEXT DEFAULT 'b\\c')"
    assert [i["impact_type"] for i in first["query_impacts"]] == sorted(i["impact_type"] for i in first["query_impacts"])
    assert len(first["query_impacts"]) == analysis.impacts.count() and any("é\"" in i["query"] for i in first["query_impacts"])
    assert len(first["rollback"]["steps"]) == 3 and first["rollback"]["data_loss_risk"] is True
    assert first["schema_file"] == "schema.sql" and first["safe_rewrite_sql"] is None
    none = docs["2_none.sql"]
    assert (none["operations"], none["query_impacts"], none["rollback"]["steps"], none["rollback"]["complexity"]) == ([], [], [], "safe")
    assert [o["target_column"] for o in docs["3_many.sql"]["operations"]] == [f"c{i}" for i in range(400)]


def test_small_pieces_give_the_same_documents(analysis):
    pieces = documents.report_pieces(analysis, piece_bytes=2000)
    assert pieces.selectExpr("max(octet_length(text))").first()[0] < 4000       # a piece and the entry that crosses its limit
    assert _docs(pieces) == _docs(documents.report_pieces(analysis))
    assert pieces.groupBy("migration_id", "part").count().agg({"count": "max"}).first()[0] > 20


def test_small_migrations_are_not_ranged(analysis):
    whole = documents.whole(documents.report_pieces(analysis))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "RepartitionByExpression [migration_id" in plan and "key" not in plan.split("RepartitionByExpression", 1)[1].split("]")[0]
    # one migration beyond a piece: only its lists are cut
    pieces = documents.report_pieces(analysis, piece_bytes=20000)
    counts = pieces.filter("part IN (1, 3, 5)").groupBy("migration_id").agg({"*": "count", "part": "max"}).collect()
    assert sorted(r["count(1)"] for r in counts)[0] == 3 and max(r["count(1)"] for r in counts) > 5
    assert _docs(pieces) == _docs(documents.report_pieces(analysis))


def test_texts_written_elsewhere(spark, analysis):
    mid = [r.migration_id for r in analysis.migrations.filter("file_name = '1_first.sql'").collect()][0]
    rewrites = spark.createDataFrame([(mid, 0, 0, 'ALTER "a"\n;'), (mid, 1, 0, "DROP INDEX CONCURRENTLY i;"), (mid, 2, 0, "")],
                                     "migration_id string, stmt_pos int, action_pos int, safe_rewrite string")
    summaries = spark.createDataFrame([(mid, "Risky.", None)], "migration_id string, plain_english_summary string, stakeholder_summary string")
    docs = _docs(documents.report_pieces(analysis, rewrites=rewrites, summaries=summaries, piece_bytes=10))
    d = docs["1_first.sql"]
    assert d["safe_rewrite_sql"] == ('-- Rewrite for: DROP_COLUMN on users\nALTER "a"\n;\n\n'
                                     "-- Rewrite for: DROP_INDEX on users\nDROP INDEX CONCURRENTLY i;")
    assert (d["plain_english_summary"], d["stakeholder_summary"]) == ("Risky.", None)
    assert [o["safe_rewrite"] for o in d["operations"]] == ['ALTER "a"\n;', "DROP INDEX CONCURRENTLY i;", ""]
    assert docs["3_many.sql"]["safe_rewrite_sql"] is None


def test_payload_and_findings(analysis):
    first = _docs(documents.payload_pieces(analysis))["1_first.sql"]
    assert (first["overall_risk_level"], first["operations"][0]["operation"], first["operations"][0]["affected_queries"]) == ("high", "DROP_COLUMN", [])   # 70, and 5 for the index
    assert sorted(first["query_impacts"][0]) == ["description", "impact_type", "query", "severity"]
    found = {r.migration_id: json.loads(r.document) for r in documents.whole(documents.finding_pieces(analysis)).collect()}
    assert sorted(len(d["operations"]) for d in found.values()) == [0, 3, 400]


def test_one_file_per_migration(spark, analysis, tmp_path):
    documents.write_documents(documents.report_pieces(analysis), str(tmp_path / "json"))
    documents.write_documents(documents.markdown_pieces(analysis, piece_bytes=3000), str(tmp_path / "markdown"))
    files = glob.glob(f"{tmp_path}/json/migration_id=*/part-*.txt")
    assert len(files) == 3 and len(set(f.rsplit("/", 1)[0] for f in files)) == 3
    assert sorted(json.load(open(f))["migration_file"] for f in files) == ["1_first.sql", "2_none.sql", "3_many.sql"]
    lines = {}
    for r in report.markdown_lines(analysis).orderBy("migration_id", "section", "k1", "k2", "k3", "k4").collect():
        lines.setdefault(r.migration_id, []).append(r.line)
    texts = sorted(open(f, encoding="utf-8").read() for f in glob.glob(f"{tmp_path}/markdown/migration_id=*/part-*.txt"))
    assert texts == sorted("\n".join(x) + "\n" for x in lines.values())


def test_empty_corpus(spark, analysis):
    nothing = Analysis(spark=spark, scripts=analysis.scripts.limit(0), table_stats=analysis.table_stats, schema_dumps=analysis.schema_dumps,
                       query_logs=analysis.query_logs.limit(0))
    assert documents.whole(documents.report_pieces(nothing)).count() == 0


@pytest.mark.parametrize("piece_bytes", [documents.PIECE_BYTES, 20000, 300])
def test_all_documents_equal_their_pieces(analysis, piece_bytes):
    # no migration, one, or all but the empty one go beyond a piece
    got = {(r.kind, r.migration_id): r.document for r in documents.all_documents(analysis, piece_bytes).collect()}
    want = {(kind, r.migration_id): r.document for kind, pieces in (("report", documents.report_pieces), ("payload", documents.payload_pieces),
                                                                    ("findings", documents.finding_pieces)) for r in documents.whole(pieces(analysis)).collect()}
    assert len(want) == 9 and got == want


def test_operations_and_impacts_move_once(analysis):
    plan = documents.all_documents(analysis)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert len([x for x in plan if "Relation [" in x and "raw_sql" in x]) == 1
    assert len([x for x in plan if "Relation [" in x and "impact_type" in x]) == 1
    assert len([x for x in plan if "RepartitionByExpression [migration_id" in x]) == 2


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    from ddlscope.session import written

    def files():
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (local.apply(i) for i in range(local.length())) if f.getName().startswith("shuffle_")}

    before = files()
    rows = spark.range(1000).repartition(5)
    table = written(rows.groupBy((rows.id % 7).alias("k")).count(), "few")
    left = files() - before
    for _ in range(50):
        if left:
            time.sleep(0.1)
            left = files() - before
    assert not left and table.count() == 7
