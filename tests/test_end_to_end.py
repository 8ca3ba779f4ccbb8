"""File inputs -> full analysis -> reports; the streamed log follower."""

from __future__ import annotations

import json

import pytest

from ddlscope.plans import report
from ddlscope.plans.analysis import Analysis

SCHEMA = """CREATE TABLE users (
    id         BIGSERIAL PRIMARY KEY,
    email      VARCHAR(255) NOT NULL,
    nickname   VARCHAR(100) NOT NULL,
    old_token  VARCHAR(512)
);
CREATE INDEX idx_users_email ON users (email);
CREATE TABLE invoices (
    id       BIGSERIAL PRIMARY KEY,
    user_id  BIGINT NOT NULL,
    FOREIGN KEY (user_id) REFERENCES users (id)
);
"""
MIGRATION = """-- mixed risk
ALTER TABLE users ADD COLUMN seen_at TIMESTAMP NOT NULL DEFAULT NOW();

DROP INDEX idx_users_email;
CREATE TABLE audit_trail (
    id BIGSERIAL PRIMARY KEY,
    note TEXT NOT NULL
);
"""
LOG = "SELECT * FROM users WHERE email = 'x@y.com';\nSELECT id FROM invoices WHERE user_id = 3;\n"


@pytest.fixture(scope="module")
def analysis(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("inputs")
    (d / "0042_add_seen_at.sql").write_text(MIGRATION)
    (d / "schema.sql").write_text(SCHEMA)
    (d / "slow.log").write_text(LOG)
    return Analysis.from_files(spark, str(d / "0042_add_seen_at.sql"), str(d / "schema.sql"), str(d / "slow.log"))


def test_operations_and_scores(analysis):
    ops = analysis.ops.orderBy("stmt_pos").collect()
    assert [(o.op_class, o.risk_level, o.risk_score) for o in ops] == [
        ("ADD_COLUMN", "safe", 0), ("DROP_INDEX", "low", 20), ("CREATE_TABLE", "safe", 0)]
    assert ops[1].target_table == "users"            # resolved through the catalogue
    s = analysis.scores.collect()[0]
    assert (s.overall_score, s.overall_level, s.blocked, s.dialect) == (20, "low", False, "postgres")


def test_impacts(analysis):
    imp = analysis.impacts.collect()
    assert [(i.impact_type, i.affected_table) for i in imp] == [("index_missing", "users")]
    assert imp[0].description.startswith("Index `idx_users_email` on `users` is being dropped.")


def test_markdown_lines(analysis):
    ordered = report.markdown_lines(analysis).orderBy("migration_id", "section", "k1", "k2", "k3")
    lines = [r.line for r in ordered.collect()]
    text = "\n".join(lines)
    assert lines[0] == "## Migration Risk Report — `0042_add_seen_at.sql`"
    assert "**Risk Score:** 🟢 **LOW** (20/100)  |  **Dialect:** postgres 14  |  **Operations:** 3" in text
    assert text.count("<details><summary>") == 3
    assert "<details><summary>🟢 **DROP_INDEX** on `users` — LOW</summary>" in text
    assert "### ⚡ Affected Queries (1)" in text
    assert "### Rollback Complexity: ✅ SAFE" in text
    assert "- Estimated rollback window: **~5 minutes**" in text


def test_markdown_with_rewrites_and_summaries(spark, analysis):
    mid = analysis.scores.collect()[0].migration_id
    rewrites = spark.createDataFrame([(mid, 1, 0, "DROP INDEX CONCURRENTLY idx_users_email;")],
                                     "migration_id string, stmt_pos int, action_pos int, safe_rewrite string")
    summaries = spark.createDataFrame([(mid, "Low risk.", "All fine.")], "migration_id string, plain_english_summary string, stakeholder_summary string")
    df = report.markdown_lines(analysis, rewrites=rewrites, summaries=summaries)
    lines = [r.line for r in df.orderBy("migration_id", "section", "k1", "k2", "k3", "k4").collect()]
    at = lines.index("**💡 Suggested safe rewrite:**")
    assert lines[at - 1:at + 5] == ["", "**💡 Suggested safe rewrite:**", "```sql", "DROP INDEX CONCURRENTLY idx_users_email;", "```", ""]
    assert lines.count("```sql") == 1
    assert lines[-14:-2] == ["<details><summary>🤖 AI Risk Analysis (click to expand)</summary>", "", "Low risk.", "", "</details>", "",
                             "<details><summary>📊 Stakeholder Summary</summary>", "", "All fine.", "", "</details>", ""]


def test_json_records(analysis):
    recs = [json.loads(r.json) for r in report.json_records(analysis).collect()]
    kinds = sorted(r["record"] for r in recs)
    assert kinds == ["impact", "operation", "operation", "operation", "report", "rollback_step", "rollback_step", "rollback_step"]
    rep = next(r for r in recs if r["record"] == "report")
    assert (rep["overall_risk_score"], rep["overall_risk_level"], rep["rollback"]["estimated_minutes"]) == (20, "low", 5)
    assert rep["impact_summary"]["index_missing"] == 1


def test_no_schema_means_no_impacts(spark, tmp_path):
    (tmp_path / "m.sql").write_text("ALTER TABLE users DROP COLUMN email;")
    (tmp_path / "q.log").write_text("SELECT email FROM users;")
    a = Analysis.from_files(spark, str(tmp_path / "m.sql"), None, str(tmp_path / "q.log"))
    assert a.impacts.count() == 0
    assert a.scores.collect()[0].overall_level == "high"


def test_streamed_logs(spark, analysis, tmp_path):
    from ddlscope.streaming.querylog_stream import start_impact_stream

    logs = tmp_path / "logs" / "0"
    logs.mkdir(parents=True)
    (logs / "a.log").write_text(LOG)
    out = str(tmp_path / "out")
    q = start_impact_stream(spark, str(tmp_path / "logs" / "*"), analysis.changes, analysis.migrations, out,
                            checkpoint=str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert [(r.impact_type, r.affected_table) for r in rows] == [("index_missing", "users")]


def test_logs_of_both_modes_together(spark, tmp_path):
    (tmp_path / "m.sql").write_text("ALTER TABLE users DROP COLUMN email;")
    (tmp_path / "schema.sql").write_text(SCHEMA)
    (tmp_path / "a.log").write_text("SELECT id FROM invoices;\n")
    (tmp_path / "b.log").write_text("SELECT email FROM users\nSELECT id FROM invoices\n")
    a = Analysis.from_files(spark, str(tmp_path / "m.sql"), str(tmp_path / "schema.sql"), [str(tmp_path / "a.log"), str(tmp_path / "b.log")])
    assert [(i.impact_type, i.query) for i in a.impacts.collect()] == [("column_missing", "SELECT email FROM users")]


def test_write_reports(spark, analysis, tmp_path):
    import glob

    out = str(tmp_path / "reports")
    report.write_reports(analysis, out)
    md = "".join(open(p).read() for p in sorted(glob.glob(f"{out}/markdown/part-*")))
    assert md.startswith("## Migration Risk Report — `0042_add_seen_at.sql`\n")
    assert md.rstrip().endswith("*Generated • 1970-01-01 00:00 UTC*")
    recs = [json.loads(x) for p in sorted(glob.glob(f"{out}/json/part-*")) for x in open(p) if x.strip()]
    assert recs[0]["record"] == "report" and [r["stmt_pos"] for r in recs if r["record"] == "operation"] == [0, 1, 2]
    s = spark.read.parquet(f"{out}/summary").collect()[0]
    assert (s.overall_level, s.blocked, s.n_impacts) == ("low", False, 1)
