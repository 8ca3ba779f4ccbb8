"""File sources (S1-S5): whole-text readers, dialect and migration-file rules."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ddlscope.sources import files


def test_dialect_from_name_and_path(spark):
    names = ["db/0001_mysql_add.sql", "sqlite/0002_add.sql", "x/MSSQL_fix.sql", "sqlserver_y.sql", "plain.sql"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = df.select(files.infer_dialect(F.col("p")).alias("n"),
                    files.infer_dialect(F.col("p"), scope="path").alias("w")).collect()
    assert [r.n for r in got] == ["mysql", "postgres", "tsql", "tsql", "postgres"]
    assert [r.w for r in got] == ["mysql", "sqlite", "tsql", "tsql", "postgres"]


def test_is_migration_file(spark):
    names = ["V1__Migrate.sql", "schema.sql", "0001_create_users.sql", "notes.txt", "alter/readme.md"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(files.is_migration_file(F.col("p"))).collect()] == [
        True, True, True, False, False]


def test_read_scripts_whole_files(spark, tmp_path):
    (tmp_path / "0001_mysql_init.sql").write_text("CREATE TABLE a (id INT);\nDROP TABLE b;\n")
    (tmp_path / "0002_more.sql").write_text("ALTER TABLE a ADD COLUMN c INT;\n")
    rows = {r.file_name: r for r in files.read_scripts(spark, str(tmp_path / "*.sql")).collect()}
    assert set(rows) == {"0001_mysql_init.sql", "0002_more.sql"}
    assert rows["0001_mysql_init.sql"].dialect == "mysql"
    assert rows["0001_mysql_init.sql"].text.count("\n") == 2      # one row holds the whole file


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_scripts(spark, str(tmp_path / "nope.sql")).collect()


def test_query_log_drops_invalid_utf8(spark, tmp_path):
    (tmp_path / "q.log").write_bytes(b"SELECT a FROM t\xff WHERE x = 1;\n")
    r = files.read_query_logs(spark, str(tmp_path / "q.log")).collect()[0]
    assert r.text == "SELECT a FROM t WHERE x = 1;\n"
