"""Files read in ranges give the rows of the whole file, wherever they are cut."""

from __future__ import annotations

import pytest

from ddlscope.functions import fixed
from ddlscope.operators import catalog, extract, querylog
from ddlscope.sources import corpus, files, ranges

DIALECTS = {"postgres": 0, "mysql": 1, "sqlite": 2, "tsql": 3}


def hard_script(dialect: str) -> str:
    """Every template of the corpus in one script, and marks that are never closed at the end."""
    texts = [t for t, _ in corpus.TEMPLATES.values()] + [t if isinstance(t, str) else t[DIALECTS[dialect]] for t, _ in corpus.VARIANTS.values()]
    texts = [t.replace("{t}", "tab").replace("{c}", "col").replace("{i}", "idx").replace("{p}", "par") for t in texts]
    texts.insert(3, "INSERT INTO n VALUES ('two\n;\nlines', \"and\nid;\", $x$ a\n$y$;\nDROP TABLE no;\n$x$);")
    texts.insert(9, "/* a comment\n; DROP TABLE no;\n of lines */ DROP TABLE yes;")
    return "\n-- next; step's\n".join(t for t in texts if len(t) < 1000) + "\nDROP TABLE last; SELECT $5, it`s never closed;\nDROP TABLE end1\n"


def composed(lexer: ranges.Lexer, parts: list[str]) -> list[str]:
    """True start of each part by the maps, as the tasks compute them."""
    later = [set().union(*(lexer.marks(p) for p in parts[i + 1:])) if parts[i + 1:] else set() for i in range(len(parts))]
    tags = sorted({m for p in parts for m in lexer.marks(p) if m[0] == "$"})
    state, out = "", []
    for p, marks in zip(parts, later):
        out.append(state)
        ends, change = lexer.state_map(p, marks, tags)
        for start, end in ends.items():  # the map of a start is what a run from there finds
            assert lexer.run(p, start, marks)[0] == end
        state = ends[state] if state in ends else f"c{int(state[1:]) + change}"
    return out


@pytest.mark.parametrize("dialect", list(DIALECTS))
def test_states_at_every_cut(dialect):
    lexer, text = ranges.Lexer(dialect), hard_script(dialect)
    lines = text.splitlines(keepends=True)
    # a line at a time: the start of every line; a cut at any byte moves to the next line
    starts = composed(lexer, lines)
    assert "'" in starts and "c1" in starts and "$x$" in starts and starts[-1] == ""
    whole = [text]
    assert composed(lexer, whole) == [""]
    for k in range(1, len(lines)):
        parts = ["".join(lines[:k]), "".join(lines[k:])]
        assert composed(lexer, parts)[1] == starts[k]


def test_nested_comments_over_many_ranges():
    lexer = ranges.Lexer("postgres")
    parts = ["a /* 1\n", "/* 2 /* 3\n", "*/ x ; */\n", "/* 2\n", "*/ */ b;\n", "/* 1 */ c\n"]
    assert composed(lexer, parts) == ["", "c1", "c3", "c1", "c2", ""]


def op_rows(df):
    return sorted((r.migration_id.rsplit("/", 1)[-1], r.op_class, r.target_table, r.target_column or "", r.target_index or "", r.raw_sql)
                  for r in df.collect())


@pytest.mark.parametrize("block, chars", [(61, 1), (700, 300), (1 << 20, 97)])
def test_scripts_and_dumps_in_ranges(spark, tmp_path, block, chars):
    names = {"postgres": "V1__migration.sql", "mysql": "V2__mysql_migration.sql", "tsql": "V3__mssql_migration.sql"}
    for dialect, name in names.items():
        (tmp_path / name).write_text(hard_script(dialect))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        chunks = ranges.read_scripts(spark, str(tmp_path), chars)
        texts = {}
        for r in sorted(chunks.collect(), key=lambda r: r.chunk_id):
            texts.setdefault(r.file_name, []).append(r.text)
        for dialect, name in names.items():
            assert "".join(texts[name]) == hard_script(dialect) and len(texts[name]) > (5 if chars < 1000 else 0)
        whole = extract.extract_operations(files.read_scripts(spark, str(tmp_path)))
        found = extract.extract_operations(chunks)
        assert op_rows(found) == op_rows(whole) and len(op_rows(found)) > 60
        order = [r.raw_sql for r in found.filter("migration_id LIKE '%V1%'").orderBy("stmt_pos", "action_pos").collect()]
        assert order == [r.raw_sql for r in whole.filter("migration_id LIKE '%V1%'").orderBy("stmt_pos", "action_pos").collect()]

        dump = tmp_path / "schema" / "dump.sql"
        dump.parent.mkdir()
        dump.write_text("".join(f"CREATE TABLE t{i} (\n  a INTEGER NOT NULL,\n  b VARCHAR(9) DEFAULT ';\n',\n  PRIMARY KEY (a)\n);\n"
                                f"CREATE INDEX i{i} ON t{i} (b);\n" for i in range(30)) + "CREATE TABLE t3 (z TEXT);\n")
        for make in (catalog.catalog_columns, catalog.catalog_indexes):
            want = sorted(map(str, make(files.read_schema_dumps(spark, str(dump))).collect()))
            assert sorted(map(str, make(ranges.read_schema_dumps(spark, str(dump), chars)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


LOGS = {
    "slow.log": "".join(f"# Time: {i}\nSELECT a{i},\n b FROM t\nWHERE x = 'y';\nnoise\n" + ("UPDATE t SET a = 1; DELETE FROM u;\n" if i % 3 else "") for i in range(40)),
    "lines.log": "head; er SELECT no\n" + "".join(f"LOG: {i}\n  SELECT a{i % 7} FROM t\n" for i in range(60)),
    "one.log": "SELECT 1\nFROM t\n" * 30 + ";\n",
    "open.log": "SELECT 1;\n" + "SELECT 2 FROM t\n" * 20,
    "empty.log": "",
}


@pytest.mark.parametrize("chars", [1, 60, 1 << 20])
def test_logs_in_ranges(spark, tmp_path, chars):
    for name, text in LOGS.items():
        (tmp_path / name).write_text(text)

    def rows(logs):
        return sorted((r.log_id.rsplit("/", 1)[-1], r.query, r.frequency) for r in querylog.extract_queries(logs).collect())

    found = ranges.read_query_logs(spark, str(tmp_path), chars)
    assert rows(found) == rows(files.read_query_logs(spark, str(tmp_path)))
    if chars == 60:
        assert found.filter("log_id LIKE '%slow%'").count() > 10


def test_dialects_of_the_cases_are_those_of_file_names():
    assert set(DIALECTS) == {d for _, d in fixed.DIALECT_BY_NAME} | {fixed.DEFAULT_DIALECT}
