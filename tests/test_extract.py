"""Statement extraction (P1-P7): tables of statements with the operations they must give."""

from __future__ import annotations

import re

import pytest

from ddlscope.functions import fixed
from ddlscope.operators import extract
from helpers import parse

# statement -> [(class, table, column, index)]
CASES = {
    # ADD / DROP / RENAME / ALTER of columns
    "alter table depot add shelf int": [("ADD_COLUMN", "depot", "shelf", None)],
    "ALTER TABLE depot ADD COLUMN IF NOT EXISTS \"Shelf No\" INT": [("ADD_COLUMN", "depot", "Shelf No", None)],
    "ALTER TABLE depot DROP shelf CASCADE": [("DROP_COLUMN", "depot", "shelf", None)],
    'ALTER TABLE IF EXISTS ONLY "wh"."Depot" DROP COLUMN IF EXISTS "Aisle"': [("DROP_COLUMN", "Depot", "Aisle", None)],
    "ALTER TABLE depot RENAME shelf TO rack": [("RENAME_COLUMN", "depot", "shelf", None)],
    "ALTER TABLE depot RENAME TO store": [("RENAME_TABLE", "depot", None, None)],
    "ALTER TABLE depot MODIFY COLUMN shelf BIGINT": [("ALTER_COLUMN", "depot", "shelf", None)],
    # several actions
    "ALTER TABLE crate ADD lid TEXT, DROP handle, RENAME side TO wall": [
        ("ADD_COLUMN", "crate", "lid", None), ("DROP_COLUMN", "crate", "handle", None), ("RENAME_COLUMN", "crate", "side", None)],
    "ALTER TABLE crate ADD w NUMERIC(8, 3) DEFAULT pick(1, pick(2, (3))), DROP z": [
        ("ADD_COLUMN", "crate", "w", None), ("DROP_COLUMN", "crate", "z", None)],
    "ALTER TABLE crate ADD v INT CHECK (v IN (1, (2, ((3), (((4, 5))))))), DROP z": [
        ("ADD_COLUMN", "crate", "v", None), ("DROP_COLUMN", "crate", "z", None)],
    "ALTER TABLE crate ADD (a INT NOT NULL, b DECIMAL(4,1))": [("ADD_COLUMN", "crate", "a", None), ("ADD_COLUMN", "crate", "b", None)],
    "ALTER TABLE crate ADD note TEXT DEFAULT 'x, y; z', DROP z": [("ADD_COLUMN", "crate", "note", None), ("DROP_COLUMN", "crate", "z", None)],
    # keys and constraints
    "ALTER TABLE crate ADD CONSTRAINT c_d FOREIGN KEY (d) REFERENCES depot (id)": [("ADD_FOREIGN_KEY", "crate", None, None)],
    "ALTER TABLE crate ADD FOREIGN KEY (d) REFERENCES depot (id)": [("ADD_FOREIGN_KEY", "crate", None, None)],
    "ALTER TABLE crate ADD CONSTRAINT pos CHECK (w > 0)": [("ADD_CONSTRAINT", "crate", None, None)],
    "ALTER TABLE crate DROP CONSTRAINT pos": [("DROP_CONSTRAINT", "crate", None, None)],
    "ALTER TABLE crate DROP INDEX by_w": [("DROP_INDEX", "crate", None, "by_w")],
    "ALTER TABLE crate ADD INDEX by_w (w)": [("UNKNOWN", "crate", None, None)],
    # tables, views, indexes
    "CREATE TABLE IF NOT EXISTS wh.pallet (id INT, n VARCHAR(9) DEFAULT ';')": [("CREATE_TABLE", "pallet", None, None)],
    'CREATE TABLE "big pallet" (id INT)': [("CREATE_TABLE", "big pallet", None, None)],
    "DROP TABLE pallet": [("DROP_TABLE", "pallet", None, None)],
    'DROP TABLE IF EXISTS a, wh.b, "c;d" CASCADE': [("DROP_TABLE", "a", None, None), ("DROP_TABLE", "b", None, None), ("DROP_TABLE", "c;d", None, None)],
    "TRUNCATE ONLY a, wh.b RESTART IDENTITY": [("TRUNCATE_TABLE", "a", None, None), ("TRUNCATE_TABLE", "b", None, None)],
    "CREATE UNIQUE INDEX CONCURRENTLY IF NOT EXISTS one_w ON ONLY wh.crate(w)": [("CREATE_INDEX", "crate", None, "one_w")],
    "DROP INDEX by_w ON crate": [("DROP_INDEX", "crate", None, "by_w")],
    "DROP INDEX by_w": [("DROP_INDEX", "", None, "by_w")],
    "CREATE OR REPLACE VIEW full_crates AS SELECT 1": [("CREATE_VIEW", "full_crates", None, None)],
    "DROP VIEW IF EXISTS full_crates": [("DROP_VIEW", "full_crates", None, None)],
    "CREATE SEQUENCE tally START 5": [("UNKNOWN", "tally", None, None)],
    # not DDL, or nothing at all
    "INSERT INTO crate VALUES ('a; DROP TABLE b')": [],
    "GRANT SELECT ON crate TO clerk": [],
    "": [],
    "-- only a remark\n  -- and another": [],
    "/* DROP TABLE a; */": [],
    # comments and quotes
    "ALTER TABLE t /* wide, r; */ ADD c INT; -- add; DROP TABLE u;\n/* two\nlines */ DROP VIEW v": [
        ("ADD_COLUMN", "t", "c", None), ("DROP_VIEW", "v", None, None)],
    "ALTER TABLE t ADD c TEXT DEFAULT 'a'; -- old; DROP TABLE users; gone": [("ADD_COLUMN", "t", "c", None)],
    "ALTER TABLE t ADD c TEXT DEFAULT '/*'; DROP TABLE u; ALTER TABLE t ADD d TEXT DEFAULT '*/'": [
        ("ADD_COLUMN", "t", "c", None), ("DROP_TABLE", "u", None, None), ("ADD_COLUMN", "t", "d", None)],
    "INSERT INTO t VALUES ('it''s -- not a remark'); DROP TABLE u": [("DROP_TABLE", "u", None, None)],
    "CREATE FUNCTION tidy() RETURNS void AS $$ BEGIN DROP TABLE x; END $$ LANGUAGE sql; DROP TABLE y": [
        ("UNKNOWN", "tidy", None, None), ("DROP_TABLE", "y", None, None)],
    "CREATE FUNCTION g() RETURNS void AS $q$ DROP TABLE x; $$ ; $q$ LANGUAGE sql": [("UNKNOWN", "g", None, None)],
    "INSERT INTO t VALUES ('never closed); DROP TABLE y": [("DROP_TABLE", "y", None, None)],
}


def test_statements_give_their_operations(spark):
    from ddlscope.operators import extract

    names = list(CASES)
    df = spark.createDataFrame([(i, t, "postgres") for i, t in enumerate(names)], "migration_id long, text string, dialect string")
    got = {i: [] for i in range(len(names))}
    for r in extract.extract_operations(df).orderBy("migration_id", "stmt_pos", "action_pos").collect():
        got[r.migration_id].append((r.op_class, r.target_table, r.target_column, r.target_index))
    assert {names[i]: ops for i, ops in got.items()} == CASES


@pytest.mark.parametrize("column,notes", [
    ("n INT NOT NULL", [fixed.NOTE_NOT_NULL_NO_DEFAULT]),
    ("n INT NOT NULL DEFAULT 4", []),
    ("n INT", []),
    ("n INT CHECK (n IS NOT NULL)", []),
    ("n TEXT NOT NULL CHECK (n <> 'DEFAULT')", [fixed.NOTE_NOT_NULL_NO_DEFAULT]),
    ("n TEXT DEFAULT 'NOT NULL'", []),
])
def test_not_null_note_reads_the_column_clause_only(spark, column, notes):
    assert parse(spark, f"ALTER TABLE bin ADD COLUMN {column};")[0].parser_notes == notes


def test_notes_of_indexes_and_removals(spark):
    ops = parse(spark, "CREATE INDEX i ON t (a); CREATE INDEX CONCURRENTLY j ON t (a); DROP TABLE a, b; TRUNCATE c;")
    assert [o.parser_notes for o in ops] == [[fixed.NOTE_INDEX_BLOCKING], [fixed.NOTE_INDEX_CONCURRENT],
                                             [fixed.NOTE_DROP_TABLE], [fixed.NOTE_DROP_TABLE], [fixed.NOTE_TRUNCATE]]
    assert [(o.stmt_pos, o.action_pos) for o in ops] == [(0, 0), (1, 0), (2, 0), (2, 1), (3, 0)]


def test_statements_of_any_length_and_depth(spark):
    values = ", ".join(["'a;b'", "1"] * 150_000)                      # over a megabyte
    checks = ", ".join(str(i) for i in range(10_000))
    deep = "(" * 400 + "1" + ")" * 400
    ops = parse(spark, f"INSERT INTO t VALUES ({values});\n"
                       f"ALTER TABLE t ADD a INT CHECK (a IN ({checks})), DROP b;\n"
                       f"ALTER TABLE t ADD c INT DEFAULT {deep}, DROP d;\n"
                       f"CREATE TABLE w ({', '.join(f'c{i} VARCHAR({i}) DEFAULT {chr(39)}x{chr(39)}' for i in range(1, 401))});")
    assert [(o.op_class, o.target_column) for o in ops] == [
        ("ADD_COLUMN", "a"), ("DROP_COLUMN", "b"), ("ADD_COLUMN", "c"), ("DROP_COLUMN", "d"), ("CREATE_TABLE", None)]
    assert ops[0].raw_sql.endswith("9999))")


def test_script_in_chunks_equals_the_whole(spark):
    from ddlscope.operators import extract

    parts = ["-- first\nDROP TABLE a; INSERT INTO b VALUES ('x;y');\n", "ALTER TABLE c ADD d INT, DROP e;\n", "\n-- none\n", "TRUNCATE f, g;"]
    whole = spark.createDataFrame([(1, "".join(parts), "postgres")], "migration_id long, text string, dialect string")
    chunks = spark.createDataFrame([(1, i, t, "postgres") for i, t in enumerate(parts)],
                                   "migration_id long, chunk_id long, text string, dialect string")

    def rows(df):
        order = ["stmt_pos", "action_pos"]
        return [(r.action_pos, r.op_class, r.target_table, r.target_column) for r in extract.extract_operations(df).orderBy(*order).collect()]

    assert rows(chunks) == rows(whole) and len(rows(whole)) == 5
    positions = [r.stmt_pos for r in extract.extract_operations(chunks).orderBy("stmt_pos", "action_pos").collect()]
    assert positions == sorted(positions) and len(set(positions)) == 3


def test_words_are_the_same_however_a_statement_is_cut(spark):
    stmts = ["ALTER TABLE users ADD COLUMN age INT", "CREATE INDEX i ON users (email)", "CREATE INDEX i ON users(email)", "create  table t\t(a int)",
             "CREATE INDEX i ON t ((lower(a)), b )", "ALTER TABLE t\nADD\x0bc\x0cINT", "( a", "a (", "", "x", "RENAME TABLE a TO straße",
             "DROP TABLE t " + " ".join(f"w{i} (" for i in range(20)), "CREATE TABLE a\u0001b (c INT)", "a b c"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stmts)], "n int, stmt string")
    for r in extract.with_tokens(df, "stmt").collect():
        text = stmts[r.n].replace("(", " ( ")
        words = re.split(r"[ \t\n\r\x0b\x0c]+", text, maxsplit=extract.N_TOKENS - 1)
        assert [w.split() for w in r._toks] == [w.split() for w in words], stmts[r.n]
        assert r._toks[:15] == words[:15] and r._up == [w.upper() for w in r._toks]
    quoted = spark.createDataFrame([('DROP TABLE "straße weg" (x)',)], "stmt string")
    assert extract.with_tokens(quoted, "stmt").select("_up").first()[0] == ["DROP", "TABLE", '"STRASSE WEG"', "(", "X)"]
