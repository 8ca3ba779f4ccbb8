"""Analysis inputs derived from the driver's tables.

The driver's tables hold no SQL text, so the corpus turns rows into the
inputs the analysis reads, deterministically and with column expressions
only (no Python per row):

* ``scripts``: one migration script per ``orders`` row; one statement per
  ``lineitem`` row of that order.  The statement template is
  ``l_partkey % 17`` (the last has variants by ``l_suppkey % 17``); the table, column and index it touches are picked from
  the catalogue by ``l_suppkey``.  Statements are ordered by
  ``(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)``,
  which is unique per order.  Orders without line items give op-less
  migrations.  The file name carries the dialect (``o_orderkey % 4``) and
  ``db_version = 9 + o_custkey % 6``.  A migration runs against database
  ``db_id = o_custkey div 10``.
* ``query_logs``: one log per ``events.user_id`` (= ``db_id``), stored in
  chunks of at most ``LOG_CHUNK`` consecutive event ids; each event is one
  logged query built from ``event_type`` and ``value``.  Even users write
  ``;``-terminated slow-log style, odd users one query per line.
* ``schema dump``: CREATE TABLE / CREATE INDEX text for the catalogue
  tables, column types from the parquet schemas.
* ``table_stats``: real ``count(*)`` of every catalogue table.

The same template definitions also render the expected values as SQL
(``expected_*_sql``), so the DuckDB oracle computes the answer from the
generator parameters instead of re-parsing the text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.functions import fixed
from ddlscope.session import read_table

# ---------------------------------------------------------------------------
# Catalogue of the driver's tables (corpus parameters)
# ---------------------------------------------------------------------------
CATALOG_TABLES = ["orders", "lineitem", "customer", "part", "supplier", "nation", "region", "events"]
CATALOG_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
PRIMARY_KEYS = {
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"],
    "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"],
    "region": ["r_regionkey"], "events": ["event_id"],
}
# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
]
INDEXES = {
    "orders": [("idx_orders_custkey", ["o_custkey"]), ("idx_orders_date", ["o_orderdate"])],
    "lineitem": [("idx_lineitem_orderkey", ["l_orderkey"]),
                 ("idx_lineitem_part_supp", ["l_partkey", "l_suppkey"]),
                 ("idx_lineitem_shipdate", ["l_shipdate"])],
    "customer": [("idx_customer_nation", ["c_nationkey"]), ("idx_customer_segment", ["c_mktsegment"])],
    "part": [("idx_part_brand", ["p_brand"])],
    "supplier": [("idx_supplier_nation", ["s_nationkey"])],
    "nation": [("idx_nation_region", ["n_regionkey"])],
    "region": [("idx_region_name", ["r_name"])],
    "events": [("idx_events_user", ["user_id"]), ("idx_events_ts", ["ts"]), ("idx_events_type", ["event_type"])],
}
# columns declared NOT NULL in the schema dump: key and foreign-key columns
NOT_NULL_COLUMNS = {t: [c for c in CATALOG_COLUMNS[t]
                        if c in PRIMARY_KEYS[t] or any(fk[0] == t and fk[1] == c for fk in FOREIGN_KEYS)]
                    for t in CATALOG_TABLES}
# type class of each catalogue column in the driver's parquet files
TYPE_CLASS = {
    "orders": ["num", "num", "str", "num", "ts", "str"],
    "lineitem": ["num", "num", "num", "num", "num", "num", "num", "num", "str", "str", "ts"],
    "customer": ["num", "str", "num", "num", "str"],
    "part": ["num", "str", "str", "str", "num", "num"],
    "supplier": ["num", "str", "num", "num"],
    "nation": ["num", "str", "num"],
    "region": ["num", "str"],
    "events": ["num", "ts", "num", "str", "num", "str"],
}
DEFAULTS = {"o_orderstatus": "'O'", "p_size": "0", "event_type": "'view'"}
FK_PARENT = {"orders": "customer", "lineitem": "orders", "customer": "nation", "part": "supplier",
             "supplier": "nation", "nation": "region", "region": "nation", "events": "customer"}

N_TEMPLATES = 17
N_VARIANTS = 17
DIALECT_FILES = ["migration", "mysql_migration", "sqlite_changes", "mssql_migration"]
DB_PER_CUSTOMER_DIV = 10
LOG_CHUNK = 4096

# ---------------------------------------------------------------------------
# Statement templates.  Placeholders: {t} table, {c} column of {t}, {i} index
# of {t}, {p} parent table of {t}, {k} its key, {n} line number.
# ``ops`` lists what the statement must be classified as:
# (action_pos, class, table, column, index, notes)
# ---------------------------------------------------------------------------
N_ = fixed.NOTE_NOT_NULL_NO_DEFAULT
TEMPLATES = {
    0: ("ALTER TABLE {t} ADD COLUMN x_{c} TEXT;",
        [(0, "ADD_COLUMN", "{t}", "x_{c}", None, [])]),
    1: ("ALTER TABLE {t} ADD COLUMN x_{c} INTEGER NOT NULL;",
        [(0, "ADD_COLUMN", "{t}", "x_{c}", None, [N_])]),
    2: ("ALTER TABLE {t} ADD COLUMN IF NOT EXISTS x_{c} TIMESTAMP NOT NULL DEFAULT NOW();",
        [(0, "ADD_COLUMN", "{t}", "x_{c}", None, [])]),
    3: ("ALTER TABLE {t} DROP COLUMN {c};",
        [(0, "DROP_COLUMN", "{t}", "{c}", None, [])]),
    4: ("ALTER TABLE public.{t} ALTER COLUMN \"{c}\" TYPE NUMERIC(18,4) USING {c}::numeric;",
        [(0, "ALTER_COLUMN", "{t}", "{c}", None, [])]),
    5: ("ALTER TABLE {t} RENAME COLUMN {c} TO {c}_old;",
        [(0, "RENAME_COLUMN", "{t}", "{c}", None, [])]),
    6: ("ALTER TABLE {t} RENAME TO {t}_archive;",
        [(0, "RENAME_TABLE", "{t}", None, None, [])]),
    7: ("CREATE TABLE IF NOT EXISTS {t}_audit (\n    id BIGINT PRIMARY KEY,\n    {c} VARCHAR(100) NOT NULL,\n"
        "    amount DECIMAL(10,2) DEFAULT 0,\n    note TEXT DEFAULT 'a;b'\n);",
        [(0, "CREATE_TABLE", "{t}_audit", None, None, [])]),
    8: ("DROP TABLE IF EXISTS {t};",
        [(0, "DROP_TABLE", "{t}", None, None, [fixed.NOTE_DROP_TABLE])]),
    9: ("TRUNCATE TABLE {t};",
        [(0, "TRUNCATE_TABLE", "{t}", None, None, [fixed.NOTE_TRUNCATE])]),
    10: ("CREATE INDEX idx_{t}_{c} ON {t} ({c});",
         [(0, "CREATE_INDEX", "{t}", None, "idx_{t}_{c}", [fixed.NOTE_INDEX_BLOCKING])]),
    11: ("CREATE UNIQUE INDEX CONCURRENTLY uq_{t}_{c} ON {t} USING btree ({c});",
         [(0, "CREATE_INDEX", "{t}", None, "uq_{t}_{c}", [fixed.NOTE_INDEX_CONCURRENT])]),
    12: ("DROP INDEX {i};",
         [(0, "DROP_INDEX", "{t}", None, "{i}", [])]),
    13: ("ALTER TABLE {t} ADD CONSTRAINT fk_{t}_{c} FOREIGN KEY ({c}) REFERENCES {p} ({k});",
         [(0, "ADD_FOREIGN_KEY", "{t}", None, None, [])]),
    14: ("ALTER TABLE {t} ADD CONSTRAINT chk_{t}_{c} CHECK ({c} IS NOT NULL);",
         [(0, "ADD_CONSTRAINT", "{t}", None, None, [])]),
    15: ("ALTER TABLE {t}\n    ADD COLUMN x_{c} NUMERIC(12,2) DEFAULT 0.00,\n    DROP COLUMN {c};",
         [(0, "ADD_COLUMN", "{t}", "x_{c}", None, []),
          (1, "DROP_COLUMN", "{t}", "{c}", None, [])]),
}
# template 16 has variants chosen by l_suppkey; those from 5 on are hard to cut: nested
# parentheses and comments, a dollar body, a long literal and list, name lists, quoted names;
# 10 and 11 are written in the script's dialect (by DIALECT_FILES) and mean the same in each.
# An operation's seventh item is the number of its statement in the text.
VARIANTS = {
    0: ("INSERT INTO {t}_log (note) VALUES ('x, y; z');", []),
    1: ("CREATE OR REPLACE VIEW v_{t} AS SELECT * FROM {t};",
        [(0, "CREATE_VIEW", "v_{t}", None, None, [])]),
    2: ("DROP VIEW IF EXISTS v_{t};",
        [(0, "DROP_VIEW", "v_{t}", None, None, [])]),
    3: ("ALTER TABLE {t} DROP CONSTRAINT chk_{t};",
        [(0, "DROP_CONSTRAINT", "{t}", None, None, [])]),
    4: ("CREATE SEQUENCE {t}_seq START 1;",
        [(0, "UNKNOWN", "{t}_seq", None, None, [])]),
    5: ("ALTER TABLE {t} ADD COLUMN y_{c} INTEGER CHECK (y_{c} IS NOT NULL AND y_{c} IN (1, (2), ((3), (((4))))) "
        "/* none, of; these */), DROP COLUMN {c}; -- done; DROP TABLE {t};",
        [(0, "ADD_COLUMN", "{t}", "y_{c}", None, []),
         (1, "DROP_COLUMN", "{t}", "{c}", None, [])]),
    6: ("CREATE FUNCTION f_{t}() RETURNS void AS $body$ BEGIN; DROP TABLE {t}; TRUNCATE {t}; END; $body$ LANGUAGE plpgsql;",
        [(0, "UNKNOWN", "f_{t}", None, None, [])]),
    7: ("INSERT INTO {t}_log (note, n) VALUES ('it''s; /* no */ -- comment; DROP TABLE {t}; " + "x" * 900 + "', 1" + ", 1" * 900 + ");", []),
    8: ('DROP TABLE IF EXISTS {t}_a, "{t} b" CASCADE;',
        [(0, "DROP_TABLE", "{t}_a", None, None, [fixed.NOTE_DROP_TABLE]),
         (1, "DROP_TABLE", "{t} b", None, None, [fixed.NOTE_DROP_TABLE])]),
    9: ('ALTER TABLE "public"."{t}" ADD ("n 1" INTEGER NOT NULL, n2 NUMERIC(4,2) DEFAULT 0);',
        [(0, "ADD_COLUMN", "{t}", "n 1", None, [N_]),
         (1, "ADD_COLUMN", "{t}", "n2", None, [])]),
    10: ({0: "/* a /* b */ DROP TABLE ghost; */ ALTER TABLE {t} ADD COLUMN z_{c} TEXT DEFAULT E'it\\'s; DROP TABLE {t}';",
          1: "ALTER TABLE {t} ADD COLUMN z_{c} TEXT DEFAULT 'it\\'s; DROP TABLE {t}; x';",
          2: "ALTER TABLE [{t}] ADD COLUMN [z_{c}] TEXT DEFAULT 'a\\'; /* a /* b */",
          3: "/* a /* b */ DROP TABLE ghost; */ ALTER TABLE [dbo].[{t}] ADD [z_{c}] TEXT DEFAULT 'a\\';"},
         [(0, "ADD_COLUMN", "{t}", "z_{c}", None, [])]),
    11: ({0: "DROP TABLE {t}_tmp;\nDROP VIEW v_{t};",
          1: "# old; DROP TABLE {t}\nDROP TEMPORARY TABLE IF EXISTS {t}_tmp;\nDROP VIEW v_{t};",
          2: "DROP TABLE {t}_tmp;\nDROP VIEW v_{t};",
          3: "DROP TABLE {t}_tmp\nGO\nDROP VIEW v_{t}\nGO 2"},
         [(0, "DROP_TABLE", "{t}_tmp", None, None, [fixed.NOTE_DROP_TABLE], 0),
          (0, "DROP_VIEW", "v_{t}", None, None, [], 1)]),
    12: ("DROP INDEX IF EXISTS {i}, idx_{t}_unknown;",
         [(0, "DROP_INDEX", "{t}", None, "{i}", []),
          (1, "DROP_INDEX", "", None, "idx_{t}_unknown", [])]),
    13: ("TRUNCATE TABLE {t}, ONLY {t}_b;",
         [(0, "TRUNCATE_TABLE", "{t}", None, None, [fixed.NOTE_TRUNCATE]),
          (1, "TRUNCATE_TABLE", "{t}_b", None, None, [fixed.NOTE_TRUNCATE])]),
    14: ("CREATE FULLTEXT INDEX ft_{t}_{c} ON {t} ({c});",
         [(0, "CREATE_INDEX", "{t}", None, "ft_{t}_{c}", [fixed.NOTE_INDEX_BLOCKING])]),
    15: ("RENAME TABLE {t}_x TO {t}_y, {t}_z TO {t}_w;",
         [(0, "RENAME_TABLE", "{t}_x", None, None, []),
          (1, "RENAME_TABLE", "{t}_z", None, None, [])]),
    16: ("ALTER TABLE {t} ADD COLUMN w_{c} INTEGER DEFAULT " + "(" * 20 + "1, 2" + ")" * 20 + ", ADD COLUMN w2_{c} TEXT;",
         [(0, "ADD_COLUMN", "{t}", "w_{c}", None, []),
          (1, "ADD_COLUMN", "{t}", "w2_{c}", None, [])]),
}

# SQL text of operations where it isn't the whole statement: (template, variant, action) -> text, or texts by dialect;
# statements behind the first of a variant come with their number
RAW = {
    (15, -1, 0): "ALTER TABLE {t}\n    ADD COLUMN x_{c} NUMERIC(12,2) DEFAULT 0.00",
    (16, 5, 0): "ALTER TABLE {t} ADD COLUMN y_{c} INTEGER CHECK (y_{c} IS NOT NULL AND y_{c} IN (1, (2), ((3), (((4)))))  )",
    (16, 9, 1): 'ALTER TABLE "public"."{t}" ADD n2 NUMERIC(4,2) DEFAULT 0',
    (16, 10, 0): {0: "ALTER TABLE {t} ADD COLUMN z_{c} TEXT DEFAULT E'it\\'s; DROP TABLE {t}'",
                  1: "ALTER TABLE {t} ADD COLUMN z_{c} TEXT DEFAULT 'it\\'s; DROP TABLE {t}; x'",
                  2: "ALTER TABLE [{t}] ADD COLUMN [z_{c}] TEXT DEFAULT 'a\\'",
                  3: "ALTER TABLE [dbo].[{t}] ADD [z_{c}] TEXT DEFAULT 'a\\'"},
    (16, 11, 0, 1): "DROP VIEW v_{t}",
    (16, 16, 0): "ALTER TABLE {t} ADD COLUMN w_{c} INTEGER DEFAULT " + "(" * 20 + "1, 2" + ")" * 20,
    (16, 16, 1): "ALTER TABLE {t} ADD COLUMN w2_{c} TEXT",
    (15, -1, 1): "ALTER TABLE {t}\n    DROP COLUMN {c}",
    (16, 5, 1): "ALTER TABLE {t} DROP COLUMN {c}",
    (16, 9, 0): 'ALTER TABLE "public"."{t}" ADD "n 1" INTEGER NOT NULL',
    (16, 11, 0): {0: "DROP TABLE {t}_tmp", 1: "DROP TEMPORARY TABLE IF EXISTS {t}_tmp", 2: "DROP TABLE {t}_tmp", 3: "DROP TABLE {t}_tmp"},
}

# ---------------------------------------------------------------------------
# Logged query templates by event_type; {p} = floor(value) % 4.
# ``refs`` are the (table key, column) references a parser reports for the
# query: table keys as written (aliases are keys too), None column = table
# scanned, '*' = unqualified column.
# ---------------------------------------------------------------------------
QUERY_TEMPLATES = {
    "click": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = {p}",
              [("orders", None), ("*", "o_orderkey"), ("*", "o_totalprice"), ("*", "o_custkey")]),
    "view": ("SELECT * FROM public.customer WHERE c_mktsegment = 'from {p}' AND c_acctbal > {p}00",
             [("customer", None), ("*", "c_mktsegment"), ("*", "c_acctbal")]),
    "purchase": ("SELECT l.l_quantity, p.p_name, count(*) FROM lineitem l JOIN part p "
                 "ON l.l_partkey = p.p_partkey WHERE l_discount < 0.0{p} GROUP BY l.l_quantity, p.p_name",
                 [("lineitem", None), ("part", None), ("l", "l_quantity"), ("l", "l_partkey"),
                  ("p", "p_name"), ("p", "p_partkey"), ("*", "l_discount")]),
    "error": ("UPDATE orders SET o_orderstatus = 'F' WHERE o_orderkey = {p} AND o_custkey IN ("   # over 2,000 characters
              + ", ".join(str(i) for i in range(1, 501)) + ")",
              [("orders", None), ("*", "o_orderstatus"), ("*", "o_orderkey"), ("*", "o_custkey")]),
    "signup": ("SELECT customer.c_name, nation.n_name FROM customer, \"nation\" WHERE "   # over 300 characters
               "customer.c_nationkey = nation.n_nationkey AND c_acctbal > {p} /* FROM region */ AND c_mktsegment <> '" + "x" * 320 + "'",
               [("customer", None), ("nation", None), ("customer", "c_name"), ("customer", "c_nationkey"),
                ("nation", "n_name"), ("nation", "n_nationkey"), ("*", "c_acctbal"), ("*", "c_mktsegment")]),
}
QUERY_PARAM_MOD = 4


# ---------------------------------------------------------------------------
# SQL rendering helpers (Spark SQL and DuckDB share '||', CASE, '%')
# ---------------------------------------------------------------------------
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _array(items: list[str], dialect: str) -> str:
    inner = ", ".join(items)
    return f"array({inner})" if dialect == "spark" else f"[{inner}]"


def _at(arr: str, idx: str, dialect: str) -> str:
    return f"element_at({arr}, CAST({idx} AS INT))" if dialect == "spark" else f"list_extract({arr}, {idx})"


def _div(a: str, b: int, dialect: str) -> str:
    return f"({a} div {b})" if dialect == "spark" else f"({a} // {b})"


def fmt_sql(template: str | None, dialect: str = "spark") -> str:
    """Render a '{x}' template as a SQL string expression over columns t, c, i, p, k, n."""
    if template is None:
        return "CAST(NULL AS VARCHAR)" if dialect == "duckdb" else "CAST(NULL AS STRING)"
    parts = []
    for tok in re.split(r"(\{[tcipnk]\})", template):
        if not tok:
            continue
        if re.fullmatch(r"\{[tcipnk]\}", tok):
            parts.append(f"CAST({tok[1]} AS VARCHAR)" if dialect == "duckdb" else f"CAST({tok[1]} AS STRING)")
        else:
            parts.append(_q(tok.replace("\\", "\\\\") if dialect == "spark" else tok))
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def param_columns_sql(dialect: str) -> dict[str, str]:
    """SQL for t, c, i, p, tid, variant as functions of l_partkey / l_suppkey."""
    tables = _array([_q(t) for t in CATALOG_TABLES], dialect)
    tix = f"(l_suppkey % {len(CATALOG_TABLES)})"
    sel = _div("l_suppkey", len(CATALOG_TABLES), dialect)
    cols = _array([_array([_q(c) for c in CATALOG_COLUMNS[t]], dialect) for t in CATALOG_TABLES], dialect)
    ncols = _array([str(len(CATALOG_COLUMNS[t])) for t in CATALOG_TABLES], dialect)
    idxs = _array([_array([_q(n) for n, _ in INDEXES[t]], dialect) for t in CATALOG_TABLES], dialect)
    nidx = _array([str(len(INDEXES[t])) for t in CATALOG_TABLES], dialect)
    parents = _array([_q(FK_PARENT[t]) for t in CATALOG_TABLES], dialect)
    keys = _array([_q(PRIMARY_KEYS[FK_PARENT[t]][0]) for t in CATALOG_TABLES], dialect)
    return {
        "tid": f"CAST(l_partkey % {N_TEMPLATES} AS INT)",
        "variant": f"CAST(l_suppkey % {N_VARIANTS} AS INT)",
        "did": f"CAST(l_orderkey % {len(DIALECT_FILES)} AS INT)",
        "t": _at(tables, f"{tix} + 1", dialect),
        "c": _at(_at(cols, f"{tix} + 1", dialect), f"({sel} % {_at(ncols, f'{tix} + 1', dialect)}) + 1", dialect),
        "i": _at(_at(idxs, f"{tix} + 1", dialect), f"({sel} % {_at(nidx, f'{tix} + 1', dialect)}) + 1", dialect),
        "p": _at(parents, f"{tix} + 1", dialect),
        "k": _at(keys, f"{tix} + 1", dialect),
        "n": "l_linenumber",
    }


def statement_sql(dialect: str = "spark") -> str:
    """CASE expression giving the statement text of a line item."""
    whens = []
    for tid, (text, _) in TEMPLATES.items():
        whens.append(f"WHEN tid = {tid} THEN {fmt_sql(text, dialect)}")
    def of_variant(text):
        if isinstance(text, str):
            return fmt_sql(text, dialect)
        return "CASE did " + " ".join(f"WHEN {d} THEN {fmt_sql(x, dialect)}" for d, x in text.items()) + " END"

    inner = " ".join(f"WHEN variant = {v} THEN {of_variant(text)}" for v, (text, _) in VARIANTS.items())
    whens.append(f"ELSE CASE {inner} END")
    return "CASE " + " ".join(whens) + " END"


def dialect_sql(key: str = "o_orderkey") -> str:
    return f"CAST({key} % {len(DIALECT_FILES)} AS INT)"


# ---------------------------------------------------------------------------
# Spark: corpus DataFrames
# ---------------------------------------------------------------------------
def statement_rows(lineitem: DataFrame) -> DataFrame:
    """One generated statement per line item (narrow; no shuffle)."""
    params = param_columns_sql("spark")
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    li = li.select("*", *[F.expr(v).alias(k) for k, v in params.items()])
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        F.concat(F.lit("-- step "), F.col("l_linenumber").cast("string"), F.lit("\n"),
                 F.expr(statement_sql("spark"))).alias("stmt_text"),
    )


def _migration_columns(orders: DataFrame) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(n) for n in DIALECT_FILES]), F.expr(dialect_sql()) + 1)
    file_name = F.concat(F.lit("V"), F.col("o_orderkey").cast("string"), F.lit("__"), names, F.lit(".sql"))
    db_id = F.expr(f"o_custkey div {DB_PER_CUSTOMER_DIV}")
    return orders.select(
        F.col("o_orderkey").alias("migration_id"),
        db_id.alias("db_id"),
        (F.lit(9) + F.col("o_custkey") % 6).cast("int").alias("db_version"),
        F.concat(F.lit("db/"), db_id.cast("string"), F.lit("/"), file_name).alias("path"),
        file_name.alias("file_name"),
    )


def migration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(migration_id, db_id, db_version, path, file_name) — from ``orders`` alone (no script text)."""
    return _migration_columns(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


def migration_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(migration_id, db_id, db_version, path, file_name, text) — one row per order."""
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    stmts = statement_rows(lineitem)
    # One script per order: statements in a fixed order (sort_array and field access are compiled, array_sort and transform aren't).  The number of line
    # items per order is bounded by the generator, so each group is small.
    texts = stmts.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "stmt_text",
        ))).alias("parts")
    ).select(
        F.col("l_orderkey").alias("migration_id"),
        F.array_join("parts.stmt_text", "\n").alias("body"),
    )
    migrations = _migration_columns(orders)
    # Both sides grow with the data: sort-merge on the key, never a broadcast.
    # The result is hash-partitioned by migration_id, which every later
    # per-migration aggregate and join reuses.
    return migrations.join(texts.hint("merge"), "migration_id", "left").select(
        "migration_id", "db_id", "db_version", "path", "file_name",
        F.concat(F.lit("-- Migration "), F.col("migration_id").cast("string"), F.lit("\n"),
                 F.coalesce(F.col("body"), F.lit(""))).alias("text"),
    )


def query_sql(dialect: str = "spark") -> str:
    """CASE expression giving the logged query (no terminator) of an event."""
    p = f"CAST(CAST(floor(value) AS BIGINT) % {QUERY_PARAM_MOD} AS {'STRING' if dialect == 'spark' else 'VARCHAR'})"
    whens = []
    for et, (text, _) in QUERY_TEMPLATES.items():
        pieces = re.split(r"(\{p\})", text)
        parts = [p if x == "{p}" else _q(x) for x in pieces if x]
        whens.append(f"WHEN event_type = {_q(et)} THEN ({' || '.join(parts)})")
    return "CASE " + " ".join(whens) + " END"


def query_log_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, chunk_id, text): each chunk holds at most LOG_CHUNK events of one user."""
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    q = F.expr(query_sql("spark"))
    terminated = F.col("user_id") % 2 == 0
    entry = F.when(
        terminated,
        F.concat(F.lit("# Time: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n# Query_time: "),
                 F.format_number("value", 3), F.lit("  Lock_time: 0.000\n"), q, F.lit(";")),
    ).otherwise(
        F.concat(F.lit("LOG:  duration: "), F.format_number("value", 3), F.lit(" ms\n"), q)
    )
    chunked = events.select(
        F.col("user_id").alias("log_id"),
        F.expr(f"event_id div {LOG_CHUNK}").alias("chunk_id"),
        "event_id", entry.alias("entry"),
    )
    # group size is bounded: at most LOG_CHUNK distinct event ids per chunk
    return chunked.groupBy("log_id", "chunk_id").agg(
        F.array_join(
            F.sort_array(F.collect_list(F.struct("event_id", "entry")))["entry"],
            "\nINFO:  checkpoint complete\n",
        ).alias("text")
    )


def sql_type(spark_type: str) -> str:
    return {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "string": "VARCHAR(255)",
        "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN", "float": "REAL",
    }.get(spark_type, "TEXT")


def schema_dump_text(spark: SparkSession, sf_dir: str) -> str:
    """CREATE TABLE / CREATE INDEX text of the catalogue tables.

    Column types come from the parquet footers (schema only, no data read).
    """
    out = ["-- schema dump of the analysed database"]
    for t in CATALOG_TABLES:
        types = dict(read_table(spark, sf_dir, t).select(*CATALOG_COLUMNS[t]).dtypes)
        lines = []
        for c in CATALOG_COLUMNS[t]:
            spec = f"    {c} {sql_type(types[c])}"
            if c in PRIMARY_KEYS[t] or any(fk[0] == t and fk[1] == c for fk in FOREIGN_KEYS):
                spec += " NOT NULL"
            if c in DEFAULTS:
                spec += f" DEFAULT {DEFAULTS[c]}"
            lines.append(spec)
        lines.append(f"    PRIMARY KEY ({', '.join(PRIMARY_KEYS[t])})")
        for child, col, parent, pcol in FOREIGN_KEYS:
            if child == t:
                lines.append(f"    FOREIGN KEY ({col}) REFERENCES {parent} ({pcol})")
        out.append(f"CREATE TABLE {t} (\n" + ",\n".join(lines) + "\n);")
        for name, cols in INDEXES[t]:
            out.append(f"CREATE INDEX {name} ON {t} ({', '.join(cols)});")
    return "\n\n".join(out) + "\n"


def schema_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(schema_id, text) — the dump as a one-row DataFrame (schema-sized, not data-sized)."""
    return spark.createDataFrame([("main", schema_dump_text(spark, sf_dir))], "schema_id string, text string")


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_count) — real row counts of the catalogue tables."""
    parts = [read_table(spark, sf_dir, t).groupBy().agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(t).alias("table_name"), "row_count") for t in CATALOG_TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# Expected values as DuckDB SQL (used by the oracle)
# ---------------------------------------------------------------------------
def expected_statements_sql() -> str:
    """One row per line item: migration, position of its first statement and parameters."""
    params = param_columns_sql("duckdb")
    cols = ", ".join(f"{v} AS {k}" for k, v in params.items())
    two = ", ".join(str(v) for v, (_, ops) in VARIANTS.items() if any(op[6:] == (1,) for op in ops))
    n = f"CASE WHEN {params['tid']} = 16 AND {params['variant']} IN ({two}) THEN 2 ELSE 1 END"
    return (
        f"SELECT l_orderkey AS migration_id, CAST(sum({n}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, "
        f"l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) - {n} AS BIGINT) AS stmt_pos, "
        f"{cols} FROM lineitem"
    )


def expected_ops_values_sql() -> str:
    """VALUES table (tid, variant, action_pos, op_class, tbl, col, idx, notes) of expected ops."""
    rows = []
    for tid, (_, ops) in TEMPLATES.items():
        for op in ops:
            rows.append((tid, -1, *op, *(() if op[6:] else (0,))))
    for v, (_, ops) in VARIANTS.items():
        for op in ops:
            rows.append((16, v, *op, *(() if op[6:] else (0,))))

    def lit(x):
        return "NULL" if x is None else _q(x)

    vals = ", ".join(
        f"({tid}, {v}, {ap}, {_q(cls)}, {lit(tb)}, {lit(co)}, {lit(ix)}, {_q(' | '.join(notes))}, {at})"
        for (tid, v, ap, cls, tb, co, ix, notes, at) in rows
    )
    return f"(VALUES {vals}) AS x(tid, variant, action_pos, op_class, tbl, col, idx, notes, stmt_off)"


def expected_render(col: str) -> str:
    """DuckDB expression turning a '{x}' template column into text."""
    return (f"replace(replace(replace(replace({col}, '{{t}}', t), '{{c}}', c), '{{i}}', i), "
            f"'{{p}}', p)")


def expected_raw_sql(base: str = "base_") -> str:
    """SQL text of an operation from tid, variant, stmt_off, action_pos and its template's parameters: the whole statement unless ``RAW`` has another."""
    def text(x):
        if isinstance(x, dict):
            return f"CASE {base}did " + " ".join(f"WHEN {d} THEN {text(y)}" for d, y in x.items()) + " END"
        for name in "tcipk":
            x = x if x.startswith("replace(") else _q(x)
            x = f"replace({x}, '{{{name}}}', {base}{name})"
        return x

    whens = [f"WHEN tid = {key[0]} AND (tid < 16 OR variant = {key[1]}) AND action_pos = {key[2]} AND stmt_off = {(*key, 0)[3]} THEN {text(x)}"
             for key, x in RAW.items()]
    whens += [f"WHEN tid = {a} THEN {text(x.rstrip(';'))}" for a, (x, _) in TEMPLATES.items()]
    whens += [f"WHEN variant = {b} THEN {text(x.rstrip(';'))}" for b, (x, _) in VARIANTS.items() if isinstance(x, str)]
    return "CASE " + " ".join(whens) + " END"


def expected_queries_sql() -> str:
    """One row per event: log, chunk, position in chunk, query text as logged."""
    return (
        "SELECT user_id AS log_id, event_id // " + str(LOG_CHUNK) + " AS chunk_id, event_id, event_type, "
        "CAST(row_number() OVER (PARTITION BY user_id, event_id // " + str(LOG_CHUNK)
        + " ORDER BY event_id) - 1 AS BIGINT) AS pos, "
        "(" + query_sql("duckdb") + ") || CASE WHEN user_id % 2 = 0 THEN ';' ELSE '' END AS query "
        "FROM events"
    )


def expected_refs_values_sql() -> str:
    vals = []
    for et, (_, refs) in QUERY_TEMPLATES.items():
        for tk, col in refs:
            vals.append(f"({_q(et)}, {_q(tk)}, {'NULL' if col is None else _q(col)})")
    return f"(VALUES {', '.join(vals)}) AS r(event_type, table_key, column_name)"
