"""Statement extraction: scripts -> classified DDL operations.

Input: a DataFrame with ``migration_id``, ``text`` and a ``dialect`` column
(or ``file_name`` to infer it from).  Output: one row per DDL operation,
keyed ``(migration_id, stmt_pos, action_pos)``:

    op_class, target_table, target_column, target_index, dialect, raw_sql,
    parser_notes (array<string>), has_not_null, has_default, is_concurrent

Everything is row-local (two ``posexplode`` generators and column
expressions), so the stage never shuffles and keeps the partitioning of its
input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ddlscope.functions import fixed, lexer, patterns
from ddlscope.functions.lexer import lit
from ddlscope.functions.text import WHITESPACE
from ddlscope.session import broadcast_if_small
from ddlscope.sources.files import infer_dialect


def strip_comment_lines(text: str, dialect: str | None = None) -> str:
    """P1 as SQL: drop ``--``, ``/* */`` and (MySQL) ``#`` comments outside quotes."""
    return lexer.strip_comments(text, dialect)


def _dialect_of(df: DataFrame) -> str | None:
    return "dialect" if "dialect" in df.columns else None


def split_statements(df: DataFrame, text_col: str = "sql") -> DataFrame:
    """One row per non-blank statement; ``;`` inside quotes or a dollar body does not split."""
    rest = [f"`{c}`" for c in df.columns if c != text_col]
    out = df.selectExpr(*rest, f"posexplode({lexer.statements(text_col, _dialect_of(df))}) AS (stmt_pos, _raw)")
    return out.filter(f"{lexer.lstrip('_raw')} <> ''").selectExpr(*rest, "stmt_pos", f"{lexer.strip('_raw')} AS stmt")


def split_compound_alter(df: DataFrame) -> DataFrame:
    """``ALTER TABLE t a1, a2`` -> one ``ALTER TABLE t ai`` row per action.

    Commas inside quotes or parentheses of any depth do not split; the
    definitions of ``ADD (a INT, b INT)`` are actions of their own.  Other
    statements pass through as action 0.  A list is cut by one pattern, in time
    that grows as its length.
    """
    rest, dialect = [f"`{c}`" for c in df.columns if c != "stmt"], _dialect_of(df)
    prefix, add_list = lit(patterns.ALTER_PREFIX), lit(patterns.ADD_LIST)
    # only an ALTER with a comma or an ADD list can hold several actions; everything else skips the split
    is_alter = rf"upper(substring(stmt, 1, 5)) = 'ALTER' AND (contains(stmt, ',') OR contains(stmt, '(') AND stmt RLIKE {lit('(?i)' + chr(92) + 'bADD' + chr(92) + 's*[(]')})"
    parts = df.selectExpr("*", f"CASE WHEN {is_alter} THEN regexp_extract(stmt, {prefix}, 1) ELSE '' END AS _prefix",
                          f"CASE WHEN {is_alter} THEN regexp_extract(stmt, {prefix}, 2) ELSE '' END AS _list")
    actions = f"filter({lexer.split_top('_list', dialect)}, x -> length(x) > 0)"
    definitions = lexer.split_top(f"regexp_extract(a, {add_list}, 1)", dialect)
    expanded = (f"CASE WHEN contains(_list, '(') AND _list RLIKE {lit(patterns.HAS_ADD_LIST)} THEN flatten(transform({actions}, a -> CASE WHEN a RLIKE {add_list} "
                f"THEN transform({definitions}, y -> concat('ADD ', y)) ELSE array(a) END)) ELSE {actions} END")
    # the lists are a column, so the generator over them is compiled; an ALTER without actions stays as it is
    found = parts.selectExpr("*", f"CASE WHEN _prefix <> '' THEN {expanded} END AS _found")
    cut = found.selectExpr(*rest, "_prefix", "coalesce(size(_found), 0) > 0 AS _cut",
                           "posexplode(CASE WHEN size(_found) > 0 THEN _found ELSE array(stmt) END) AS (action_pos, _action)")
    return cut.selectExpr(*rest, "action_pos", "CASE WHEN _cut THEN concat(_prefix, _action) ELSE _action END AS action_sql")


# Words that may stand between CREATE / DROP and the object keyword.
_CREATE_MODIFIERS = ["OR", "REPLACE", "GLOBAL", "LOCAL", "TEMP", "TEMPORARY", "UNLOGGED", "UNIQUE", "MATERIALIZED",
                     "FULLTEXT", "SPATIAL", "CLUSTERED", "NONCLUSTERED", "COLUMNSTORE"]
_DROP_MODIFIERS = ["MATERIALIZED", "TEMP", "TEMPORARY"]
# The classes are decided by the leading words alone.  The longest lead of the grammar in
# functions/patterns.py is CREATE + 6 modifiers + INDEX CONCURRENTLY IF NOT EXISTS i ON ONLY t = 15 words;
# what follows (column types, bodies, predicates) is never looked at for the class.
N_TOKENS = 16
QUOTES = '"`['


def with_tokens(df: DataFrame, stmt: str) -> DataFrame:
    """Add ``_toks``, the first words of a statement (bounded split: cost does not grow with its length), and ``_up``, the same in upper case.

    '(' is set apart so ``users(email)`` gives ``users``; the last element holds
    the unsplit rest.  Names with blanks inside their quotes are one word.
    A text whose only white space is single blanks is cut at these, without a pattern, which Spark would compile for every row.
    Upper case changes no white space, bracket or quote, so both are cut alike.
    """
    def has(text, characters):
        return " OR ".join(f"contains({text}, {lit(c)})" for c in characters)

    flat = f"CASE WHEN contains({stmt}, '(') THEN replace(replace({stmt}, ' (', '('), '(', ' ( ') ELSE {stmt} END"
    spaced = f"({has(stmt, QUOTES)}) AND {stmt} RLIKE {lit(patterns.SPACED_NAME)}"
    how = f"CASE WHEN {spaced} THEN 2 WHEN {has(stmt, WHITESPACE.replace(' ', ''))} THEN 1 ELSE 0 END"
    # a projection of its own, which is not inlined again
    seen = df.selectExpr("*", f"{flat} AS _flat", f"{how} AS _how")

    def words(shown):
        return (f"CASE WHEN _how = 2 THEN slice(regexp_extract_all({shown.format(stmt)}, {lit(patterns.SPACED_TOKEN)}, 0), 1, {N_TOKENS}) "
                f"WHEN _how = 1 OR contains(_flat, '  ') THEN split({shown.format('_flat')}, {lit(chr(92) + 's+')}, {N_TOKENS}) "
                f"ELSE split({shown.format('_flat')}, ' ', {N_TOKENS}) END")

    return seen.selectExpr(*(f"`{c}`" for c in df.columns), f"{words('{}')} AS _toks", f"{words('upper({})')} AS _up")


def _case(*whens: tuple[str, str], otherwise: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in whens) + (f" ELSE {otherwise}" if otherwise else "") + " END"


def _in(word: str, names: list[str]) -> str:
    return f"{word} IN ({', '.join(map(lit, names))})"


def classify_tokens(df: DataFrame, toks_col: str = "_toks") -> DataFrame:
    """Add op_class, target_table, target_column, target_index from the leading tokens.

    Follows the keyword grammar documented in ``functions/patterns.py``
    (first match wins); statements that are not CREATE / ALTER / DROP /
    TRUNCATE / RENAME TABLE get a null class (P7).
    Work is staged in successive projections (words, then classes, then names)
    so no expression is inlined many times over.  A projection writes every
    column anew, so the two lists of words end with the first of them.
    """
    cols = [f"`{c}`" for c in df.columns if c not in ("_up", toks_col)]

    def up(i):
        return f"get(_up, {i})"

    def tok(i):
        return f"get({toks_col}, {i})"

    def add(d, **exprs):
        return d.selectExpr("*", *(f"{e} AS `{name}`" for name, e in exprs.items()))

    def skip(at, words, then, otherwise) -> str:
        """``then`` if the words from place ``at`` on are these, else ``otherwise``."""
        return _case((" AND ".join(f"get(_up, {at} + {i}) = {lit(w)}" for i, w in enumerate(words.split())), then), otherwise=otherwise)

    # ---- stage 1: positions (p table of ALTER, k object of CREATE, dk of DROP, t of TRUNCATE, o of others), then the words there ----
    first_obj = f"get(array_except(slice(_up, 2, 6), array({', '.join(map(lit, _CREATE_MODIFIERS))})), 0)"
    p = skip(2, "IF EXISTS", skip(4, "ONLY", 5, 4), skip(2, "ONLY", 3, 2))
    k = f"CASE WHEN {up(0)} = 'CREATE' THEN cast(array_position(_up, {first_obj}) - 1 AS int) END"
    on = f"CASE WHEN {up(0)} = 'CREATE' THEN cast(array_position(_up, 'ON') - 1 AS int) END"
    dropped = [skip(x + 1, "CONCURRENTLY", skip(x + 2, "IF EXISTS", x + 4, x + 2), skip(x + 1, "IF EXISTS", x + 3, x + 1)) for x in (1, 2)]
    modified = _in(up(1), _DROP_MODIFIERS)
    d1 = f"CASE WHEN {modified} THEN {dropped[1]} ELSE {dropped[0]} END"
    t1 = skip(1, "TABLE", skip(2, "ONLY", 3, 2), skip(1, "ONLY", 2, 1))
    others = [skip(x + 1, "IF EXISTS", x + 3, skip(x + 1, "IF NOT EXISTS", x + 4, x + 1)) for x in (1, 3)]
    o1 = skip(1, "OR REPLACE", others[1], others[0])
    words = dict(
        _k=k, _on=on, _head=up(0), _w1=up(1), **{f"_a{i}": up(f"{p} + {i}") for i in range(1, 6)}, **{f"_r{i}": tok(f"{p} + {i}") for i in range(0, 7)},
        _obj=up(k), _cname=tok(skip(f"{k} + 1", "IF NOT EXISTS", f"{k} + 4", f"{k} + 1")),
        _dobj=up(f"CASE WHEN {modified} THEN 2 ELSE 1 END"), _dname=tok(d1), _don=up(f"{d1} + 1"), _dontbl=tok(f"{d1} + 2"),
        _renamed=tok(2), _tname=tok(t1), _oname=tok(o1),
        _ontbl=f"CASE WHEN {up(f'{on} + 1')} = 'ONLY' THEN {tok(f'{on} + 2')} ELSE {tok(f'{on} + 1')} END",
        _idxname=f"CASE WHEN {on} > {k} + 1 AND NOT {_in(up(f'{on} - 1'), ['INDEX', 'CONCURRENTLY', 'EXISTS'])} THEN {tok(f'{on} - 1')} END",
        _concurrent=f"coalesce('CONCURRENTLY' IN ({', '.join(map(up, range(4)))}), false)")
    d = df.selectExpr(*cols, *(f"{e} AS {name}" for name, e in words.items()))

    # ---- stage 2: classes ---------------------------------------------------
    alter_table = "_head = 'ALTER' AND _w1 = 'TABLE' AND _r0 IS NOT NULL AND _a1 IS NOT NULL"
    alter_class = _case(
        ("_a1 = 'DROP' AND _a2 = 'FOREIGN' AND _a3 = 'KEY'", "'DROP_FOREIGN_KEY'"),
        ("_a1 = 'DROP' AND _a2 IN ('CONSTRAINT', 'PRIMARY')", "'DROP_CONSTRAINT'"),
        ("_a1 = 'DROP' AND _a2 IN ('INDEX', 'KEY') AND _a3 IS NOT NULL", "'DROP_INDEX'"),
        ("_a1 = 'DROP' AND _a2 IS NOT NULL", "'DROP_COLUMN'"),
        ("_a1 = 'RENAME' AND _a2 = 'TO' AND _a3 IS NOT NULL", "'RENAME_TABLE'"),
        ("_a1 = 'RENAME' AND (_a2 = 'COLUMN' AND _a4 = 'TO' OR _a2 <> 'COLUMN' AND _a3 = 'TO')", "'RENAME_COLUMN'"),
        ("_a1 IN ('ALTER', 'MODIFY', 'CHANGE') AND _a2 IS NOT NULL", "'ALTER_COLUMN'"),
        ("_a1 = 'ADD' AND (_a2 = 'FOREIGN' AND _a3 = 'KEY' OR _a2 = 'CONSTRAINT' AND _a4 = 'FOREIGN' AND _a5 = 'KEY')", "'ADD_FOREIGN_KEY'"),
        ("_a1 = 'ADD' AND _a2 IN ('CONSTRAINT', 'PRIMARY', 'UNIQUE', 'CHECK', 'EXCLUDE')", "'ADD_CONSTRAINT'"),
        ("_a1 = 'ADD' AND _a2 IN ('INDEX', 'KEY', 'FULLTEXT', 'SPATIAL')", "'UNKNOWN'"),
        ("_a1 = 'ADD' AND _a2 IS NOT NULL", "'ADD_COLUMN'"), otherwise="'UNKNOWN'")
    create_class = _case(("_obj = 'TABLE' AND _cname IS NOT NULL", "'CREATE_TABLE'"), ("_obj = 'INDEX' AND _on > _k", "'CREATE_INDEX'"),
                         ("_obj = 'VIEW' AND _cname IS NOT NULL", "'CREATE_VIEW'"), otherwise="'UNKNOWN'")
    drop_class = _case(*((f"_dobj = '{x}' AND _dname IS NOT NULL", f"'DROP_{x}'") for x in ("TABLE", "INDEX", "VIEW")), otherwise="'UNKNOWN'")
    d = add(d, _is_at=f"({alter_table})", op_class=_case(
        (alter_table, alter_class), ("_head = 'CREATE'", create_class), ("_head = 'DROP'", drop_class),
        ("_head = 'TRUNCATE' AND _tname IS NOT NULL", "'TRUNCATE_TABLE'"),
        ("_head = 'RENAME' AND _w1 = 'TABLE' AND _renamed IS NOT NULL", "'RENAME_TABLE'"), ("_head = 'ALTER'", "'UNKNOWN'")))

    # ---- stage 3: target tokens, then names ----------------------------------
    drop_column = _case(("_a2 = 'COLUMN' AND _a3 = 'IF' AND _a4 = 'EXISTS'", "_r5"), ("_a2 = 'COLUMN'", "_r3"),
                        ("_a2 = 'IF' AND _a3 = 'EXISTS'", "_r4"), otherwise="_r2")
    add_column = _case(("_a2 = 'COLUMN' AND _a3 = 'IF' AND _a4 = 'NOT' AND _a5 = 'EXISTS'", "_r6"), ("_a2 = 'COLUMN'", "_r3"),
                       ("_a2 = 'IF' AND _a3 = 'NOT' AND _a4 = 'EXISTS'", "_r5"), otherwise="_r2")
    column = _case(("_is_at AND op_class = 'DROP_COLUMN'", drop_column),
                   ("_is_at AND op_class IN ('RENAME_COLUMN', 'ALTER_COLUMN')", "CASE WHEN _a2 = 'COLUMN' THEN _r3 ELSE _r2 END"),
                   ("_is_at AND op_class = 'ADD_COLUMN'", add_column))
    table = _case(("_is_at", "_r0"), ("_head = 'CREATE' AND op_class = 'CREATE_INDEX'", "_ontbl"), ("_head = 'CREATE' AND op_class <> 'UNKNOWN'", "_cname"),
                  ("_head = 'DROP' AND op_class = 'DROP_INDEX'", "CASE WHEN _don = 'ON' THEN _dontbl END"),
                  ("_head = 'DROP' AND op_class <> 'UNKNOWN'", "_dname"), ("_head = 'TRUNCATE'", "_tname"), ("_head = 'RENAME'", "_renamed"),
                  otherwise="_oname")
    index = _case(("_is_at AND op_class = 'DROP_INDEX'", "_r3"), ("op_class = 'CREATE_INDEX'", "_idxname"),
                  ("_head = 'DROP' AND op_class = 'DROP_INDEX'", "_dname"))
    d = d.selectExpr(*cols, "_concurrent", "op_class", f"{table} AS _tt", f"{column} AS _tc", f"{index} AS _ti")

    def operation(table, column, index, sub):
        return (f"named_struct('op_class', op_class, 'target_table', coalesce({table}, ''), 'target_column', nullif({column}, ''), "
                f"'target_index', nullif({index}, ''), '_sub', {sub})")

    one = operation("_nt", "_nc", "_ni", "0")
    # TRUNCATE a, b, c, DROP TABLE | VIEW | INDEX a, b, c and RENAME TABLE a TO x, b TO y: one operation
    # per name, numbered by action_pos (none is an ALTER action list, so its action_pos starts at 0)
    listed = lexer.split_top(f"regexp_extract(action_sql, {lit(patterns.TABLE_LIST)}, 1)", _dialect_of(df))
    name = lexer.name_sql(f"regexp_replace(n, {lit('(?i)^ONLY' + chr(92) + 's+')}, '')")
    owner = lexer.name_sql(f"regexp_extract(n, {lit(patterns.INDEX_OWNER)}, 1)")  # DROP INDEX i ON t, j ON u
    many = (f"CASE WHEN op_class = 'DROP_INDEX' THEN transform({listed}, (n, i) -> {operation(owner, 'cast(NULL AS string)', name, 'i')}) "
            f"ELSE transform({listed}, (n, i) -> {operation(name, 'cast(NULL AS string)', 'cast(NULL AS string)', 'i')}) END")
    several = (f"op_class IN ('TRUNCATE_TABLE', 'DROP_TABLE', 'DROP_VIEW', 'DROP_INDEX', 'RENAME_TABLE') AND contains(action_sql, ',') "
               f"AND action_sql RLIKE {lit(patterns.TABLE_LIST)}")
    # Emit through a generator: predicates on the class (here and in every
    # later stage) cannot be pushed below it, so the optimizer never inlines
    # the classification into a filter again.
    # Lists and names are columns below it, so that the generator itself is compiled.
    d = d.selectExpr(*cols, "_concurrent", "op_class", f"CASE WHEN {several} THEN {many} END AS _many",
                     *(f"{lexer.name_sql(f'_t{x}')} AS _n{x}" for x in "tci"))
    out = d.selectExpr(*cols, "_concurrent", f"inline(CASE WHEN op_class IS NULL THEN array() WHEN _many IS NOT NULL THEN _many ELSE array({one}) END)")
    return out.selectExpr(*[c for c in cols if c != "`action_pos`"], "_concurrent", "op_class", "target_table", "target_column", "target_index",
                          "action_pos + _sub AS action_pos")


def with_parser_notes(df: DataFrame) -> DataFrame:
    """Clause flags and the notes the extraction attaches.

    The NOT NULL / DEFAULT scans only run on ADD_COLUMN statements, and not
    inside literals or parentheses (CHECK bodies, function arguments).
    """
    text = df.selectExpr("*", f"CASE WHEN op_class = 'ADD_COLUMN' THEN {lexer.outside_parentheses('action_sql', _dialect_of(df))} END AS _text")
    seen = text.selectExpr("*", "explode(array(_text)) AS _seen").drop("_text")
    flags = seen.selectExpr("*", f"coalesce(_seen RLIKE {lit(patterns.NOT_NULL)}, false) AS has_not_null",
                            f"coalesce(_seen RLIKE {lit(patterns.DEFAULT)}, false) AS has_default",
                            "(op_class = 'CREATE_INDEX' AND _concurrent) AS is_concurrent")
    note = _case(("op_class = 'ADD_COLUMN' AND has_not_null AND NOT has_default", lit(fixed.NOTE_NOT_NULL_NO_DEFAULT)),
                 ("op_class = 'CREATE_INDEX' AND is_concurrent", lit(fixed.NOTE_INDEX_CONCURRENT)),
                 ("op_class = 'CREATE_INDEX'", lit(fixed.NOTE_INDEX_BLOCKING)), ("op_class = 'DROP_TABLE'", lit(fixed.NOTE_DROP_TABLE)),
                 ("op_class = 'TRUNCATE_TABLE'", lit(fixed.NOTE_TRUNCATE)))
    # no array_compact: a function with a lambda, which Spark doesn't compile, nor what stands in it
    noted = flags.selectExpr("*", f"{note} AS _note")
    return noted.selectExpr("*", "CASE WHEN _note IS NULL THEN cast(array() AS array<string>) ELSE array(_note) END AS parser_notes") \
        .drop("_seen", "_note", "_concurrent")


def chunk_offsets(scripts: DataFrame) -> DataFrame:
    """(migration_id, chunk_id, _offset): statements in the earlier chunks of a script.

    Only counts move: the running sum is over one narrow row per chunk.
    """
    counts = _statement_texts(scripts, ["migration_id", "chunk_id"]).selectExpr("migration_id", "chunk_id", f"size({lexer.statements('sql', 'dialect')}) AS n")
    before = Window.partitionBy("migration_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("migration_id", "chunk_id", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("_offset"))


def _statement_texts(scripts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, dialect, sql): texts without comments, T-SQL batches ended by a ``;``."""
    dialect = F.col("dialect") if "dialect" in scripts.columns else infer_dialect(F.col("file_name"))
    # generators keep the dialect, which every rule asks for, and the text without comments evaluated once
    base = scripts.select(*keep, F.explode(F.array(F.struct(dialect.alias("dialect"), F.col("text")))).alias("_s")).select(*keep, "_s.*")
    bare = base.selectExpr(*keep, "dialect", f"explode(array({strip_comment_lines('text', 'dialect')})) AS sql")
    return bare.selectExpr(*keep, "dialect", f"explode(array({lexer.batch_ends('sql', 'dialect')})) AS sql")


def extract_operations(scripts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Scripts -> operations.

    ``keep`` names extra script columns carried onto every operation
    (e.g. ``db_id``, ``db_version``).  A long script may come in chunks
    (``chunk_id``) that end after a statement, as logs do; statements are
    numbered over all chunks, and no script has to pass through one task
    (``sources/ranges.py`` reads files that way).
    """
    keep = list(keep or [])
    if "chunk_id" in scripts.columns:
        scripts = scripts.join(chunk_offsets(scripts).hint("merge"), ["migration_id", "chunk_id"])
    else:
        scripts = scripts.withColumn("_offset", F.lit(0))
    base = _statement_texts(scripts, ["migration_id", *keep, "_offset"])
    stmts = split_compound_alter(split_statements(base, "sql"))
    found = with_parser_notes(classify_tokens(with_tokens(stmts, "action_sql"), "_toks"))
    return found.selectExpr(
        "migration_id", *(f"`{c}`" for c in keep), "stmt_pos + _offset AS stmt_pos", "action_pos", "op_class", "target_table", "target_column",
        "target_index", "dialect", "action_sql AS raw_sql", "parser_notes", "has_not_null", "has_default", "is_concurrent")


def resolve_index_tables(ops: DataFrame, catalog_indexes: DataFrame) -> DataFrame:
    """Give a standalone ``DROP INDEX i`` the table that owns index ``i`` in the operation's schema.

    Owners are aggregated to one row per (schema, index name), so the left
    join cannot fan out.
    """
    by = ["schema_id"] if "schema_id" in ops.columns else []
    owners = broadcast_if_small(catalog_indexes.groupBy(*by, "index_name").agg(F.min("table_name").alias("_owner")))
    cond = (F.col("op_class") == "DROP_INDEX") & (F.col("target_table") == "") & (F.col("target_index") == F.col("_index"))
    if by:
        cond = cond & (F.col("schema_id") == F.col("_schema"))
    joined = ops.join(owners.withColumnsRenamed({"index_name": "_index", "schema_id": "_schema"}), cond, "left")
    return joined.withColumn("target_table", F.coalesce(F.col("_owner"), F.col("target_table"))).drop("_owner", "_index", "_schema")
