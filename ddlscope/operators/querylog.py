"""Query-log analysis (Q1-Q11).

Input logs are ``(log_id, chunk_id, text)``: a whole log file is one chunk;
a long log may be stored as many chunks that each end at an entry
boundary, so no log has to pass through one task.

* Q1-Q3: both extraction modes run per chunk in one pass; the mode of a log
  (``;``-terminated if any line starts with a verb and reaches ``;``, else one
  query per line) is an aggregate of the deduplicated entries.  Every file is
  a log of its own; ``db_id`` says which database it belongs to.
* Q4: first-seen dedupe is ``groupBy(log_id, mode, query)`` with
  ``min(struct(chunk, pos))`` and ``count`` - map-side combined, so a query
  repeated a billion times is reduced before the shuffle.
* Q5-Q6: references and the wildcard expansion are array expressions on the
  (deduplicated) query row: no join, no shuffle.
* Q7-Q9: one equi-join on (db, table, column) for removed / renamed /
  type-changed columns; Q10: an inverted index of the dropped indexes'
  columns, joined on the same keys; Q11 unions them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ddlscope.functions import fixed, lexer, patterns
from ddlscope.functions.text import fill
from ddlscope.session import written


def _empty():
    return F.array().cast("array<string>")


def log_entries(logs: DataFrame) -> DataFrame:
    """Q1-Q2: every logged query of both modes: log_id[, db_id], chunk_id, terminated, probe, pos, query.

    Terminated entries are looked for in the text up to its last ``;`` only, so
    every match ends there at the latest and the scan is linear.
    """
    ids = [c for c in ("log_id", "db_id") if c in logs.columns]
    text = F.col("text")
    tail = F.substring_index(text, ";", -1)
    heads = logs.select(*ids, "chunk_id", "text", F.substring(text, F.lit(1), F.length(text) - F.length(tail)).alias("_head"))
    q1 = F.expr(f"transform(regexp_extract_all(_head, {lexer.lit(patterns.TERMINATED_QUERY)}, 0), x -> {lexer.strip('x')})")
    # cut by the pattern only where there are line ends besides newlines
    lines = f"CASE WHEN text RLIKE {lexer.lit(patterns.OTHER_LINE_END)} THEN split(text, {lexer.lit(patterns.LINE_SPLIT)}) ELSE split(text, {lexer.lit(chr(10))}) END"
    q2 = F.expr(f"transform(filter({lines}, x -> x RLIKE {lexer.lit(patterns.LINE_QUERY)}), x -> {lexer.strip('x')})")
    modes = heads.select(*ids, "chunk_id", F.explode(F.array(
        F.struct(F.lit(True).alias("terminated"), F.col("_head").rlike(patterns.TERMINATED_PROBE).alias("probe"), q1.alias("queries")),
        F.struct(F.lit(False).alias("terminated"), F.lit(False).alias("probe"), q2.alias("queries")),
    )).alias("_m"))
    return modes.select(*ids, "chunk_id", "_m.terminated", "_m.probe", F.posexplode("_m.queries").alias("pos", "query"))


def extract_queries(logs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Q1-Q4: distinct queries per log with first position and frequency.

    Output: log_id[, db_id], query, first_chunk, first_pos, frequency.  With
    ``max_chars`` terminated queries of that length or more are left out
    (``dropped_queries`` reports them); by default every query is kept.
    """
    ids = [c for c in ("log_id", "db_id") if c in logs.columns]
    entries = log_entries(logs)
    if max_chars is not None:
        entries = entries.filter(~F.col("terminated") | (F.length("query") < max_chars))
    # Q4: exact-text dedupe, first appearance and frequency (partial aggregation); written, so that
    # the mode of a log and its queries come from one pass over the texts
    dedup = written(entries.groupBy(*ids, "terminated", "query").agg(
        F.min(F.struct("chunk_id", "pos")).alias("_first"), F.count(F.lit(1)).alias("frequency"),
        F.bool_or("probe").alias("_probe")), "queries")
    # Q3: one small row per log, but the number of logs grows with the data: no broadcast on an estimate
    mode = dedup.groupBy("log_id").agg(F.bool_or("_probe").alias("_mode"))
    kept = dedup.join(mode.hint("merge"), "log_id").filter(F.col("terminated") == F.col("_mode"))
    return kept.select(*ids, "query", F.col("_first.chunk_id").alias("first_chunk"),
                       F.col("_first.pos").cast("long").alias("first_pos"), "frequency")


def dropped_queries(logs: DataFrame, max_chars: int) -> DataFrame:
    """(log_id, dropped): terminated queries per log that ``max_chars`` leaves out."""
    return (log_entries(logs).filter(F.col("terminated") & (F.length("query") >= max_chars))
            .groupBy("log_id").agg(F.count(F.lit(1)).alias("dropped")))


def _not_keyword(x: Column) -> Column:
    return ~F.upper(x).isin(*patterns.SQL_KEYWORDS)


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, patterns.NAME_QUOTES, "")


def _where(text: str, words: str, pattern: str, instead: str) -> Column:
    """``pattern`` replaced in texts that hold one of its words (in any case); the others are not searched."""
    held = F.lit(False)
    for word in words.split():
        held = held | F.contains(F.upper(text), F.lit(word))
    return F.when(held, F.regexp_replace(text, pattern, instead)).otherwise(F.col(text))


#: What names no table or column: words that a text must hold, the pattern, what stands instead; in this order.
_NO_NAMES = [("'", patterns.STRING_LITERAL, "''"), ('" ` [', patterns.QUOTED_NAME, "$1$2"), ("::", patterns.CAST_TYPE, " "),
             ("FOR", patterns.LOCKING, " "), ("DUPLICATE", patterns.DUPLICATE_KEY, " SET "), ("CONVERT", patterns.CALL_USING, "$1"),
             ("EXTRACT", patterns.EXTRACT_FROM, "EXTRACT("), ("SUBSTRING TRIM OVERLAY", patterns.CALL_FROM, "$1,"),
             ("DISTINCT", patterns.DISTINCT_FROM, "=")]


def _holding(text: str, mark: str, found: Column) -> Column:
    """All matches ``found`` in texts that hold the mark which every match has; none in the others."""
    return F.when(F.contains(F.col(text), F.lit(mark)), found).otherwise(_empty())


def _plain(queries: DataFrame, query: str) -> DataFrame:
    """``_clean``: the query without comments, literals, casts and quotes around names; FROM only where it names tables."""
    q = queries.select("*", F.expr(lexer.strip_comments(query)).alias("_q0"))
    for i, step in enumerate(_NO_NAMES):
        # out of the projection before: a text is a column, so asking what it holds doesn't work it out again
        q = q.select(*queries.columns, _where(f"_q{i}", *step).alias(f"_q{i + 1}"))
    return q.withColumnRenamed(f"_q{len(_NO_NAMES)}", "_clean")


def with_references(queries: DataFrame) -> DataFrame:
    """Q5: lexical table / column references of every query (row-local).

    Adds ``ref_tables`` (tables as written, without their schema), ``ref_keys``
    (tables and qualifiers; aliases are not resolved), ``key_cols``
    (array<struct<key, cols>>, the qualified columns of each key) and
    ``star_cols`` (unqualified columns).
    """
    q = _plain(queries, "query")
    items = F.flatten(F.transform(F.regexp_extract_all("_clean", F.lit(patterns.TABLE_LIST_REF), 1),
                                  lambda x: F.regexp_extract_all(x, F.lit(patterns.LIST_ITEM), 0)))
    # what is left names columns, functions and aliases
    q = q.select("*", items.alias("_items"), F.regexp_replace("_clean", patterns.TABLE_LIST_REF, " ").alias("_rest"))
    tables = F.transform("_items", lambda x: _bare(F.regexp_extract(x, patterns.ITEM_TABLE, 1)))
    aliases = F.concat(F.filter(F.transform("_items", lambda x: F.regexp_extract(x, patterns.ITEM_ALIAS, 1)), lambda x: x != ""),
                       _holding("_clean", ")", F.regexp_extract_all("_clean", F.lit(patterns.SUBQUERY_ALIAS), 1)))
    aliases = F.transform(aliases, _bare)
    qual = _holding("_rest", ".", F.regexp_extract_all("_rest", F.lit(patterns.QUALIFIED_REF), 0))
    q = q.select("*", _where("_rest", ".", patterns.QUALIFIED_REF, " ").alias("_unqualified"))
    q = q.select("*", _where("_unqualified", "(", patterns.FUNCTION_CALL, " ").alias("_bare"))
    idents = F.transform(F.filter(F.regexp_extract_all("_bare", F.lit(patterns.IDENTIFIER), 1), _not_keyword), _bare)
    col_aliases = F.transform(F.regexp_extract_all("_rest", F.lit(patterns.COLUMN_ALIAS), 1), _bare)
    words = F.transform(F.array_distinct(qual), lambda s: F.transform(F.regexp_extract_all(s, F.lit(patterns.WORD), 0), _bare))
    q = q.select("*", tables.alias("_tables"), aliases.alias("_aliases"),
                 F.transform(words, lambda s: F.struct(F.element_at(s, -2).alias("k"), F.element_at(s, -1).alias("c"))).alias("_qual"),
                 idents.alias("_idents"), col_aliases.alias("_col_aliases"))
    keys = F.array_distinct(F.concat(F.col("_tables"), F.transform("_qual", lambda p: p["k"])))
    star = F.array_except(F.col("_idents"), F.concat(F.col("_tables"), F.col("_aliases"), F.col("_col_aliases")))
    q = q.select("*", keys.alias("ref_keys"), star.alias("star_cols"))
    key_cols = F.transform("ref_keys", lambda k: F.struct(
        k.alias("key"), F.array_distinct(F.transform(F.filter("_qual", lambda p: p["k"] == k),
                                                     lambda p: p["c"])).alias("cols")))
    q = q.select(*queries.columns, F.array_distinct("_tables").alias("ref_tables"), "ref_keys", key_cols.alias("key_cols"), "star_cols")
    # out of a generator: the size filters of later explodes stay above it, else each would evaluate all patterns once more
    refs = ["ref_tables", "ref_keys", "key_cols", "star_cols"]
    return q.select(*queries.columns, F.explode(F.array(F.struct(*refs))).alias("_r")).select(*queries.columns, *(f"_r.{c}" for c in refs))


def references_long(refs: DataFrame, id_cols: list[str]) -> DataFrame:
    """Q5 in long form: (ids..., table_key, column_name); null column = table scanned, '*' = unqualified."""
    entries = F.concat(
        F.transform("ref_tables", lambda t: F.struct(t.alias("table_key"),
                                                       F.lit(None).cast("string").alias("column_name"))),
        F.flatten(F.transform("key_cols", lambda kc: F.transform(
            kc["cols"], lambda c: F.struct(kc["key"].alias("table_key"), c.alias("column_name"))))),
        F.transform("star_cols", lambda c: F.struct(F.lit("*").alias("table_key"), c.alias("column_name"))),
    )
    return refs.select(*id_cols, F.explode(entries).alias("_r")).select(*id_cols, "_r.table_key", "_r.column_name")


def expanded_column_refs(refs: DataFrame, id_cols: list[str]) -> DataFrame:
    """Q6: (ids..., tkey, col) — qualified columns under their key, unqualified
    columns under every table key of the query (keys lower-cased, list
    semantics as the tool iterates them)."""
    entries = F.concat(
        F.flatten(F.transform("key_cols", lambda kc: F.transform(
            kc["cols"], lambda c: F.struct(F.lower(kc["key"]).alias("tkey"), c.alias("col"))))),
        F.flatten(F.transform("ref_keys", lambda k: F.transform(
            "star_cols", lambda c: F.struct(F.lower(k).alias("tkey"), c.alias("col"))))),
    )
    return refs.select(*id_cols, F.explode(entries).alias("_e")).select(*id_cols, "_e.tkey", "_e.col")


def column_change_keys(changes: DataFrame, migrations: DataFrame) -> DataFrame:
    """Distinct (migration, db, change_type, table, column) of removed / renamed / type-changed columns.

    The tool keeps these as sets per migration; ``changes`` is partitioned by
    migration_id, so the distinct needs no exchange.
    """
    c = changes.filter((F.col("object_kind") == "column")
                       & F.col("change_type").isin("removed", "renamed", "type_changed"))
    c = c.select("migration_id", "change_type", F.lower("table_name").alias("ctable"),
                 F.lower("column_name").alias("ccol")).dropDuplicates()
    return c.join(migrations.select("migration_id", "db_id"), "migration_id")


def _database(refs: DataFrame) -> DataFrame:
    """References with ``_db``: the database of the log, which is the log itself where no db_id is given."""
    return refs.withColumn("_db", F.col("db_id") if "db_id" in refs.columns else F.col("log_id"))


def _dropped_indexes(changes: DataFrame, migrations: DataFrame) -> DataFrame:
    """(migration_id, db_id, itable, index_name, icols, m): each dropped index once, with the number of times it is dropped."""
    dropped = changes.filter((F.col("object_kind") == "index") & (F.col("change_type") == "removed")).select(
        "migration_id", F.lower("table_name").alias("itable"), "index_name",
        F.transform(F.coalesce("index_columns", _empty()), lambda c: F.lower(c)).alias("icols"))
    dropped = dropped.groupBy("migration_id", "itable", "index_name", "icols").agg(F.count(F.lit(1)).alias("m"))
    return dropped.join(migrations.select("migration_id", "db_id"), "migration_id")


#: Keys besides columns: a query that names none meets every index of its table, and an index of unknown columns every query.
NO_COLUMNS, ALL_QUERIES = "\u0001none", "\u0001all"


def _index_keys(icols: Column) -> Column:
    """What an index is posted under: its columns, and the keys that queries without columns and indexes without columns look up."""
    return F.concat(F.array_distinct(icols), F.array(F.lit(NO_COLUMNS)), F.when(F.size(icols) == 0, F.array(F.lit(ALL_QUERIES))).otherwise(_empty()))


def _query_keys(cols: Column) -> Column:
    return F.concat(F.array_distinct(cols), F.array(F.lit(ALL_QUERIES)), F.when(F.size(cols) == 0, F.array(F.lit(NO_COLUMNS))).otherwise(_empty()))


def _met_indexes(queries: DataFrame, ids: list[str], indexes: DataFrame) -> DataFrame:
    """Q10: each pair of a query's table and a dropped index that it uses, once.

    An inverted index: both sides are posted under (db, table, column), so only pairs
    that share a column (or have none to compare) ever meet, and a table with many
    queries and many indexes is spread over its columns.  ``queries``: ids, _db, key,
    cols; ``indexes``: migration_id, db_id, itable, index_name, icols, m.
    """
    q = queries.select(*ids, "_db", "key", F.lower("key").alias("_table"), _query_keys(F.col("cols")).alias("_qkeys"))
    q = q.select("*", F.explode("_qkeys").alias("_col"))
    i = indexes.select("migration_id", "db_id", "itable", "index_name", "m", "icols", _index_keys(F.col("icols")).alias("_ikeys"))
    i = i.select("*", F.explode("_ikeys").alias("icol"))
    met = q.join(i.hint("merge"), (q._db == i.db_id) & (q._table == i.itable) & (q._col == i.icol))
    # a pair that shares several columns is met under each of them and counts under the first: no pair is shuffled
    met = met.filter(F.get(F.array_intersect("_qkeys", "_ikeys"), F.lit(0)) == F.col("_col"))
    return met.select(*ids, "_db", "key", "migration_id", "index_name", "icols", "m")


def match_impacts(refs: DataFrame, changes: DataFrame, migrations: DataFrame) -> DataFrame:
    """Q7-Q11: impacts of each migration on the queries of its database's logs, with the whole query text.

    ``refs`` is the output of ``with_references`` on ``extract_queries``;
    ``changes`` the long schema changes; ``migrations`` gives each migration its
    db_id.  Output: migration_id, log_id, query, impact_type, severity,
    description, affected_table, affected_column.
    """
    refs = _database(refs)
    qid = ["log_id", "query", "_db"]
    cols = expanded_column_refs(refs, qid)
    ck = column_change_keys(changes, migrations)
    # both sides grow with the data (queries per log, changes per migration): merge join on
    # (db, table, column); AQE splits a skewed key
    j = cols.join(ck.hint("merge"), (cols._db == ck.db_id) & (cols.tkey == ck.ctable)
                  & (F.lower(cols.col) == ck.ccol))
    ctype = F.col("change_type")
    impact_type = (F.when(ctype == "removed", "column_missing").when(ctype == "renamed", "column_renamed")
                   .otherwise("type_mismatch"))
    severity = F.when(ctype == "removed", "critical").when(ctype == "renamed", "high").otherwise("medium")
    desc = (F.when(ctype == "removed", fill(fixed.IMPACT_COLUMN_MISSING, col=F.col("col"), table=F.col("tkey")))
            .when(ctype == "renamed", fill(fixed.IMPACT_COLUMN_RENAMED, col=F.col("col"), table=F.col("tkey")))
            .otherwise(fill(fixed.IMPACT_TYPE_MISMATCH, col=F.col("col"), table=F.col("tkey"))))
    col_impacts = j.select(
        "migration_id", "log_id", "query",
        impact_type.alias("impact_type"), severity.alias("severity"), desc.alias("description"),
        F.col("tkey").alias("affected_table"), F.col("col").alias("affected_column"),
    )
    keys = refs.select(*qid, F.explode("key_cols").alias("_kc")).select(
        *qid, F.col("_kc.key").alias("key"), F.col("_kc.cols").alias("cols"))
    met = _met_indexes(keys, ["log_id", "query"], _dropped_indexes(changes, migrations))
    ij = met.select("*", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("_copy"))   # an index dropped twice counts twice
    idx_impacts = ij.select(
        "migration_id", "log_id", "query",
        F.lit("index_missing").alias("impact_type"), F.lit("medium").alias("severity"),
        fill(fixed.IMPACT_INDEX_MISSING, index=F.col("index_name"), table=F.col("key")).alias("description"),
        F.col("key").alias("affected_table"), F.lit(None).cast("string").alias("affected_column"),
    )
    return col_impacts.unionByName(idx_impacts)


_COUNTS = {"removed": "column_missing", "renamed": "column_renamed", "type_changed": "type_mismatch"}


def impact_summary(refs: DataFrame, changes: DataFrame, migrations: DataFrame) -> DataFrame:
    """Per migration: number of impacts by type and the worst severity.

    Counts what ``match_impacts`` would list without building the pairs:
    references are counted per (db, table, column), and per (db, table, set of
    columns) for indexes, and joined to the distinct changes with their counts.
    """
    refs = _database(refs)
    cols = (expanded_column_refs(refs, ["_db"]).groupBy("_db", "tkey", F.lower("col").alias("lcol"))
            .agg(F.count(F.lit(1)).alias("n")))
    ck = column_change_keys(changes, migrations)
    by_column = cols.join(ck.hint("merge"), (cols._db == ck.db_id) & (cols.tkey == ck.ctable) & (cols.lcol == ck.ccol)).select(
        "migration_id", F.create_map(*[F.lit(x) for kv in _COUNTS.items() for x in kv])[F.col("change_type")].alias("kind"), "n")
    keys = refs.select("_db", F.explode("key_cols").alias("_kc")).select(
        "_db", F.lower("_kc.key").alias("key"), F.array_sort("_kc.cols").alias("cols")) \
        .groupBy("_db", "key", "cols").agg(F.count(F.lit(1)).alias("n"))
    met = _met_indexes(keys, ["cols", "n"], _dropped_indexes(changes, migrations))
    by_index = met.select("migration_id", F.lit("index_missing").alias("kind"), (F.col("n") * F.col("m")).alias("n"))
    names = [*_COUNTS.values(), "index_missing"]
    agg = by_column.unionByName(by_index).groupBy("migration_id").agg(
        F.sum("n").alias("n_impacts"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in names])
    m = migrations.select("migration_id").join(agg, "migration_id", "left")
    worst = (F.when(F.col("column_missing") > 0, "critical").when(F.col("column_renamed") > 0, "high")
             .when(F.col("n_impacts") > 0, "medium"))
    return m.select("migration_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ["n_impacts", *names]],
                    worst.alias("worst_impact"))
