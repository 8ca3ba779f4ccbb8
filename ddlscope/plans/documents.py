"""Whole documents: the nested JSON report (S6, K6), the narration inputs (K8) and the Markdown file of each migration.

``all_documents`` puts the three documents of every migration that fits a piece
together behind one shuffle: operations move as they were extracted (locks,
rollback and scores are worked out behind it), and a query's text once to each
migration that it meets.

Documents of larger migrations are built in two levels, so that no large migration's operations or
impacts are ever collected into one task's list:

1. *Pieces*.  The bytes of each migration are added up first.  Where they fit
   a piece, each list (operations, impacts, rollback steps, lines) is one piece,
   put together where the migration's rows are.  The entries of larger ones
   are range-partitioned on (migration, list, order key), which spreads a
   migration with a third of all entries over many tasks; inside a range a
   running sum of bytes cuts them into pieces of ``PIECE_BYTES`` (and the entry
   that crosses the limit).  A piece is one row; the texts of all pieces of a
   migration in the order (part, place, piece) are the document.
2. *Documents*.  The pieces of a migration, few and large, are put together.
   A document is one value, bounded by what a string holds (2 GB); whoever has
   larger ones reads the pieces.

Entries with equal order keys are equal texts (an index dropped twice), so
ties don't matter.  Migrations without operations or impacts have empty lists,
null columns are JSON nulls, an empty corpus gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ddlscope.operators import rollback, scoring
from ddlscope.operators.rollback import rollback_step
from ddlscope.plans.analysis import Analysis
from ddlscope.plans.report import impact_key, markdown_lines
from ddlscope.session import broadcast_if_small, written

#: Bytes of a piece, at which the next one begins.
PIECE_BYTES = 1 << 20
#: Bytes that the names and marks of a record take besides its values, at most (an operation in the report has the most).
RECORD_BYTES = 600
#: Operations and impacts that are put together in one task, about.
TASK_ROWS = 50_000

_JSON = {"ignoreNullFields": "false"}
_PLACE = ["migration_id", "part", "place", "piece"]


def _text(value: Column) -> Column:
    return F.to_json(value, _JSON)


def _object(*fields) -> Column:
    return _text(F.struct(*fields))


def _open(*fields) -> Column:
    """The object's text without its last brace."""
    return _cut(_object(*fields), 0, 1)


def _cut(text: Column, front: int, back: int) -> Column:
    return F.substring(text, F.lit(front + 1), F.length(text) - front - back)


def list_pieces(entries: DataFrame, separator: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(migration_id, part, place, piece, text) of entries (migration_id, part, key, text); all pieces but a list's first begin with the separator."""
    sizes = entries.groupBy("migration_id").agg(F.sum(F.octet_length("text")).alias("n"))
    large = written(sizes.filter(F.col("n") > piece_bytes).select("migration_id"), "large")
    small, rest = _split([entries], large)
    out = _single_pieces(small[0].repartition("migration_id"), separator)
    return out if rest is None else out.unionByName(_ranged_pieces(rest[0], separator, piece_bytes))


def _split(frames: list[DataFrame], large: DataFrame) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The rows of all migrations but the ``large`` ones, and of those (None if there are none)."""
    if large.isEmpty():
        return frames, None
    large = broadcast_if_small(large)
    return [df.join(large, "migration_id", "left_anti") for df in frames], [df.join(large, "migration_id", "left_semi") for df in frames]


def _single_pieces(entries: DataFrame, separator: str) -> DataFrame:
    """Each list as one piece, of migrations that fit one."""
    texts = F.sort_array(F.collect_list(F.struct("key", "text")))["text"]
    return entries.groupBy("migration_id", "part").agg(F.array_join(texts, separator).alias("text")).select(
        "migration_id", "part", F.lit(0).alias("place"), F.lit(0).cast("long").alias("piece"), "text")


def _ranged_pieces(entries: DataFrame, separator: str, piece_bytes: int) -> DataFrame:
    ranged = entries.repartitionByRange("migration_id", "part", "key").withColumn("place", F.spark_partition_id())
    w = Window.partitionBy("migration_id", "part", "place").orderBy("key")
    before = F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.octet_length("text")
    cut = ranged.select("migration_id", "part", "place", "text", F.row_number().over(w).alias("n"), F.floor(before / piece_bytes).alias("piece"))
    texts = F.sort_array(F.collect_list(F.struct("n", "text")))["text"]
    held = written(cut.groupBy(*_PLACE).agg(F.array_join(texts, separator).alias("text")), "pieces")
    first = held.groupBy("migration_id", "part").agg(F.min(F.struct("place", "piece")).alias("_at")) \
        .select("migration_id", "part", "_at.place", "_at.piece", F.lit(True).alias("_first"))
    # joined on all four columns, so the pieces of one migration stay spread
    return held.join(first.hint("merge"), _PLACE, "left").select(
        *_PLACE, F.when(F.col("_first"), F.col("text")).otherwise(F.concat(F.lit(separator), F.col("text"))).alias("text"))


def _fixed(texts: DataFrame, *parts: tuple[int, Column]) -> DataFrame:
    """Pieces that every migration has once."""
    found = F.array(*[F.struct(F.lit(p).alias("part"), t.alias("text")) for p, t in parts])
    return texts.select("migration_id", F.explode(found).alias("_p")).select(
        "migration_id", "_p.part", F.lit(0).alias("place"), F.lit(0).cast("long").alias("piece"), "_p.text")


def _entries(df: DataFrame, part: int, key: Column, text: Column) -> DataFrame:
    return df.select("migration_id", F.lit(part).alias("part"), key.alias("key"), text.alias("text"))


def _op_entries(ops: DataFrame, *parts: tuple[int, Column]) -> DataFrame:
    """Entries of every operation, one for each part."""
    found = F.array(*[F.struct(F.lit(p).alias("part"), t.alias("text")) for p, t in parts])
    return ops.select("migration_id", _at().alias("key"), F.explode(found).alias("_p")).select("migration_id", "_p.part", "key", "_p.text")


def _at(*impact: Column) -> Column:
    """Order key of an operation (its position) or of an impact (its own text)."""
    pos, text = ((F.lit(0), F.lit(0)), impact[0]) if impact else ((F.col("stmt_pos"), F.col("action_pos")), F.lit(""))
    return F.struct(pos[0].cast("long").alias("k1"), pos[1].cast("long").alias("k2"), text.alias("k3"))


def _large(a: Analysis, piece_bytes: int) -> DataFrame:
    """(migration_id): migrations whose operations and impacts may not fit a piece; worked out once for all kinds of documents.

    The impacts have the length of their query in place of its text, so no text is moved or
    built.  Values are counted as they are; escapes can make a record up to six times as long.
    """
    found = a.__dict__.setdefault("_large_migrations", {})
    if piece_bytes not in found:
        def size(*names: str) -> Column:
            return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in names), F.lit(RECORD_BYTES)).cast("long")

        impacts = a.impact_hits
        ops = a.ops.withColumn("_notes", F.array_join("notes", ""))
        n_ops = size("raw_sql", "op_class", "target_table", "target_column", "target_index", "rollback_description", "_notes")
        n_impacts = size("description", "affected_table", "affected_column") + F.col("query.bytes").cast("long")
        sizes = ops.select("migration_id", n_ops.alias("n")).unionByName(impacts.select("migration_id", n_impacts.alias("n")))
        sums = sizes.groupBy("migration_id").agg(F.sum("n").alias("n"))
        found[piece_bytes] = written(sums.filter(F.col("n") > piece_bytes).select("migration_id"), "large")
    return found[piece_bytes]


def _analysis_pieces(a: Analysis, entries: Callable[[DataFrame, DataFrame], DataFrame], ops: DataFrame, piece_bytes: int) -> DataFrame:
    """``list_pieces`` of the ``entries`` of operations and impacts.

    The rows are moved to their migration as they are: keys and texts, in which a query
    stands again, are built behind the shuffle.
    """
    small, rest = _split([ops, a.impacts], _large(a, piece_bytes))
    out = _single_pieces(entries(*(df.repartition("migration_id") for df in small)), ",")
    return out if rest is None else out.unionByName(_ranged_pieces(entries(*rest), ",", piece_bytes))


def whole(pieces: DataFrame) -> DataFrame:
    """(migration_id, document): each migration's pieces in order."""
    texts = F.sort_array(F.collect_list(F.struct("part", "place", "piece", "text")))["text"]
    return pieces.groupBy("migration_id").agg(F.array_join(texts, "").alias("document"))


def _notes() -> Column:
    return F.coalesce(F.col("notes"), F.array().cast("array<string>")).alias("notes")


def _none(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def _no_queries() -> Column:
    """The analysed tool declares an operation's affected queries and never fills them; impacts are listed per migration."""
    return F.array().cast("array<string>").alias("affected_queries")


def _rollback(*more) -> list[Column]:
    return [F.col("rollback_complexity").alias("complexity"), F.col("rollback_minutes").alias("estimated_minutes"), *more]


Fixed = list[tuple[int, Column]]


def _report_operation() -> Column:
    """An operation in the report, from a row with ``safe_rewrite``."""
    return F.struct(
        F.col("op_class").alias("operation_class"), "target_table", "target_column", "target_index", "dialect", "raw_sql", "risk_level", "lock_type",
        F.col("duration_min").alias("estimated_duration_min"), F.col("duration_max").alias("estimated_duration_max"), "rollback_complexity",
        "rollback_description", _no_queries(), _notes(), _none("llm_summary"), "safe_rewrite")


def _report_impact() -> Column:
    return F.struct("query", "impact_type", "severity", "description", "affected_table", "affected_column")


def _report_fixed(generated_at: str = "1970-01-01T00:00:00Z", schema_file: str | None = None, query_log_file: str | None = None) -> Fixed:
    """What stands around the lists (parts 1, 3, 5 and 7) of a report; a row has the texts written elsewhere and whether there are rewrites."""
    return [
        (0, F.concat(_open(F.col("file_name").alias("migration_file"), F.lit(schema_file).cast("string").alias("schema_file"),
                           F.lit(query_log_file).cast("string").alias("query_log_file"), F.lit(generated_at).alias("generated_at"),
                           "dialect", "db_version"), F.lit(',"operations":['))),
        (2, F.lit('],"query_impacts":[')),
        (4, F.concat(F.lit('],"rollback":'), _open(*_rollback()), F.lit(',"steps":['))),
        (6, F.concat(F.lit("],"), _cut(_object("data_loss_risk", F.col("rollback_notes").alias("notes")), 1, 0), F.lit(","),
                     _cut(_object("plain_english_summary", "stakeholder_summary"), 1, 1), F.lit(',"safe_rewrite_sql":'),
                     F.when(F.col("_rewritten"), F.lit('"')).otherwise(F.lit("null")))),
        (8, F.concat(F.when(F.col("_rewritten"), F.lit('"')).otherwise(F.lit("")), F.lit("}")))]


def _unwritten(head: DataFrame) -> DataFrame:
    return head.select("*", _none("plain_english_summary"), _none("stakeholder_summary"))


def _payload_operation() -> Column:
    return F.struct(
        F.col("op_class").alias("operation"), F.col("target_table").alias("table"), F.col("target_column").alias("column"), "risk_level", "lock_type",
        F.col("duration_min").alias("duration_min_minutes"), F.col("duration_max").alias("duration_max_minutes"), "rollback_complexity",
        "rollback_description", _notes(), _no_queries())


def _payload_impact() -> Column:
    return F.struct("query", "impact_type", "severity", "description")


def _payload_fixed() -> Fixed:
    return [
        (0, F.concat(_open(F.col("file_name").alias("migration_file"), "dialect", "db_version", F.col("overall_score").alias("overall_risk_score"),
                           F.col("overall_level").alias("overall_risk_level")), F.lit(',"operations":['))),
        (2, F.lit('],"query_impacts":[')),
        (4, F.concat(F.lit('],"rollback":'), _object(*_rollback("data_loss_risk", F.col("rollback_notes").alias("notes"))), F.lit("}")))]


def _finding() -> Column:
    return F.struct(F.col("op_class").alias("op"), F.col("target_table").alias("table"), _notes())


def _finding_fixed() -> Fixed:
    return [(0, F.lit('{"operations":[')), (2, F.lit("]}"))]


def report_pieces(a: Analysis, generated_at: str = "1970-01-01T00:00:00Z", schema_file: str | None = None, query_log_file: str | None = None,
                  rewrites: DataFrame | None = None, summaries: DataFrame | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Pieces of every migration's JSON report: header, operations, impacts, rollback with its steps, texts written elsewhere.

    ``rewrites`` (migration_id, stmt_pos, action_pos, safe_rewrite) and
    ``summaries`` (migration_id, plain_english_summary, stakeholder_summary) have
    one row per key, as in ``markdown_lines``.
    """
    a = a.shared()
    ops = a.ops.withColumn("safe_rewrite", F.lit(None).cast("string")) if rewrites is None else \
        a.ops.join(rewrites, ["migration_id", "stmt_pos", "action_pos"], "left")
    head = _unwritten(a.heads) if summaries is None else a.heads.join(summaries, "migration_id", "left")
    rewritten = ops.filter(F.col("safe_rewrite") != "")
    if rewrites is None:
        head = head.withColumn("_rewritten", F.lit(False))
    else:
        head = head.join(rewritten.select("migration_id", F.lit(True).alias("_rewritten")).distinct(), "migration_id", "left")

    def entries(ops: DataFrame, impacts: DataFrame) -> DataFrame:
        step = _cut(_object(rollback_step(ops).alias("step")), len('{"step":'), 1)
        return _op_entries(ops, (1, _text(_report_operation())), (5, step)).unionByName(
            _entries(impacts, 3, _at(impact_key()), _text(_report_impact())))

    fixed = _fixed(head, *_report_fixed(generated_at, schema_file, query_log_file))
    if rewrites is None:
        return fixed.unionByName(_analysis_pieces(a, entries, ops, piece_bytes))
    out = fixed.unionByName(list_pieces(entries(ops, a.impacts), ",", piece_bytes))
    sql = F.concat(F.lit("-- Rewrite for: "), F.col("op_class"), F.lit(" on "), F.col("target_table"), F.lit("\n"), F.col("safe_rewrite"))
    texts = _entries(rewritten, 7, _at(), _cut(_object(sql.alias("x")), len('{"x":"'), len('"}')))
    return out.unionByName(list_pieces(texts, "\\n\\n", piece_bytes))


def payload_pieces(a: Analysis, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """K8: pieces of what a narrator receives of every migration: scores, operations, impacts and rollback."""
    a = a.shared()

    def entries(ops: DataFrame, impacts: DataFrame) -> DataFrame:
        return _entries(ops, 1, _at(), _text(_payload_operation())).unionByName(
            _entries(impacts, 3, _at(impact_key()), _text(_payload_impact())))

    fixed = _fixed(a.heads, *_payload_fixed())
    return fixed.unionByName(_analysis_pieces(a, entries, a.ops, piece_bytes))


def finding_pieces(a: Analysis, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """K8: pieces of the smaller findings: class, table and notes of every operation."""
    a = a.shared()
    ops = _entries(a.ops, 1, _at(), _text(_finding()))
    return _fixed(a.migrations, *_finding_fixed()).unionByName(list_pieces(ops, ",", piece_bytes))


def markdown_pieces(a: Analysis, piece_bytes: int = PIECE_BYTES, **texts) -> DataFrame:
    """Pieces of every migration's Markdown file; ``texts`` as ``markdown_lines`` takes them."""
    lines = markdown_lines(a, **texts)
    return list_pieces(_entries(lines, 0, F.struct("section", "k1", "k2", "k3", "k4"), F.col("line")), "\n", piece_bytes)


def all_documents(a: Analysis, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(migration_id, kind, document): the report, the payload and the findings of every migration."""
    a = a.shared()
    large = _large(a, piece_bytes)
    small, rest = _split([a.migrations, a.extracted, a.impact_hits], large)
    out = _small_documents(a, *small)
    if rest is None:
        return out
    # impacts with their texts: those of large migrations alone are moved so
    impacts = a.impacts.join(broadcast_if_small(large), "migration_id", "left_semi")
    b = a.over(migrations=rest[0], extracted=rest[1], impacts=impacts, _large_migrations={piece_bytes: large})
    for kind, pieces in (("report", report_pieces), ("payload", payload_pieces), ("findings", finding_pieces)):
        out = out.unionByName(whole(pieces(b, piece_bytes=piece_bytes)).select("migration_id", F.lit(kind).alias("kind"), "document"))
    return out


def _small_documents(a: Analysis, migrations: DataFrame, extracted: DataFrame, hits: DataFrame) -> DataFrame:
    """``all_documents`` of migrations that fit a piece; all rows of a migration meet in one task.

    Lists are collected as values, which are smaller than their texts, and turned to text whole.
    """
    tasks = max(int(a.spark.conf.get("spark.sql.shuffle.partitions")), -(-(a.extracted.count() + a.impact_hits.count()) // TASK_ROWS))
    ops = a.over(extracted=extracted.repartition(tasks, "migration_id")).ops.withColumn("safe_rewrite", F.lit(None).cast("string"))
    told = F.struct(_at().alias("key"), _report_operation().alias("report"), rollback_step(ops).alias("step"), _payload_operation().alias("payload"),
                    _finding().alias("finding"))
    by_ops = ops.groupBy("migration_id").agg(*scoring.score_parts(), *rollback.summary_parts(), F.sort_array(F.collect_list(told)).alias("_ops"))

    # a query's text moves once to each migration that it meets, however many impacts they have
    values = ["impact_type", "severity", "description", "affected_table", "affected_column"]
    pairs = hits.groupBy("migration_id", F.col("query.query_id").alias("query_id")).agg(F.collect_list(F.struct(*values)).alias("_met"))
    pairs = pairs.join(a.impact_refs.select("query_id", "query").hint("merge"), "query_id").drop("query_id").repartition(tasks, "migration_id")
    impacts = pairs.select("migration_id", "query", F.inline("_met"))
    met = F.struct(impact_key().alias("key"), _report_impact().alias("report"), _payload_impact().alias("payload"))
    by_hits = impacts.groupBy("migration_id").agg(F.sort_array(F.collect_list(met)).alias("_hits"))

    rows = migrations.join(by_ops.hint("merge"), "migration_id", "left").join(by_hits.hint("merge"), "migration_id", "left")
    heads = rows.select(*migrations.columns, *scoring.scores_of_parts(), *rollback.summary_of_parts(), "_ops", "_hits", F.lit(False).alias("_rewritten"))
    lists = {"_ops": ["report", "step", "payload", "finding"], "_hits": ["report", "payload"]}
    # columns of their own: a text is worked out once
    heads = _unwritten(heads).select("*", *(_text(F.col(f"{name}.{x}")).alias(f"{name}_{x}") for name, some in lists.items() for x in some))

    def document(fixed: Fixed, listed: dict[int, str]) -> Column:
        # the brackets of a list stand in the fixed parts, as pieces need them
        parts = dict(fixed) | {part: F.coalesce(_cut(F.col(name), 1, 1), F.lit("")) for part, name in listed.items()}
        return F.concat(*(parts[p] for p in sorted(parts)))

    kinds = {"report": document(_report_fixed(), {1: "_ops_report", 3: "_hits_report", 5: "_ops_step"}),
             "payload": document(_payload_fixed(), {1: "_ops_payload", 3: "_hits_payload"}), "findings": document(_finding_fixed(), {1: "_ops_finding"})}
    found = F.array(*(F.struct(F.lit(kind).alias("kind"), text.alias("document")) for kind, text in kinds.items()))
    return heads.select("migration_id", F.explode(found).alias("_d")).select("migration_id", "_d.*")


def write_documents(pieces: DataFrame, path: str) -> None:
    """One file per migration, ``path/migration_id=<id>/part-*.txt``, whole or not there.

    A document is one row, so one task writes its file; the job's commit moves files
    of successful attempts only, so a repeated task leaves no second one.
    """
    whole(pieces).write.mode("overwrite").partitionBy("migration_id").text(path)
