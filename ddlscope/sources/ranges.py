"""Files longer than a task: scripts, dumps and logs read in ranges of lines and cut between statements or entries.

Spark deals a file out by byte ranges; a range's reader starts at the next line.
Whether a range starts inside a string, a comment or a dollar body is not known
there, so the state is found by a parallel prefix:

1. every range says which closing marks it holds (a quote that nothing closes
   later is an ordinary character, as for whole texts);
2. every range gives a map from each state it may start in to the state it ends in
   (``state_map``); a start inside a string joins the one outside as soon as both
   stand at the same place outside, so the map costs little more than one pass;
3. the maps of a file, a narrow row for each range, are composed in order, which
   gives each range its true start;
4. each range is cut behind its last statement end: what stands before goes to
   the chunk that ends there, the rest to the chunk of the next range with an end.

The chunks hold whole statements, in order, so the operators that read scripts by
``chunk_id`` give the rows of the whole file.  A chunk is as long as a range and the
statement that runs into it.  A line is the least that is read at once.

Logs need no quotes: an entry runs from a verb to the next ``;``, or is a line.
Behind a ``;`` no entry is open, and a line's end is outside any entry if no verb
stands since the last ``;`` or no ``;`` follows in the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ddlscope.functions import patterns
from ddlscope.functions.text import basename
from ddlscope.session import written
from ddlscope.sources.files import infer_dialect

#: Characters of a range, about; and the mark of a chunk that starts inside a line.
RANGE_CHARS = 1 << 20
INSIDE_LINE = "\u0001"
RANGES = "path string, block long, seq long, text string"


def line_ranges(spark: SparkSession, paths: str | list[str], range_chars: int = RANGE_CHARS) -> DataFrame:
    """(path, block, seq, text): whole lines of each part of a file that one reader gets, in order of (block, seq)."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, held, size = None, 0, [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([seq], pa.int64()),
                                               pa.array(["".join(held)], pa.string())], ["path", "block", "seq", "text"])

        for batch in batches:
            for path, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (key != (path, block) or size >= range_chars):
                    yield done()
                    seq, held, size = seq + 1, [], 0
                key = path, block
                held.append(line + "\n")
                size += len(line) + 1
        if held:
            yield done()

    return lines.mapInArrow(rows, RANGES)


def _numbered(ranges: DataFrame) -> DataFrame:
    """Ranges with ``n``, their number in the file; only (path, block, seq) pass through the window."""
    order = Window.partitionBy("path").orderBy("block", "seq")
    numbers = ranges.select("path", "block", "seq", F.row_number().over(order).cast("long").alias("n"))
    return ranges.join(numbers, ["path", "block", "seq"]).drop("block", "seq")


# ---- states of a script ------------------------------------------------------

class Lexer:
    """Where a text of whole lines ends: '' outside, a quote, 'E', '$tag$', or 'c' and the depth of a comment."""

    def __init__(self, dialect: str):
        self.nested = dialect in ("postgres", "postgresql", "tsql", "mssql")
        backslash = dialect == "mysql"
        brackets = dialect in ("tsql", "mssql", "sqlite")
        string = r"(?:[^{0}\\]|\\.)*{0}" if backslash else r"[^{0}]*{0}"
        self.closer = {q: re.compile(string.format(q), re.S) for q in "'\""} | {"`": re.compile("[^`]*`"), "[": re.compile(r"[^\]]*\]")}
        self.closer["E"] = re.compile(r"(?:[^'\\]|\\.)*'", re.S)
        opening = [r"(?P<line>--" + ("|#)" if backslash else ")"), r"(?P<block>/\*)", r"(?P<dollar>\$\w*\$)", r"(?P<end>;)"]
        if dialect in ("tsql", "mssql"):
            opening.append(r"(?P<go>(?mi:^[ \t]*GO(?:[ \t]+\d+)?[ \t]*\r?$))")
        if dialect in ("postgres", "postgresql"):
            opening.append(r"(?P<escape>(?<!\w)[Ee]')")
        opening.append(r"(?P<quote>['\"`" + (r"\[" if brackets else "") + "])")
        self.opening = re.compile("|".join(opening), re.A)
        self.starts = ["'", '"', "`", "E", *(["["] if brackets else []), *([] if self.nested else ["c1"])]

    def _close(self, text: str, state: str, at: int) -> tuple[str, int]:
        """(state, place) behind what is open at ``at``, or where it still stands open at the end."""
        if state[0] == "c":
            depth = int(state[1:])
            while depth:
                m = re.compile(r"/\*|\*/" if self.nested else r"\*/").search(text, at)
                if not m:
                    return f"c{depth}", len(text)
                depth, at = depth + (1 if m[0] == "/*" else -1), m.end()
            return "", at
        if state[0] == "$":
            end = text.find(state, at)
            return ("", end + len(state)) if end >= 0 else (state, len(text))
        m = self.closer[state].match(text, at)
        return ("", m.end()) if m else (state, len(text))

    def run(self, text: str, state: str, later: set[str], seen: dict[int, None] | None = None, stop: dict | None = None) -> tuple[str | None, int]:
        """(state at the end, place behind the last statement end, 0 if there is none).

        ``later``: marks that occur in later ranges.  ``seen`` gathers the places outside;
        at one of ``stop`` the run breaks off with None, as it goes on as the run that was there.
        """
        at, cut = 0, 0
        if state:
            state, at = self._close(text, state, 0)
        while not state:
            if stop is not None and at in stop:
                return None, cut
            if seen is not None:
                seen[at] = None
            m = self.opening.search(text, at)
            if not m:
                break
            kind = m.lastgroup
            if kind == "line":
                end = re.compile(r"[\r\n]").search(text, m.end())
                at = end.start() if end else len(text)
            elif kind in ("end", "go"):
                at = cut = m.end()
            else:
                opened = {"block": "c1", "escape": "E", "dollar": m[0]}.get(kind, m[0])
                state, at = self._close(text, opened, m.end())
                mark = {"E": "'", "[": "]"}.get(opened, opened)
                if state and state[0] != "c" and mark not in later:
                    state, at = "", m.start() + 1  # never closed: an ordinary character
        return state, cut

    def marks(self, text: str) -> list[str]:
        """Closing marks that occur in a text."""
        return [q for q in "'\"`]" if q in text] + sorted(set(re.findall(r"(?=(\$\w*\$))", text, re.A)))

    def state_map(self, text: str, later: set[str], tags: list[str]) -> tuple[dict[str, str], int]:
        """({start: end}, change of depth for comments deeper than any start in the map)."""
        seen: dict[int, None] = {}
        outside, _ = self.run(text, "", later, seen=seen)
        total, lowest, deep = 0, 0, []
        if self.nested:
            for m in re.finditer(r"/\*|\*/", text):
                total += 1 if m[0] == "/*" else -1
                if total < lowest:  # a comment of so many levels ends here
                    lowest = total
                    deep.append(f"c{-lowest}")
        out = {"": outside}
        for start in [*self.starts, *tags, *deep]:
            end, _ = self.run(text, start, later, stop=seen)
            out[start] = outside if end is None else end
        return out, total


def _mapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ends, change = Lexer(r["dialect"]).state_map(r["text"], set(r["later"] or []), r["tags"] or [])
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["n"]]), pa.array([list(ends.items())], pa.map_(pa.string(), pa.string())),
                                              pa.array([change], pa.int32())], ["path", "n", "ends", "change"])


def _compose(table: pa.Table) -> pa.Table:
    """The true start of each range of a file, from the maps in order."""
    state, out = "", []
    for r in table.sort_by("n").to_pylist():
        out.append((r["path"], r["n"], state))
        ends = dict(r["ends"])
        state = ends[state] if state in ends else f"c{int(state[1:]) + r['change']}"
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["path", "n", "start"])


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            _, cut = Lexer(r["dialect"]).run(r["text"], r["start"], set(r["later"] or []))
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["n"]]), pa.array([cut > 0]), pa.array([r["text"][:cut]], pa.string()),
                                              pa.array([r["text"][cut:]], pa.string())], ["path", "n", "ends", "head", "tail"])


def _marking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["n"]]), pa.array([Lexer("").marks(r["text"])], pa.list_(pa.string()))],
                                             ["path", "n", "marks"])


def _chunks(pieces: DataFrame) -> DataFrame:
    """(path, chunk_id, text) of (path, n, ends, head, tail): what lies between two ends."""
    order = Window.partitionBy("path").orderBy("n")
    here = F.when(F.col("ends"), F.col("n"))
    rest = F.lit(1 << 62)
    places = pieces.select("path", "n", F.coalesce(F.min(here).over(order.rowsBetween(0, Window.unboundedFollowing)), rest).alias("of_head"),
                           F.coalesce(F.min(here).over(order.rowsBetween(1, Window.unboundedFollowing)), rest).alias("of_tail"))
    parts = pieces.join(places, ["path", "n"]).select("path", F.inline(F.array(
        F.struct(F.when(F.col("ends"), F.col("of_head")).alias("chunk_id"), F.col("n"), F.lit(0).alias("k"), F.col("head").alias("text")),
        F.struct(F.col("of_tail").alias("chunk_id"), F.col("n"), F.lit(1).alias("k"), F.col("tail").alias("text")))))
    parts = parts.filter(F.col("chunk_id").isNotNull() & (F.col("text") != ""))
    return parts.groupBy("path", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "k", "text"))),
                                                                          lambda x: x["text"]), "").alias("text"))


def statement_chunks(ranges: DataFrame) -> DataFrame:
    """(path, chunk_id, text) of ranges (path, block, seq, text, dialect): chunks that end with a statement."""
    ranges = written(_numbered(ranges), "ranges")
    marks = written(ranges.select("path", "n", "text").mapInArrow(_marking, "path string, n long, marks array<string>"), "marks")
    # marks of later ranges and the dollar tags of the file: sets of short strings, a row for each range
    after = Window.partitionBy("path").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    known = marks.select("path", "n", F.array_distinct(F.flatten(F.collect_set("marks").over(after))).alias("later"),
                         F.array_distinct(F.flatten(F.collect_set("marks").over(Window.partitionBy("path")))).alias("all"))
    known = known.select("path", "n", "later", F.filter("all", lambda m: m.startswith("$")).alias("tags"))
    marked = written(ranges.join(known, ["path", "n"]), "marked-ranges")
    maps = marked.mapInArrow(_mapping, "path string, n long, ends map<string,string>, change int")
    starts = maps.groupBy("path").applyInArrow(_compose, "path string, n long, start string")
    pieces = marked.join(starts, ["path", "n"]).mapInArrow(_cutting, "path string, n long, ends boolean, head string, tail string")
    return _chunks(written(pieces, "pieces"))


def read_scripts(spark: SparkSession, paths: str | list[str], range_chars: int = RANGE_CHARS) -> DataFrame:
    """S1 in ranges: (migration_id, chunk_id, path, file_name, dialect, text); chunks of a script end with a statement."""
    ranges = line_ranges(spark, paths, range_chars).withColumn("dialect", infer_dialect(F.col("path")))
    return statement_chunks(ranges).select(F.col("path").alias("migration_id"), "chunk_id", "path", basename(F.col("path")).alias("file_name"),
                                           infer_dialect(F.col("path")).alias("dialect"), "text")


def read_schema_dumps(spark: SparkSession, paths: str | list[str], range_chars: int = RANGE_CHARS) -> DataFrame:
    """S5 in ranges: (schema_id, part, text); the parts of a dump sort in its order."""
    ranges = line_ranges(spark, paths, range_chars).withColumn("dialect", F.lit(""))
    return statement_chunks(ranges).select(F.col("path").alias("schema_id"), F.format_string("%020d", "chunk_id").alias("part"), "text")


# ---- logs --------------------------------------------------------------------

def entry_chunks(ranges: DataFrame) -> DataFrame:
    """(path, chunk_id, text) of log ranges: chunks that end outside any entry."""
    ranges = written(_numbered(ranges), "ranges")
    verb = f"(?is)(?:{patterns.VERBS})\\b"
    tail = F.substring_index("text", ";", -1)
    facts = ranges.select("path", "n", F.col("text").contains(";").alias("semi"), tail.rlike(verb).alias("verb"))
    order = Window.partitionBy("path").orderBy("n")
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    # number of the last range up to here with a ';', and of the last with a verb behind its last ';'
    last_semi = F.coalesce(F.max(F.when(F.col("semi"), F.col("n"))).over(upto), F.lit(0))
    last_verb = F.coalesce(F.max(F.when(F.col("verb"), F.col("n"))).over(upto), F.lit(-1))
    more = F.coalesce(F.max("semi").over(after), F.lit(False))
    known = facts.select("path", "n", "semi", ((last_verb < last_semi) | ~more).alias("line_end"))
    # the whole range if its end is outside; else up to its last ';'
    head: Column = F.when(F.col("line_end"), F.col("text")).when(F.col("semi"), F.substring(F.col("text"), F.lit(1), F.length("text") - F.length(tail))).otherwise("")
    inside = F.when(F.col("line_end"), "").when(F.col("semi"), F.concat(F.lit(INSIDE_LINE), tail)).otherwise(F.col("text"))
    pieces = ranges.join(known, ["path", "n"]).select("path", "n", (F.col("line_end") | F.col("semi")).alias("ends"), head.alias("head"), inside.alias("tail"))
    return _chunks(written(pieces, "pieces"))


def read_query_logs(spark: SparkSession, paths: str | list[str], range_chars: int = RANGE_CHARS) -> DataFrame:
    """S4 in ranges: (log_id, chunk_id, text); invalid bytes are left out, as for whole files."""
    return entry_chunks(line_ranges(spark, paths, range_chars)).select(F.col("path").alias("log_id"), "chunk_id",
                                                                       F.regexp_replace("text", "�", "").alias("text"))
