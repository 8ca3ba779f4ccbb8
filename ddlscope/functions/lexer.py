"""Lexical helpers by dialect: quotes, dollar bodies, comments and parentheses of SQL text.

One token grammar drives comment removal, statement split, action split and
clause scans.  A quoted token is '..', "..", `..` or $tag$..$tag$ (a doubled
quote is two tokens side by side); a quote that is never closed counts as an
ordinary character.  Per dialect:

* MySQL: a backslash takes the next character into the string; ``#`` opens a line comment;
* PostgreSQL: the same backslash in E'..' strings; block comments nest;
* T-SQL: [..] names; block comments nest; a line with GO alone ends a statement;
* SQLite: [..] names.

All loops are possessive, so they run without recursion and texts of any length are
fine.  Parentheses are matched as a pattern of ``DEPTH`` levels, in one pass; rows
that go deeper are found by counting and folded token by token instead.  Comments
in comments are matched to ``COMMENT_DEPTH`` levels.

The functions take and give SQL text (``dialect``: an expression, None for plain SQL):
the expressions are long, and Spark reads them from text in a fraction of the time
that building them column by column from Python takes.  Which grammar a row needs is
a CASE over patterns, so there is one expression for all dialects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ddlscope.functions.text import WHITESPACE

#: Levels of parentheses, and of comments in comments, that a pattern covers.
DEPTH, COMMENT_DEPTH = 16, 48
# a name part, quoted or plain, and a possibly qualified name
PART = r"""(?:"[^"]*+"|`[^`]*+`|\[[^\]]*+\]|\w++)"""
NAME = r"(?:" + PART + r"\s*+\.\s*+)*+" + PART
LAST_PART = r"^(?:" + PART + r"\s*+\.\s*+)*+(" + PART + ")"
PLAIN_NAME = r"^\w++\z"
HAS_QUOTE = r"""['"`$]"""
LONE = r"""['"`$]"""

_MARK = "\u0001"
#: Characters that may open a token, by kind of grammar (inside a character class).
_OPENERS = {"plain": "'\"`$", "backslash": "'\"`$", "escape": "'\"`$Ee", "bracket": "'\"`$\\["}


def _quoted(kind: str, tag: str = "tag") -> str:
    """A quoted token; ``tag`` names the group of a dollar tag, once in a pattern."""
    dollar = rf"\$(?<{tag}>\w*+)\$.*?\$\k<{tag}>\$"
    plain = rf"""'[^']*+'|"[^"]*+"|`[^`]*+`|{dollar}"""
    return {
        "plain": plain,
        "backslash": rf"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|`[^`]*+`|{dollar}""",
        "escape": rf"(?<!\w)[Ee]'(?:[^'\\]++|\\.)*+'|{plain}",
        "bracket": rf"{plain}|\[[^\]]*+\]",
    }[kind]


def _parentheses(kind: str, depth: int = DEPTH) -> str:
    """(..) of at most ``depth`` levels; one that is never closed goes on to the end."""
    inner = "|" + _parentheses(kind, depth - 1) if depth > 1 else ""
    lone = _OPENERS[kind]
    return rf"\((?:{_quoted(kind, f'tag{depth}')}|[{lone}]|[^(){lone}]++{inner})*+(?:\)|\z)"


def _block_comment(depth: int) -> str:
    inner = "|" + _block_comment(depth - 1) if depth > 1 else ""
    return rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*){inner})*+(?:\*/|\z)"


STATEMENT = {k: rf"(?s)(?:{_quoted(k)}|[{o}]|[^;{o}]++)++" for k, o in _OPENERS.items()}
PIECE = {k: rf"(?s)(?:{_quoted(k)}|{_parentheses(k)}|[{o}]|[^,({o}]++)++" for k, o in _OPENERS.items()}
HIDDEN = {k: rf"(?s){_quoted(k)}|{_parentheses(k)}|{LONE}" for k in _OPENERS}
TOKENS = {k: rf"(?s){_quoted(k)}|[{o}]|[(),]|[^(),{o}]++" for k, o in _OPENERS.items()}
#: A line with GO alone, and a number of times.
GO_LINE = r"(?mi:^[ \t]*+GO(?:[ \t]++\d++)?[ \t]*+(?=\r?$))"
GO = {k: rf"(?s)((?:{_quoted(k)})++)|{GO_LINE}" for k in _OPENERS}
#: What stands before the next comment (group 1, taken in runs), and the comment.
COMMENTS = {n: {k: rf"(?s)\G((?:{_quoted(k)}|[^\-/{mark}{o}]++|[{o}]|-(?!-)|/(?!\*))*+)(?:--[^\r\n]*+|{block}{more})" for k, o in _OPENERS.items()}
            for n, block, mark, more in (("plain", r"/\*.*?(?:\*/|\z)", "", ""), ("nested", _block_comment(COMMENT_DEPTH), "", ""),
                                         ("hashes", r"/\*.*?(?:\*/|\z)", "#", r"|#[^\r\n]*+"))}
AFTER_QUOTE = r"""(?<=['"`$\]])"""


def lit(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lstrip(text: str) -> str:
    """Without white space at the start (Java's \\s)."""
    return f"trim(LEADING {lit(WHITESPACE)} FROM {text})"


def strip(text: str) -> str:
    """Without white space at both ends (Java's \\s).

    Spark lists every character of a text before it trims the end, so that is asked for only where there is something to trim.
    """
    ends = " OR ".join(f"endswith({text}, {lit(c)})" for c in WHITESPACE)
    return f"CASE WHEN {ends} THEN trim(BOTH {lit(WHITESPACE)} FROM {text}) ELSE {lstrip(text)} END"


def _is(dialect: str, *names: str) -> str:
    return f"coalesce(lower({dialect}) IN ({', '.join(map(lit, names))}), false)"


def _by_grammar(text: str, dialect: str | None, patterns: dict[str, str], call) -> str:
    """``call`` with the pattern of the grammar that a row needs: special ones only where their characters occur.

    Each pattern has an expression of its own, which compiles it once; one expression that is given
    the pattern of its row compiles anew whenever it differs from the row before.
    """
    if dialect is None:
        return call(lit(patterns["plain"]))
    backslash = f"contains({text}, {lit(chr(92))})"
    special = ((f"{_is(dialect, 'mysql')} AND {backslash}", "backslash"),
               (f"{_is(dialect, 'postgres', 'postgresql')} AND {backslash} AND {text} RLIKE {lit('[Ee]' + chr(39))}", "escape"),
               (f"{_is(dialect, 'tsql', 'mssql', 'sqlite')} AND contains({text}, '[')", "bracket"))
    whens = " ".join(f"WHEN {cond} THEN {call(lit(patterns[kind]))}" for cond, kind in special)
    return f"CASE {whens} ELSE {call(lit(patterns['plain']))} END"


def _rarely(text: str, dialect: str | None, patterns: dict[str, str]) -> str:
    """All matches of the row's pattern, in one expression: for texts that few rows have."""
    return f"regexp_extract_all({text}, {_by_grammar(text, dialect, patterns, str)}, 0)"


def _unmarked(text: str, pattern: str, instead: str) -> str:
    """What ``pattern`` finds besides quoted text (its group 1) replaced by one character.

    Every match leaves a mark; those right behind a closing quote stand for the quoted text itself.
    """
    marked = f"regexp_replace({text}, {pattern}, {lit('$1' + _MARK)})"
    return f"translate(regexp_replace({marked}, {lit(AFTER_QUOTE + _MARK)}, ''), {lit(_MARK)}, {lit(instead)})"


def strip_comments(text: str, dialect: str | None = None) -> str:
    """Line and block comments outside quotes, each replaced by a blank."""
    def bare(kind):
        return _by_grammar(text, dialect, COMMENTS[kind], lambda p: f"regexp_replace({text}, {p}, '$1 ')")

    block = f"contains({text}, '/*')"
    if dialect is None:
        return f"CASE WHEN contains({text}, '--') OR {block} THEN {bare('plain')} ELSE {text} END"
    return (f"CASE WHEN {_is(dialect, 'mysql')} AND contains({text}, '#') THEN {bare('hashes')} "
            f"WHEN {block} AND NOT {_is(dialect, 'mysql', 'sqlite')} THEN {bare('nested')} "
            f"WHEN contains({text}, '--') OR {block} THEN {bare('plain')} ELSE {text} END")


def batch_ends(text: str, dialect: str | None) -> str:
    """T-SQL: a line with GO alone, outside quotes and comments (which are gone by now), becomes a ``;``."""
    if dialect is None:
        return text
    return (f"CASE WHEN {_is(dialect, 'tsql', 'mssql')} AND {text} RLIKE {lit(GO_LINE)} "
            f"THEN {_by_grammar(text, dialect, GO, lambda p: _unmarked(text, p, ';'))} ELSE {text} END")


def statements(text: str, dialect: str | None = None) -> str:
    """Pieces between ``;`` outside quotes, untrimmed."""
    return _by_grammar(text, dialect, STATEMENT, lambda p: f"regexp_extract_all({text}, {p}, 0)")


def _depth(acc: str, t: str) -> str:
    return f"CASE WHEN {t} = '(' THEN {acc} + 1 WHEN {t} = ')' THEN greatest({acc} - 1, 0) ELSE {acc} END"


def _too_deep(text: str, tokens: str) -> str:
    """Do parentheses go deeper than the patterns?  Counted only where there are as many."""
    now = _depth("d.now", "t")
    most = (f"aggregate({tokens}, named_struct('now', 0, 'most', 0), (d, t) -> named_struct('now', {now}, 'most', greatest(d.most, {now})), "
            "d -> d.most)")
    return f"(length({text}) - length(replace({text}, '(', '')) > {DEPTH} AND {most} > {DEPTH})"


def _marked(text: str) -> str:
    return f"(contains({text}, '(') OR {text} RLIKE {lit(HAS_QUOTE)} OR contains({text}, '['))"


def split_top(text: str, dialect: str | None = None) -> str:
    """Trimmed pieces between commas outside quotes and parentheses of any depth."""
    tokens = _rarely(text, dialect, TOKENS)
    found = f"transform({_rarely(text, dialect, PIECE)}, p -> {strip('p')})"
    return (f"CASE WHEN {_marked(text)} THEN CASE WHEN {_too_deep(text, tokens)} THEN {_split_deep(tokens)} ELSE {found} END "
            f"ELSE transform(split({text}, ','), p -> {strip('p')}) END")


def _split_deep(tokens: str) -> str:
    """The same by a fold over tokens: a piece grows until a comma at depth 0."""
    step = (f"named_struct('depth', {_depth('d.depth', 't')}, 'now', CASE WHEN t = ',' AND d.depth = 0 THEN '' ELSE concat(d.now, t) END, "
            "'done', CASE WHEN t = ',' AND d.depth = 0 THEN array_append(d.done, d.now) ELSE d.done END)")
    return (f"transform(aggregate({tokens}, named_struct('depth', 0, 'now', '', 'done', cast(array() AS array<string>)), (d, t) -> {step}, "
            f"d -> array_append(d.done, d.now)), p -> {strip('p')})")


def outside_parentheses(text: str, dialect: str | None = None) -> str:
    """The text with quoted tokens and everything in parentheses blanked out."""
    tokens = _rarely(text, dialect, TOKENS)
    depth = _depth("d.depth", "t")
    shown = f"d.depth = 0 AND ({depth}) = 0 AND NOT (t RLIKE {lit('^' + LONE)})"
    deep = (f"aggregate({tokens}, named_struct('depth', 0, 'kept', ''), (d, t) -> named_struct('depth', {depth}, "
            f"'kept', concat(d.kept, CASE WHEN {shown} THEN t ELSE ' ' END)), d -> d.kept)")
    def hidden(pattern):
        return f"regexp_replace({text}, {pattern}, ' ')"

    return (f"CASE WHEN {_marked(text)} THEN CASE WHEN {_too_deep(text, tokens)} THEN {deep} "
            f"ELSE {_by_grammar(text, dialect, HIDDEN, hidden)} END ELSE {text} END")


def name_sql(token: str) -> str:
    """Last part of a possibly qualified, possibly quoted name at the start of a token; '' if there is none."""
    part = f"regexp_extract({token}, {lit(LAST_PART)}, 1)"
    quotes = lit('"`[')
    return (f"CASE WHEN {token} RLIKE {lit(PLAIN_NAME)} THEN {token} "
            f"WHEN contains({quotes}, substring({part}, 1, 1)) AND {part} <> '' THEN substring({part}, 2, length({part}) - 2) ELSE {part} END")


def name_of(token: Column) -> Column:
    """``name_sql`` of a column."""
    part = F.regexp_extract(token, LAST_PART, 1)
    quoted = part.rlike(r"^[\"`\[]")
    return F.when(quoted, F.substring(part, F.lit(2), F.length(part) - 2)).otherwise(part)
