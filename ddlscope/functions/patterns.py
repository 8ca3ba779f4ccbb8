"""Lexical patterns (Java regex) for DDL statements and logged queries.

All patterns are applied with native ``rlike`` / ``regexp_extract`` /
``regexp_extract_all`` so the work stays inside whole-stage codegen.
Identifiers are ASCII ``\\w``.  Unsupported syntax falls through to
``UNKNOWN`` (for CREATE/ALTER/DROP) or is skipped (anything else).
"""

from __future__ import annotations

from ddlscope.functions.lexer import NAME

# DDL classes are decided on the leading words of a statement (see
# operators/extract.py), first match wins:
#   ALTER TABLE [IF EXISTS] [ONLY] t  DROP FOREIGN KEY .. -> DROP_FOREIGN_KEY
#                                     DROP CONSTRAINT|PRIMARY .. -> DROP_CONSTRAINT
#                                     DROP INDEX|KEY i -> DROP_INDEX
#                                     DROP [COLUMN] [IF EXISTS] c -> DROP_COLUMN
#                                     RENAME TO t2 -> RENAME_TABLE
#                                     RENAME [COLUMN] c TO .. -> RENAME_COLUMN
#                                     ALTER|MODIFY|CHANGE [COLUMN] c -> ALTER_COLUMN
#                                     ADD [CONSTRAINT n] FOREIGN KEY -> ADD_FOREIGN_KEY
#                                     ADD CONSTRAINT|PRIMARY|UNIQUE|CHECK|EXCLUDE -> ADD_CONSTRAINT
#                                     ADD INDEX|KEY|FULLTEXT|SPATIAL -> UNKNOWN
#                                     ADD [COLUMN] [IF NOT EXISTS] c -> ADD_COLUMN
#                                     anything else -> UNKNOWN
#   CREATE [modifiers] TABLE [IF NOT EXISTS] t -> CREATE_TABLE
#   CREATE [UNIQUE] INDEX [CONCURRENTLY] [IF NOT EXISTS] [i] ON [ONLY] t -> CREATE_INDEX
#   CREATE [OR REPLACE] [TEMP|MATERIALIZED] VIEW v -> CREATE_VIEW
#   DROP [MATERIALIZED] TABLE|INDEX|VIEW [CONCURRENTLY] [IF EXISTS] n [ON t] -> DROP_*
#   TRUNCATE [TABLE] [ONLY] t -> TRUNCATE_TABLE
#   RENAME TABLE t TO t2 -> RENAME_TABLE
# DROP TABLE|VIEW|INDEX, TRUNCATE and RENAME TABLE take a list of names: one operation each.
#   other CREATE / ALTER / DROP -> UNKNOWN (object name as table); anything else is skipped.

# Statement, action and comment splitting: functions/lexer.py.
# The list of names of a TRUNCATE, DROP or RENAME TABLE statement.
TABLE_LIST = (r"(?is)^\s*(?:TRUNCATE\s+(?:TABLE\s+)?(?:ONLY\s+)?|RENAME\s+TABLE\s+|DROP\s+(?:MATERIALIZED\s+|TEMP(?:ORARY)?\s+)?"
              r"(?:TABLE|VIEW|INDEX)\s+(?:CONCURRENTLY\s+)?(?:IF\s+EXISTS\s+)?)(.*)$")
# The table of one index in such a list.
INDEX_OWNER = r"(?i)\sON\s+(" + NAME + ")"
# Compound ALTER TABLE: prefix (group 1) and action list (group 2).
ALTER_PREFIX = r"(?is)^\s*(ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?" + NAME + r"\s+)(.*)$"
# ADD (a INT, b INT): the definitions in the parentheses.
ADD_LIST = r"(?is)^ADD\s*(?:COLUMNS?\s*)?\((.*)\)\s*$"
HAS_ADD_LIST = r"(?i)\bADD\s*(?:COLUMNS?\s*)?\("
# A statement whose names hold blanks, parentheses or marks inside quotes.
SPACED_NAME = r"""["`\[][^"`\]]*[^\w."`\]]"""
# Leading words of such a statement: names with their quotes, and single parentheses.
SPACED_TOKEN = r"""(?:"[^"]*+"|`[^`]*+`|\[[^\]]*+\]|[^\s("`\[]++|[\["`])++|\("""

NOT_NULL = r"(?is)\bNOT\s+NULL\b"
DEFAULT = r"(?is)\bDEFAULT\b"

# ---- query logs ----------------------------------------------------------
VERBS = "SELECT|INSERT|UPDATE|DELETE|WITH"
# a line starting with a verb that later reaches ';' (multi-line, dot-all)
TERMINATED_PROBE = r"(?im)^(?:" + VERBS + r")\b[^;]*+;"
TERMINATED_QUERY = r"(?i)(?:" + VERBS + r")\b[^;]*+;"
LINE_QUERY = r"(?i)^\s*(?:" + VERBS + r")\b"
# line ends besides a newline; LINE_SPLIT cuts at all of them
OTHER_LINE_END = r"[\r\x0B\f\x1c\x1d\x1e\u0085\u2028\u2029]"
LINE_SPLIT = r"\r\n|[\n\r\x0B\f\x1c\x1d\x1e\u0085\u2028\u2029]"

# words that are never column names in the logged queries
SQL_KEYWORDS = [
    "ALL", "AND", "ANY", "AS", "ASC", "BETWEEN", "BY", "CASE", "CROSS", "DELETE",
    "DESC", "DISTINCT", "ELSE", "END", "EXISTS", "FALSE", "FETCH", "FIRST", "FOR",
    "FROM", "FULL", "GROUP", "HAVING", "ILIKE", "IN", "INNER", "INSERT", "INTERVAL",
    "INTO", "IS", "JOIN", "LEFT", "LIKE", "LIMIT", "NATURAL", "NEXT", "NOT", "NULL",
    "NULLS", "OFFSET", "ON", "ONLY", "OR", "ORDER", "OUTER", "OVER", "PARTITION",
    "RETURNING", "RIGHT", "ROW", "ROWS", "SELECT", "SET", "THEN", "TRUE", "UNION",
    "UPDATE", "USING", "VALUES", "WHEN", "WHERE", "WITH",
]
KEYWORDS = "|".join(SQL_KEYWORDS)

# ---- query references ------------------------------------------------------
STRING_LITERAL = r"'[^']*+'"
# "users", `users` and [users] are the plain name; names with blanks or marks, or that are keywords, stay quoted
QUOTED_NAME = rf"""(?i)["`](?!(?:{KEYWORDS})["`])([A-Za-z_]\w*)["`]|\[(?!(?:{KEYWORDS})\])([A-Za-z_]\w*)\]"""
NAME_QUOTES = r"""^["`\[]|["`\]]$"""
# FROM inside a call or a comparison names no table
EXTRACT_FROM = r"(?i)\bEXTRACT\s*\(\s*\w+\s+FROM\b"
CALL_FROM = r"(?i)\b((?:SUBSTRING|TRIM|OVERLAY)\s*\([^()]*?)\bFROM\b"
DISTINCT_FROM = r"(?i)\bIS\s+(?:NOT\s+)?DISTINCT\s+FROM\b"
# USING in a call names a character set; what follows a locking clause or ON DUPLICATE KEY UPDATE is no table
CALL_USING = r"(?i)\b(CONVERT\s*\([^()]*?)\bUSING\s+\w+"
LOCKING = (r"(?i)\bFOR\s+(?:NO\s+KEY\s+|KEY\s+)?(?:UPDATE|SHARE)\b(?:\s+OF\s+[\w.]+(?:\s*,\s*[\w.]+)*)?"
           r"(?:\s+(?:NOWAIT|SKIP\s+LOCKED)\b)?")
DUPLICATE_KEY = r"(?i)\bON\s+DUPLICATE\s+KEY\s+UPDATE\b"
CAST_TYPE = r"::\s*\w+"
_PLAIN_WORD = r"[A-Za-z_]\w*"
_QUOTED_WORD = r"""\"[^\"]++\"|`[^`]++`|\[[A-Za-z_][^\]]*+\]"""
WORD = rf"(?:{_PLAIN_WORD}|{_QUOTED_WORD})"
_ITEM = rf"(?:{WORD}\s*\.\s*)*{WORD}(?:\s+(?:AS\s+)?(?!(?:{KEYWORDS})\b){WORD})?"
LIST_ITEM = rf"(?i){_ITEM}"
# tables after FROM, JOIN, UPDATE, INTO or USING: possibly qualified, with aliases, in a comma list
# (what a match can begin with is looked at first: most characters begin none)
TABLE_LIST_REF = (rf"(?i)(?=[FJUI])\b(?:FROM|JOIN|UPDATE|INTO|USING)\s+(?:(?:ONLY|LATERAL)\s+)?(?!(?:{KEYWORDS})\b)"
                  rf"({_ITEM}(?:\s*,\s*{_ITEM})*)")
ITEM_TABLE = rf"^(?:{WORD}\s*\.\s*)*({WORD})"
ITEM_ALIAS = rf"(?i)\s(?:AS\s+)?({WORD})$"
SUBQUERY_ALIAS = rf"(?i)\)\s*(?:AS\s+)?({WORD})"
QUALIFIED_REF = rf"""(?=[A-Za-z_"`\[])(?<!\w){WORD}(?:\.{WORD})+(?!\w)"""
COLUMN_ALIAS = rf"(?i)\bAS\s+({WORD})"
FUNCTION_CALL = r"\b[A-Za-z_]\w*\s*\("
IDENTIFIER = rf"""(?=[A-Za-z_"`\[])(\b{_PLAIN_WORD}\b|{_QUOTED_WORD})"""
