"""Reading SQL out of responses and checking it against an allow-list of relations.

Everything is a column expression: literals are masked, argument lists without a
query are removed inside out, and what follows FROM and JOIN is read off.  Nothing
leaves the JVM, so texts of any length are judged in the scan.

Defined results: a null or blank response is ``empty``; a null statement is
``invalid_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The analytical relations a statement may read.
RELATIONS = (
    "block_facts", "contract_dimension", "entity_labels_v1", "labeled_token_transfers", "labeled_transactions", "token_dimension",
    "token_transfer_facts", "transaction_facts",
)
# Leading keywords of statements that change something.
CHANGING = ("ALTER", "CALL", "CREATE", "DELETE", "DROP", "EXECUTE", "INSERT", "MERGE", "TRUNCATE", "UPDATE")
#: Levels of nested argument lists that are removed; deeper nesting is invalid.
DEEPEST = 12

_FENCED = r"(?is)\A```(?:sql|googlesql)?[ \t]*\n(.*)\n```[ \t]*\z"
# Possessive groups: they are matched in a loop, so long literals cost no stack.  A literal
# that stays open runs to the end, so it's read once; one quote remains of it.
_LITERAL = r"""(?s)'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+('|\z)|"[^"\\]*+(?:\\.[^"\\]*+)*+("|\z)"""
_BLANKS = " \t\n\r\x0b\x0c"
_CLAUSE_END = r"where|group|order|limit|having|qualify|window|union|intersect|except|join|left|right|full|inner|cross|on|using|from|select"
_STAR = r"(?s)(?:\bselect\s+(?:all\s+|distinct\s+)?|,\s*)(?:[\w`]+\.)*\*\s*(?:,|\bfrom\b|\bexcept\b|\breplace\b|\)|\z)"


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _bare(name: Column) -> Column:
    return F.replace(name, F.lit("`"), F.lit(""))


def with_relations(statements: DataFrame, column: str = "sql") -> DataFrame:
    """Appends ``masked`` (every string literal as ``''``, lower case) and ``read``:
    the relations a statement reads, as written, lower case, without backticks;
    names of its own WITH clauses are left out."""
    marked = statements.withColumn("masked", F.lower(F.replace(F.regexp_replace(F.col(column), _LITERAL, "'$1$2"), F.lit("'\""), F.lit("''"))))
    plain = F.col("masked")
    for _ in range(DEEPEST):  # innermost parentheses without a query, removed again and again
        plain = F.regexp_replace(plain, r"(?s)\((?![^()]*\bselect\b)[^()]*\)", " ")
    lists = F.regexp_extract_all("plain", F.lit(rf"(?s)\b(?:from|join)\s+((?:(?!\b(?:{_CLAUSE_END})\b)[^()])*+)"), F.lit(1))
    names = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: _bare(F.regexp_extract(x, r"^\s*(`[^`]*`|[\w.\-]+)", 1)))
    own = F.transform(F.regexp_extract_all("masked", F.lit(r"(?s)(?:\bwith\s+(?:recursive\s+)?|,\s*)(`?\w+`?)\s+as\s*\("), F.lit(1)), _bare)
    return marked.withColumn("plain", plain).withColumn("read", F.array_except(F.array_remove(names, ""), own)).drop("plain")


def with_faults(statements: DataFrame, column: str = "sql", allowed: tuple[str, ...] = RELATIONS) -> DataFrame:
    """Appends ``faults``: what is wrong with a statement, in order: ``invalid_sql``
    (quotes or parentheses stay open), ``comment``, ``semicolon``, ``not_a_query``,
    ``wildcard``, ``foreign_relation``, ``no_relation``; empty for a safe one."""
    read = with_relations(statements, column).withColumn("names", F.transform("read", lambda x: F.element_at(F.split(x, r"\."), -1)))
    count = lambda pattern: F.length(F.regexp_replace("masked", pattern, ""))
    opened, closed, ticks = count("[^(]"), count("[^)]"), count("[^`]")
    quotes = F.length(F.regexp_replace(F.replace(F.col("masked"), F.lit("''"), F.lit("")), "[^'\"]", ""))
    invalid = F.col(column).isNull() | (F.trim(column) == "") | (opened != closed) | (quotes > 0) | (ticks % 2 == 1)
    text = F.col("masked")
    some = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    faults = F.array_compact(
        F.array(
            some(invalid, "invalid_sql"), some(text.rlike(r"--|/\*|#"), "comment"), some(text.contains(";"), "semicolon"),
            some(~text.rlike(r"(?s)\A\s*(?:select|with|\()"), "not_a_query"), some(text.rlike(_STAR), "wildcard"),
            some(F.size(F.array_except("names", F.array(*map(F.lit, allowed)))) > 0, "foreign_relation"), some(F.size("names") == 0, "no_relation"),
        )
    )
    return read.withColumn("faults", faults).drop("masked", "names", "read")


def extracted_statement(response: Column) -> Column:
    """The one statement a response consists of, bare or in one fence; null where
    it holds anything else."""
    text = _stripped(F.regexp_replace(response, "\r\n?", "\n"))
    inner = F.when(text.rlike(_FENCED), _stripped(F.regexp_extract(text, _FENCED, 1))).when(~text.contains("```"), text)
    return F.when(inner.rlike(r"(?i)\A(?:select|with)\b"), inner)


def response_kind(response: Column) -> Column:
    """``empty``, ``prose``, ``unsafe_sql`` (a changing statement leads) or
    ``query``, by fences and the leading keyword alone."""
    text = _stripped(F.regexp_replace(response, "\r\n?", "\n"))
    fenced = text.rlike(_FENCED)
    inner = F.when(fenced, _stripped(F.regexp_extract(text, _FENCED, 1))).otherwise(text)
    word = F.upper(F.regexp_extract(inner, r"\A([A-Za-z]+)\b", 1))
    return (
        F.when(response.isNull() | (inner == ""), "empty")
        .when(~fenced & text.contains("```"), "prose")
        .when(word.isin(*CHANGING), "unsafe_sql")
        .when(word.isin("SELECT", "WITH"), "query")
        .otherwise("prose")
    )


def extraction_status(responses: DataFrame, allowed: tuple[str, ...] = RELATIONS) -> DataFrame:
    """Input (key, response); output (key, status, faults, statement): status is
    ``ok``, ``empty``, ``prose``, ``invalid_sql`` or ``unsafe_sql``; the statement is
    given where it is ok."""
    read = responses.select("key", response_kind(F.col("response")).alias("kind"), extracted_statement(F.col("response")).alias("sql"))
    judged = with_faults(read, "sql", allowed)
    status = (
        F.when(F.col("kind") != "query", F.col("kind"))
        .when(F.array_contains("faults", "invalid_sql"), "invalid_sql")
        .when(F.size("faults") > 0, "unsafe_sql")
        .otherwise("ok")
    )
    shown = F.when(F.col("kind") == "query", F.col("faults")).otherwise(F.array().cast("array<string>"))
    return judged.withColumn("status", status).select("key", "status", shown.alias("faults"), F.when(F.col("status") == "ok", F.col("sql")).alias("statement"))


def structure(sql: Column) -> Column:
    """A statement without layout, letter case, backticks, semicolons and the blanks
    around punctuation; literals keep their value.  Equal structures are a
    structural match."""
    # letter case is kept inside of literals: cut at quotes, every other piece is one
    pieces = F.split(F.regexp_replace(sql, r"[`;]", ""), "'")
    lowered = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", " "), r"\s*([(),=<>+*/-])\s*", "$1")).otherwise(x))
    return F.trim(F.array_join(lowered, "'"))
