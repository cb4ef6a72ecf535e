"""Text functions on columns: cleaning of model output, extraction of SQL, counts of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters but for tab, line feed and carriage return.
CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Trimmed, with every run of space one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_ansi(c: Column) -> Column:
    """Without terminal colour codes."""
    return F.regexp_replace(c, "\x1b\\[[0-9;]*m", "")


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def without_end(c: Column) -> Column:
    """Without semicolons and space at the end."""
    return stripped(F.regexp_replace(stripped(c), r"[;\s]+$", ""))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def occurrences(c: Column, word: str) -> Column:
    """How often word stands in c, overlaps apart."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def clean_code(c: Column) -> Column:
    """Code of a model's answer: the body of the first fence if there is one, else the text without fences; no colour codes or control characters."""
    body = F.coalesce(found(c, r"(?is)```(?:python|py)?\s*(.*?)\s*```"), F.regexp_replace(c, r"(?i)```(?:python\s*)?", ""))
    return stripped(without_controls(without_ansi(body)))


def extract_sql(c: Column) -> Column:
    """The query in a model's answer to a prompt that ends in SELECT: the body of the first fence if there is one, else the
    text. What starts with neither SELECT nor WITH is the rest of a SELECT, unless it starts like another statement: then null."""
    body = without_end(F.coalesce(found(c, r"(?is)```(?:\w+\s+)?(.*?)\s*```"), F.regexp_replace(c, "```", "")))
    other = body.rlike(r"(?i)^(insert|update|delete|drop|alter|create|attach|pragma|replace|truncate|merge|grant|set|use|call|refresh|cache|load|add)\b")
    return F.when(body == "", F.lit(None)).when(body.rlike(r"(?i)^(select|with)\b"), body).when(other, F.lit(None)).otherwise(F.concat(F.lit("SELECT "), body))


#: Where a query starts: SELECT, or WITH and the name of a common table expression.
START = r"(?:select|with\s+(?:recursive\s+)?\w+\s*(?:\([^)]*\)\s*)?as\s*\()"
#: A SELECT that a prompt ended in and prose went on from: no FROM, bracket or set operator before the next SELECT.
LEADING = r"(?is)^select\b(?:(?!\b(?:from|select|union|intersect|except)\b|\().)*(?=\bselect\b)"


def query_from(c: Column) -> Column:
    """c from the first place on where a query starts; empty if none does."""
    return F.regexp_extract(c, rf"(?is)\b({START}.*)", 1)


def extract_batch_sql(c: Column) -> Column:
    """The query in a line of raw output, in one line: of the first fenced part that has a query; else the line's own, if it
    starts with one; else the first one in its prose, up to the end of that sentence. Where there is none the line is the rest
    of a SELECT."""
    parts = F.split(stripped(c), "```")
    fenced = F.filter(F.transform(F.filter(parts, lambda x, i: i % 2 == 1), query_from), lambda x: x != "")
    line = F.regexp_replace(F.array_join(parts, " "), LEADING, "")
    prose = F.regexp_replace(query_from(line), r"(?s)\.(?:\s.*)?$", "")
    own = F.when(line.rlike(rf"(?is)^{START}"), line).when(prose.rlike(r"(?i)\bfrom\b"), prose)
    return squeezed(without_end(F.coalesce(F.try_element_at(fenced, F.lit(1)), own, F.concat(F.lit("SELECT "), line))))


def is_query_shaped(c: Column) -> Column:
    """Starts with SELECT and has a FROM."""
    return F.upper(c).startswith("SELECT ") & F.contains(F.upper(c), F.lit("FROM"))


#: Where model servers put the text of an answer.
ANSWER_PATHS = ("response", "message.content", "choices[0].message.content", "choices[0].text", "choices[0].content")


def response_text(c: Column) -> Column:
    """The text of a model server's JSON answer (ANSWER_PATHS). Of several JSON lines the last with text counts; what is no JSON is the text itself."""
    lines = F.filter(F.split(stripped(c), r"\R"), lambda line: line != "")
    of = lambda line: F.coalesce(*(F.nullif(F.get_json_object(line, f"$.{path}"), F.lit("")) for path in ANSWER_PATHS))
    texts = F.array_compact(F.transform(F.concat(F.array(stripped(c)), lines), of))
    is_json = F.exists(lines, lambda line: F.get_json_object(line, "$").isNotNull())
    return F.coalesce(F.try_element_at(texts, F.lit(-1)), F.when(is_json, F.lit("")), stripped(c))
