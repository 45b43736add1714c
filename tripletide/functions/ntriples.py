"""Column expressions that take an N-Triples line apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of a line in the N-Triples grammar.
# Possessive runs keep the matcher's stack flat on long terms.
_IRI = r"[^<>\"{}|^`\\\x00-\x20]*+(?:\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})[^<>\"{}|^`\\\x00-\x20]*+)*+"
_RESOURCE = rf"(?:<({_IRI})>|(_:[^\s<>\"]+))"
_LITERAL = r'"([^"\\\n\r]*+(?:\\.[^"\\\n\r]*+)*+)"(?:\^\^<([^<>\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?'
LINE = rf"^\s*{_RESOURCE}\s*<({_IRI})>\s*(?:{_RESOURCE}|{_LITERAL})\s*\.\s*(?:#.*)?$"


def is_statement(line: Column) -> Column:
    return line.rlike(LINE)


def is_blank(line: Column) -> Column:
    """Lines that state nothing by the grammar: empty ones and remarks."""
    return line.rlike(r"^\s*(?:#.*)?$")


def line_parts(line: Column) -> Column:
    """The eight parts of a statement by one match of the grammar; another number of them if the line is none.

    A line holds no line feed, so one can stand between the parts.
    """
    return F.split(F.regexp_replace(line, LINE, "\n".join(f"${i}" for i in range(1, 9))), "\n")


def all_parts(parts: Column) -> Column:
    return F.size(parts) == 8


def unescape(text: Column) -> Column:
    r"""Decodes ``\n \t \" \\``, ``\uXXXX`` and ``\UXXXXXXXX`` by reading the text as a JSON string."""
    # JSON has no long form: up to U+FFFF it becomes the short one, above it the character itself
    tokens = F.regexp_extract_all(text, F.lit(r"\\U[0-9A-Fa-f]{8}|\\.|[^\\]++"), F.lit(0))
    digits = lambda t: F.substr(t, F.lit(3), F.lit(8))
    short = F.transform(tokens, lambda t: F.when(
        t.startswith("\\U0000"), F.concat(F.lit("\\u"), F.substr(t, F.lit(7), F.lit(4)))
    ).when(t.startswith("\\U"), F.decode(F.unhex(digits(t)), "UTF-32")).otherwise(t))
    text = F.when(text.contains("\\U"), F.array_join(short, "")).otherwise(text)
    body = F.replace(text, F.lit("\\'"), F.lit("'"))
    decoded = F.get_json_object(F.concat(F.lit('{"v":"'), body, F.lit('"}')), "$.v")
    return F.when(text.contains("\\"), F.coalesce(decoded, text)).otherwise(text)


def strict_terms(parts: Column) -> list[Column]:
    """s, p, o, o_kind, o_datatype, o_lang from the parts of a line."""
    part = [F.get(parts, F.lit(i)) for i in range(8)]
    resource = F.concat(unescape(part[3]), part[4])
    is_resource = resource != ""
    return [
        F.concat(unescape(part[0]), part[1]).alias("s"),
        unescape(part[2]).alias("p"),
        F.when(is_resource, resource).otherwise(unescape(part[5])).alias("o"),
        F.when(is_resource, "iri").otherwise("lit").alias("o_kind"),
        F.nullif(part[6], F.lit("")).alias("o_datatype"),
        F.nullif(part[7], F.lit("")).alias("o_lang"),
    ]


def compat_terms(line: Column) -> list[Column]:
    """s, p, o, o_kind by the simple rule: no angle brackets, words split at single spaces.

    A third word with ``http`` in it is an IRI as it stands; any other loses its
    first and last character and is a literal.
    """
    words = F.split(F.regexp_replace(line, "[<>]", ""), " ")
    third = F.get(words, F.lit(2))
    is_iri = third.contains("http")
    return [
        F.get(words, F.lit(0)).alias("s"),
        F.get(words, F.lit(1)).alias("p"),
        F.when(is_iri, third).otherwise(F.substr(third, F.lit(2), F.greatest(F.length(third) - 2, F.lit(0)))).alias("o"),
        F.when(is_iri, "iri").otherwise("lit").alias("o_kind"),
    ]
