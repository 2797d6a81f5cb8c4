"""Text functions as built-in expressions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word token: letters and digits of any script.
WORD = "[\\p{L}\\p{N}]+"
LABEL_PREFIX = "__label__"


def words(text: Column) -> Column:
    """Lower-cased word tokens in order. Null gives null, a text without a word gives an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalize_line(text: Column) -> Column:
    """The text on one line: line breaks become the mark ``<new_line>``, white space one space, ends are cut, case
    is lowered. The white space of Unicode counts."""
    marked = F.regexp_replace(text, "\r?\n", " <NEW_LINE> ")
    return F.lower(F.trim(F.regexp_replace(marked, "(?U)\\s+", " ")))


def byte_length(text: Column) -> Column:
    """Length in UTF-8 bytes."""
    return F.octet_length(text)


def parse_label(label: Column) -> Column:
    """Integer of ``__label__7``; null for anything else."""
    return F.when(label.startswith(LABEL_PREFIX), F.substring(label, len(LABEL_PREFIX) + 1, 20).try_cast("int"))


def label_line(label: Column, text: Column) -> Column:
    """A line of a label file: the marked label, a space, the normalised text."""
    return F.concat(F.lit(LABEL_PREFIX), label.cast("string"), F.lit(" "), normalize_line(text))


def with_prefix(text: Column, is_query: bool) -> Column:
    """What a retrieval teacher reads: queries are marked, passages aren't."""
    return F.concat(F.lit("query: " if is_query else ""), text)


def truncate(tokens: Column, most: int) -> Column:
    return F.slice(tokens, 1, most)


def limit_from_path(path: Column) -> Column:
    """Quantisation limit in a directory name such as ``codes_scale_0dot3``; null if there is none."""
    digits = F.regexp_extract(path, "scale_([0-9]+(?:dot[0-9]+)?)", 1)
    return F.regexp_replace(digits, "dot", ".").try_cast("double")
