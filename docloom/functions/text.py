"""Text cleaning and tests as columns. Patterns keep the meaning they have in Python: (?U) for Unicode classes, (?d) so
that only a line feed ends a line."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Single characters that extraction leaves behind, and what they stand for ('' removes).
QUOTES_SINGLE, QUOTES_DOUBLE, DASHES, REMOVED = "‘’‚‛", "“”„‟", "–—−", "­"

# Signs that section numbering survived the extraction.
SECTION_SIGNS = [
    r"(?i)\bArticle\s+\d+", r"(?i)\bRecital\s+\(?\d+\)?", r"(?i)\bRG\s?\d{1,4}\.\d+", r"\bs\.\s?\d+(\(\w+\))*", r"(?i)\bSection\s+\d+", r"(?i)\bClause\s+\d+",
    r"(?m)^\s*\d+\.\d+\s", r"(?m)^\s*\(\d+\)\s", r"(?m)^\s*\d+\.\s", r"(?i)\b[A-Z]ART\s+[IVX]+",
]

# A line that is only a page number; characters that speak of a broken extraction.
PAGE_NUMBER_LINE = r"(?imUd)^\s*(?:page\s+)?\d{1,4}(?:\s*/\s*\d{1,4}|\s+of\s+\d{1,4})?\s*$"
SUSPICIOUS = "[�\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"


def strip(column: Column | str) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+\z", "")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def plain_signs(column: Column | str) -> Column:
    """Typographic quotes and dashes as ASCII, soft hyphens gone."""
    source = QUOTES_SINGLE + QUOTES_DOUBLE + DASHES + REMOVED
    target = "'" * len(QUOTES_SINGLE) + '"' * len(QUOTES_DOUBLE) + "-" * len(DASHES)
    return F.translate(column, source, target)


def squeeze_space(column: Column | str) -> Column:
    """Runs of blanks and tabs as one blank, three or more line feeds as two, no space at line ends or around the text."""
    text = F.regexp_replace(F.regexp_replace(column, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, r"(?mUd)[\s&&[^\n]]+$", ""))


def drop_page_numbers(column: Column | str) -> Column:
    return F.regexp_replace(column, PAGE_NUMBER_LINE, "")


def lines_of(column: Column | str) -> Column:
    return F.split(column, "\n", -1)


def edge_lines(column: Column | str, n: int = 3, shortest: int = 3, longest: int = 120) -> Column:
    """The first n and the last n non-blank lines, stripped, of 3 to 120 characters; on a short page some count twice."""
    full = F.filter(F.transform(lines_of(column), lambda x: strip(x)), lambda x: x != "")
    size = F.size(full)
    both = F.concat(F.slice(full, 1, n), F.when(size > 0, F.slice(full, F.greatest(size - n + 1, F.lit(1)), n)).otherwise(F.array().cast("array<string>")))
    return F.filter(both, lambda x: (F.length(x) >= shortest) & (F.length(x) <= longest))


def without_lines(column: Column | str, drop: Column) -> Column:
    """The text without the lines whose stripped form is in the array `drop`."""
    return F.array_join(F.filter(lines_of(column), lambda x: ~F.array_contains(drop, strip(x))), "\n")


def has_section_sign(column: Column | str) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    test = text.rlike("(?Ud)" + SECTION_SIGNS[0])
    for pattern in SECTION_SIGNS[1:]:
        test = test | text.rlike("(?Ud)" + pattern)
    return test


def suspicious_chars(column: Column | str) -> Column:
    return F.regexp_count(column, F.lit(SUSPICIOUS))


def safe_name(column: Column | str) -> Column:
    """A file name's stem with everything but letters, digits, dot, underscore and hyphen as one underscore."""
    return F.regexp_replace(F.regexp_replace(column, r"\.[^./]*$", ""), r"[^A-Za-z0-9._-]+", "_")


def path_parts(column: Column | str) -> tuple[Column, Column]:
    """(jurisdiction, issuing body): the first two parts of a path below the corpus root."""
    parts = F.split(column, "/")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def percent(column: Column) -> Column:
    """A share as whole per cent, half to even."""
    return F.concat(F.bround(column * 100, 0).cast("int").cast("string"), F.lit("%"))


def sentence_count(column: Column | str) -> Column:
    """Sentences by paragraph breaks and by ends followed by a capital or a bracket."""
    paragraphs = F.filter(F.transform(F.split(column, r"\n{2,}"), lambda p: strip(p)), lambda p: p != "")
    ends = F.transform(paragraphs, lambda p: F.regexp_count(p, F.lit(r"[.!?]\s+(?=[A-Z(])")) + 1)
    return F.aggregate(ends, F.lit(0), lambda a, x: a + x)


def config_hash(columns: list[str], digits: int = 12) -> Column:
    """A fingerprint of columns by their JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, digits)
