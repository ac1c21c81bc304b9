"""Column expressions on paths, names and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that count as source, and the languages they stand for.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust",
    "rb": "ruby", "php": "php", "c": "c", "cpp": "cpp", "cs": "csharp", "kt": "kotlin",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """Language by extension; '' for what isn't source."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(names[extension(path)], F.lit(""))


def clean_path(path: Column) -> Column:
    """One spelling of a path: forward slashes, no leading ./ or /."""
    return F.regexp_replace(F.regexp_replace(path, r"\\+", "/"), r"^(?:\./|/)+", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[A-Za-z0-9]+$", "")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def lines(text: Column) -> Column:
    """Lines without the carriage returns of CRLF."""
    return F.split(F.regexp_replace(text, "\r", ""), "\n", -1)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2"))


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info and unknown ones."""
    s = F.lower(severity)
    return F.when(s == "critical", 0).when(s == "high", 1).when(s == "medium", 2).when(s == "low", 3).otherwise(4)
