"""Version comparison as column expressions: releases as arrays of integers, pre-releases before their release."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RELEASE = r"^[vV=\s]*(\d+(?:\.\d+)*)"
_PRE = r"(?i)^[vV=\s]*\d+(?:\.\d+)*[-.]?(?:a|b|c|rc|alpha|beta|pre|preview|dev)[-.]?\d*"


def key(version: Column) -> Column:
    """A sortable array: six release parts, then 0 for a pre-release and 1 for a release. Null where unparsable."""
    release = F.regexp_extract(version, _RELEASE, 1)
    parts = F.transform(F.split(release, r"\."), lambda x: x.cast("long"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("long"), 6)), 1, 6)
    return F.when(release != "", F.concat(padded, F.array(F.when(version.rlike(_PRE), 0).otherwise(1).cast("long"))))


def satisfies(version: Column, operator: Column, bound: Column) -> Column:
    """Whether a version meets one bound; unknown operators, unparsable versions and 'latest' never do."""
    v, b = key(version), key(bound)
    met = F.when(operator == "<", v < b).when(operator == "<=", v <= b).when(operator == ">", v > b).when(operator == ">=", v >= b).when(operator.isin("==", "="), v == b).when(operator == "!=", v != b)
    return F.coalesce(met, F.lit(False)) & (F.lower(version) != "latest")


def in_range(version: Column, text: Column) -> Column:
    """Whether a version meets all bounds of a range such as '>=1.2,<2'. An empty range is met by none."""
    bounds = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    each = F.transform(bounds, lambda x: satisfies(version, F.regexp_extract(x, r"^([<>=!]=?)", 1), F.trim(F.regexp_replace(x, r"^[<>=!]+", ""))))
    return (F.size(bounds) > 0) & F.forall(each, lambda x: x)
