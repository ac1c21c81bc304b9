"""Problem 7: cutting oversized items at natural boundaries.

Recursive bisection: a text above the limit is cut at the strongest boundary near its midpoint, halves that still
exceed the limit minus the overlap are cut again, and at the end each piece but the first gets the end of the one
before it as overlap.

Defined cases: null and empty texts and texts within the limit give one piece (null text: none); a text without any
boundary is cut in the middle, never between CR and LF or before a combining mark; null start lines give null lines;
repeated rows give their pieces once; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.batches import map_rows

LIMIT, OVERLAP = 6000, 200
_DECLARES = re.compile(r"[ \t]*(?:@|#+ |def |class |async def |function |async function |export |func |type |public |private |protected |static |interface |impl |fn )")
_LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
_SOFT = re.compile(r"(?<=[.!?;。！？；])\s*|(?<=[,，、)\]}])\s*|(?<=\s)(?=\S)|(?<=[^\w\s])(?=\w)")


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions where lines start, and how natural a cut there is: 6 a declaration after a blank line, 5 other text
    after a blank line, 4 a declaration, 3 a line as little indented as its neighbours or less, 2 any line."""
    at, strength = [], []
    blank, last_indent = False, 0
    for m in _LINE.finditer(text):
        line = m.group()
        if not line.strip():
            blank = True
            continue
        indent = len(line) - len(line.lstrip())
        if m.start():
            declares = _DECLARES.match(line) is not None
            at.append(m.start())
            strength.append((6 if declares else 5) if blank else 4 if declares else 3 if indent <= last_indent else 2)
        blank, last_indent = False, indent
    return at, strength


def _inside(text: str, lo: int, hi: int, mid: int) -> int:
    """A cut within a line: after a sentence, then at a comma, a space, a change of kind, else anywhere allowed."""
    reach = max(1, (hi - lo) // 8)
    best = None
    for m in _SOFT.finditer(text, max(lo + 1, mid - reach), min(hi - 1, mid + reach)):
        p = m.end()
        if lo < p < hi:
            before = text[p - 1 : p].isspace() and text[p - 2 : p - 1] or text[p - 1 : p]
            kind = 3 if before in ".!?;。！？；" else 2 if before in ",，、)]}" else 1
            if best is None or (-kind, abs(p - mid), p) < best:
                best = (-kind, abs(p - mid), p)
    p = best[2] if best else mid
    while lo + 1 < p and (text[p - 1] == "\r" and text[p] == "\n" or unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍"):
        p -= 1
    return p


def cuts(text: str, most: int) -> list[int]:
    """Where to cut text so that no part has more than most characters."""
    if most < 1:
        raise ValueError("the limit must exceed the overlap")
    if len(text) <= most:
        return []
    at, strength = boundaries(text)
    found, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        n = hi - lo
        if n <= most:
            continue
        mid, reach = lo + n // 2, n // 4
        a, b = bisect_left(at, max(lo + 1, mid - reach)), bisect_left(at, min(hi, mid + reach + 1))
        if a < b:
            k = min(range(a, b), key=lambda i: (-strength[i], abs(at[i] - mid), at[i]))
            p = at[k]
        else:
            p = _inside(text, lo, hi, mid)
        found.append(p)
        todo += [(lo, p), (p, hi)]
    return sorted(found)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, characters shared with the piece before) of each piece; together they cover text."""
    if len(text) <= limit:
        return [(0, len(text), 0)]
    edges = [0, *cuts(text, limit - overlap), len(text)]
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        start = a
        if i and overlap:
            start = max(edges[i - 1], a - overlap)
            line = text.find("\n", start, a - 1) + 1  # whole lines where one starts within the overlap
            start = line or start
            while start < a and start and (text[start - 1] == "\r" and text[start] == "\n" or unicodedata.combining(text[start])):
                start += 1
        out.append((start, b, a - start))
    return out


def split(df: DataFrame, key: str = "chunk_id", text: str = "code", first_line: str | None = "start_line", limit: int = LIMIT, overlap: int = OVERLAP, keep_small: bool = False) -> DataFrame:
    """(key, piece_no from 1, n_pieces, char_start, char_end, n_shared, start_line, end_line, piece), distinct.

    Only rows above the limit reach Python unless keep_small; the length test runs in the scan's stage.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k_"), F.col(text).alias("t_"), (F.col(first_line).cast("int") if first_line else F.lit(1)).alias("l_"))
    rows = rows.where("t_ is not null" if keep_small else F.length("t_") > limit)

    def make():
        def call(k, t, line):
            parts = pieces(t, limit, overlap)
            seen, counted = 0, 0
            for i, (a, b, shared) in enumerate(parts):
                counted += t.count("\n", seen, a)
                seen = a
                first = None if line is None else line + counted
                last = None if line is None else first + t.count("\n", a, max(a, b - 1))
                yield k, i + 1, len(parts), a, b, shared, first, last, t[a:b]

        return call

    out = map_rows(rows, f"`{key}` {kind}, piece_no int, n_pieces int, char_start int, char_end int, n_shared int, start_line int, end_line int, piece string", make)
    return out.dropDuplicates([key, "piece_no", "n_pieces", "char_start", "start_line", "piece"])
