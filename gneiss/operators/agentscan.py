"""The agent rules in their context: what surrounds a hit drops it, lowers it, or confirms it.

One pass over the lines of a file, which stand in one row: lines that are no code are left out, each hit meets the tests of
its rule, and what is left of a line counts once per category, with the most severe hit. Every hit comes out with its fate, so that
what was dropped, and why, can be counted. Names are followed to what they were given (`Names`) within the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.operators.lines import AGENT, Rule

RANK = ("blocker", "critical", "high", "medium", "low", "info")
#: The category of each rule; one finding per line and category is kept.
CATEGORY = {
    "prompt": ("01", "02"), "context": ("03", "04", "05", "12"), "tool": ("06", "07", "08", "09", "LMEXEC"), "budget": ("10", "11", "26", "70"), "leaving": ("13", "14", "15", "LEAK"), "personal": ("18", "19", "20", "21"),
    "settings": ("22", "24", "25", "AUTH", "SECRET", "SANDBOX", "43", "44"), "autonomy": ("16", "17"), "address": ("SSRF", "56", "57", "64"), "path": ("PT", "34", "63"), "data": ("23", "54", "58", "59", "62", "DESER"), "leak": ("51", "52", "69"),
}
_CATEGORY = {f"AGENT-SEC-{n}": c for c, ns in CATEGORY.items() for n in ns}

_COMMENT = re.compile(r"#|//|/?\*")
_LOGGED = re.compile(r"(?:self\.)?_?(?:log|logger|logging|console)\.\w+\(")
_REPORTED = re.compile(r"(?:lines|report|out|rows|md)\.(?:append|extend|write)\(\s*f?[\"'](?:#|\||-|\*|$)")
_SPEAKS = re.compile(r"(?:(?:self\.)?_?(?:log|logger|logging|console)\.\w+|print|raise\s+\w+)\s*\(")
_CLEANED = re.compile(r"(?i)\b(?:sanitize|escape|clean|neutralize|safe|quote)\w*\(")
_ANSWER = re.compile(r"""["'](?:error|message)["']\s*:\s*f?["']""")
_ROLE = re.compile(r"role\W{0,2}[:=]")
_ADDRESS = re.compile(r"(?i)f[\"'].*https?://\{?")
_GRAPH = re.compile(r"(?i)knowledge_?graph|graph_(?:path|file)|kg_|\bgraph\w*\.(?:query|search|load|from_dict)")
_LOADS = re.compile(r"\b(?:json|yaml|pickle)\.(?:load|loads|safe_load)\(")
_DEADLINE = re.compile(r"(?i)timeout|deadline|max_wait|give_up")
_CONSTANT = re.compile(r"\b[A-Z][A-Z0-9_]{2,}\b")
_FIELD = re.compile(r"""["'](?:user_input|user_message|query|question|prompt|input|content)["']\s*:""")
_OWN = re.compile(r"(?i)tempfile|mkstemp|mkdtemp|[\"'/\\]\.?cache\b|cache_dir|[\w-]*report[\w-]*|\.html[\"']|\.lock[\"']|snapshot")
_CHECKED_PATH = re.compile(r"realpath|resolve\(|is_relative_to|basename|secure_filename|filepath\.Clean|normalize\(")
_CHECKED_HOST = re.compile(r"(?i)allow(?:ed)?_?(?:hosts?|list)|whitelist|urlparse|is_private|netloc")
_KEPT_SAFE = re.compile(r"(?i)chmod|0o?600|encrypt|keyring|placeholder|your_")
_LITERAL = re.compile(r"""["']{1,3}\s*([A-Za-z]+)""")
_WORD = re.compile(r"[A-Za-z_]\w*")
_NO_NAMES = frozenset("self cls this def return if else for in not and or None True False import from open with as lambda str int".split())


class Names:
    """What the names of a file are given: the lines that assign them, and the bodies of the functions they call."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.given: dict[str, list[int]] = {}
        self.bodies: dict[str, int] = {}
        for i, line in enumerate(lines):
            if m := re.match(r"\s*(?:async\s+)?def\s+(\w+)\s*\(", line):
                self.bodies.setdefault(m[1], i)
            for m in re.finditer(r"(\w+)\s*(?::\s*[\w.\[\]]+\s*)?(?:\+|:)?=(?![=])", line):
                self.given.setdefault(m[1], []).append(i)

    def text(self, seeds: set[str], depth: int = 4) -> str:
        """All that the seeds lead to, level by level."""
        seen, out, level = set(), [], {s for s in seeds if s not in _NO_NAMES}
        for _ in range(depth):
            found: set[int] = set()
            for name in level - seen:
                found.update(j for i in self.given.get(name, ()) for j in range(i, min(i + 2, len(self.lines))))
                if name in self.bodies:
                    found.update(self.body(self.bodies[name]))
            seen |= level
            part = [self.lines[i] for i in sorted(found)]
            out += part
            level = {w for line in part for w in _WORD.findall(line) if w not in _NO_NAMES} - seen
            if not level:
                break
        return "\n".join(out)

    def body(self, start: int) -> range:
        """The lines of a function: those that are indented more than its head."""
        lead = len(self.lines[start]) - len(self.lines[start].lstrip())
        end = start + 1
        while end < len(self.lines) and (not self.lines[end].strip() or len(self.lines[end]) - len(self.lines[end].lstrip()) > lead):
            end += 1
        return range(start, end)


def call_text(lines: list[str], i: int, at: int) -> str:
    """What stands between the brackets that open at or behind a place, over as many lines as it takes."""
    depth, out, quote = 0, [], ""
    for j in range(i, len(lines)):
        line = lines[j][at:] if j == i else lines[j]
        for k, c in enumerate(line):
            if quote:
                quote = "" if c == quote and line[k - 1 : k] != "\\" else quote
            elif c in "\"'":
                quote = c
            elif c in "([{":
                depth += 1
                if depth == 1:
                    continue
            elif c in ")]}":
                depth -= 1
                if depth <= 0:
                    return "".join(out)
            if depth:
                out.append(c)
        quote = ""
        if not depth and j > i:
            return "".join(out)
        out.append("\n")
    return "".join(out)


def spoken(lines: list[str]) -> set[int]:
    """The lines of calls that only tell somebody something: logs, prints and raised errors."""
    out: set[int] = set()
    for i, line in enumerate(lines):
        if m := _SPEAKS.search(line):
            out.update(range(i, i + 1 + call_text(lines, i, m.end() - 1).count("\n")))
    return out


def code_lines(lines: list[str], language: str) -> Iterator[int]:
    """The numbers from 0 of the lines that hold code: no blank ones, no comments, no docstrings."""
    inside = ""
    for i, line in enumerate(lines):
        s = line.strip()
        if language == "python":
            mark = inside or min((m for m in ('"""', "'''") if m in s), key=s.find, default="")
            if mark:
                toggled = s.count(mark) % 2
                held, inside = inside, ("" if inside else mark) if toggled else inside
                if held or s.startswith(mark):
                    continue
        if s and not _COMMENT.match(s):
            yield i


class Context:
    """What the tests of all hits of a file share; each part is made when it is first asked for."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self._names: Names | None = None
        self._spoken: set[int] | None = None
        self._whole: str | None = None

    @property
    def names(self) -> Names:
        self._names = self._names or Names(self.lines)
        return self._names

    @property
    def told(self) -> set[int]:
        if self._spoken is None:
            self._spoken = spoken(self.lines)
        return self._spoken

    @property
    def whole(self) -> str:
        if self._whole is None:
            self._whole = "\n".join(self.lines)
        return self._whole

    def near(self, i: int, back: int) -> str:
        return "\n".join(self.lines[max(0, i - back) : i + 1])


def written_by_itself(c: Context, i: int, text: str) -> bool:
    """Whether what a line writes to is the program's own: caches, temporary files, reports."""
    return bool(_OWN.search(text) or _OWN.search(c.names.text(set(_WORD.findall(text)), 3)))


def _first_word(c: Context, text: str) -> str:
    """The first word of the statement that a call is given, be it a literal or a name."""
    if m := re.match(r"\s*f?[rb]?" + _LITERAL.pattern, text):
        return m[1].upper()
    name = _WORD.match(text.strip())
    for i in c.names.given.get(name[0], []) if name else []:
        if m := re.search(r"=\s*\(?\s*f?" + _LITERAL.pattern, "\n".join(c.lines[i : i + 3])):
            return m[1].upper()
    return ""


def fate(c: Context, rule: Rule, i: int, m: re.Match) -> tuple[str, str]:
    """(severity or '' where the hit is dropped, why) of a hit."""
    line, name, category = c.lines[i], rule.name.removeprefix("AGENT-SEC-"), _CATEGORY.get(rule.name, rule.name)
    s = line.strip()
    if category != "personal" and name not in ("13", "LEAK") and _LOGGED.match(s):
        return "", "log"
    if _REPORTED.match(s):
        return "", "report"
    if re.search(r"re\.compile\(|regexp\.MustCompile\(|Pattern\.compile\(", s):
        return "", "pattern"
    if category in ("prompt", "context"):
        if i in c.told:
            return "", "told"
        if _CLEANED.search(s):
            return "", "cleaned"
        if _ANSWER.search(s) and not _ROLE.search(s):
            return "", "answer"
        if category == "prompt" and _ADDRESS.search(s):
            return "", "address"
    given = call_text(c.lines, i, m.end() - 1) if m.group().endswith("(") else call_text(c.lines, i, m.start())
    if name == "25" and re.search(r"(?i)timeout\s*=", given):
        return "", "timeout"
    if name == "AUTH" and re.search(r"dependencies\s*=", given):
        return "", "guarded"
    if name == "54" and not re.search(r"(?i)knowledge|graph|kg_", given):
        return "", "unconfirmed"
    if name == "58" and not _GRAPH.search(c.whole):
        return "", "unconfirmed"
    if name == "59" and not (_LOADS.search(c.whole) and _GRAPH.search(c.whole)):
        return "", "unconfirmed"
    if name == "70" and _DEADLINE.search(c.whole):
        return "", "deadline"
    if name in ("58", "59") and re.search(r"\bopen\(\s*args\.", c.near(i, 5)):
        return "medium", "argument"
    if name == "01":
        if not re.search(rule.pattern, _CONSTANT.sub(" ", s)):
            return "", "constant"
        if _FIELD.search(s):
            return "", "field"
        return "medium", "words only"
    if name == "08":
        return _write(c, rule, i, m, given)
    if name == "06" and written_by_itself(c, i, given):
        return "medium", "own"
    if name == "PT" and _CHECKED_PATH.search(c.near(i, 10)):
        return "medium", "checked"
    if name in ("SSRF", "56", "57", "64") and _CHECKED_HOST.search(c.near(i, 10)):
        return "medium", "checked"
    if name == "SECRET" and _KEPT_SAFE.search(c.near(i, 5) + "\n" + "\n".join(c.lines[i + 1 : i + 4])):
        return "medium", "kept safe"
    return rule.severity, ""


def _write(c: Context, rule: Rule, i: int, m: re.Match, given: str) -> tuple[str, str]:
    """Writing without a question: pipes are none, reading and creating are low, so is what the program writes for itself."""
    line, method = c.lines[i], m[1]
    receiver = re.search(r"[\w.]*$", line[: m.start()])[0]
    if method == "write" and re.search(r"std(?:in|out|err)$", receiver):
        return "", "pipe"
    if method.startswith("execute"):
        word = _first_word(c, given)
        if word in ("SELECT", "PRAGMA", "EXPLAIN", "SHOW", "DESCRIBE"):
            return "low", "reading"
        if word == "CREATE":
            return "low", "creating"
    if method in ("write", "save"):
        opened = re.findall(r"\b(?:open|fdopen)\s*\(\s*([^,()]+)", c.near(i, 14))
        if any(x.startswith("args.") for x in opened):
            return "low", "argument"
        if written_by_itself(c, i, " ".join([*opened, given if method == "save" else "", receiver])):
            return "low", "own"
    elif written_by_itself(c, i, receiver):
        return "low", "own"
    return rule.severity, ""


def scan(lines: list[str], language: str, rules: tuple[Rule, ...] = AGENT) -> list[tuple[int, str, str, str, str]]:
    """(line number from 1, rule, category, severity or '', why) of every hit of a file; of a line and category one is kept."""
    c, kept, dropped = Context(lines), {}, []
    tests = [(r, re.compile(r.pattern), re.compile(r.but) if r.but else None) for r in rules if not r.languages or language in r.languages]
    for i in code_lines(lines, language):
        line = lines[i]
        for rule, pattern, but in tests:
            m = pattern.search(line)
            if not m or but and but.search(line):
                continue
            if rule.name == "AGENT-SEC-08":
                m = re.search(r"\.(execute|executemany|commit|write|save)\(", line)
            severity, why = fate(c, rule, i, m)
            category = _CATEGORY.get(rule.name, rule.name)
            if not severity:
                dropped.append((i + 1, rule.name, category, "", why))
                continue
            old = kept.get((i, category))
            if old is None or RANK.index(severity) < RANK.index(old[3]):
                if old:
                    dropped.append((*old[:3], "", "same line"))
                kept[i, category] = (i + 1, rule.name, category, severity, why)
            else:
                dropped.append((i + 1, rule.name, category, "", "same line"))
    return sorted([*kept.values(), *dropped])


_SCHEMA = "file_id bigint, line_no int, rule string, category string, severity string, why string"


def judged(texts: DataFrame, rules: tuple[Rule, ...] = AGENT) -> DataFrame:
    """(file_id, line_no, rule, category, severity, why) of every hit; severity '' where it was dropped. texts: lines as arrays."""

    def run(batches):
        for b in batches:
            out = [(key, *x) for key, language, lines in zip(*(b.column(i).to_pylist() for i in range(3))) for x in scan(lines, language, rules)]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), *[pa.string()] * 4))], names=["file_id", "line_no", "rule", "category", "severity", "why"])

    return texts.select("file_id", "language", "all_").where("language <> ''").mapInArrow(run, _SCHEMA)


def findings(texts: DataFrame) -> DataFrame:
    """What is left: (file_id, line_no, rule, category, severity, why)."""
    return judged(texts).where("severity <> ''")


def fates(texts: DataFrame) -> DataFrame:
    """(rule, why, n_kept, n_dropped)."""
    from pyspark.sql import functions as F

    kept = (F.col("severity") != "").cast("int")
    return judged(texts).groupBy("rule", "why").agg(F.sum(kept).alias("n_kept"), F.sum(1 - kept).alias("n_dropped"))
