"""Comments and string literals of source text, by a tolerant scan that also works on fragments."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Languages by extension; what is not listed is read as a configuration file.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "json": "json",
}

_Q = r'"(?:\\.|[^"\\\n])*"?'
_A = r"'(?:\\.|[^'\\\n])*'?"
_SLASH = r"(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?(?:\*/|\Z))"
_PATTERNS = {
    "python": r"(?P<line>\#[^\n]*)|(?P<text>[rRbBuUfFtT]{0,3}(?:\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*(?:\"\"\"|\Z)|'''(?:\\[\s\S]|(?!''')[^\\])*(?:'''|\Z)))|(?P<string>[rRbBuUfFtT]{0,3}(?:" + _Q + "|" + _A + "))",
    "javascript": _SLASH + r"|(?P<regex>(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)|(?P<string>" + _Q + "|" + _A + r")|(?P<text>`(?:\\[\s\S]|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\}|[^`\\])*(?:`|\Z))",
    "go": _SLASH + r"|(?P<text>`[^`]*(?:`|\Z))|(?P<string>" + _Q + r")|(?P<rune>'(?:\\.|[^'\\\n])+')",
    "java": _SLASH + r'|(?P<text>"""(?:\\[\s\S]|(?!""")[^\\])*(?:"""|\Z))|(?P<string>' + _Q + r")|(?P<rune>'(?:\\.|[^'\\\n])+')",
    "json": r"(?P<string>" + _Q + ")",
    "": r"(?P<line>(?<![^\s])\#[^\n]*)|(?P<string>" + _Q + "|" + _A + ")",
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
_COMPILED = {k: re.compile(v) for k, v in _PATTERNS.items()}
_OPEN = re.compile(r"[A-Za-z]{0,3}(?:\"\"\"|'''|[\"'`])")


def language_of(path: str | None) -> str:
    return LANGUAGES.get((path or "").rpartition("/")[2].rpartition(".")[2].lower(), "")


def spans(code: str, language: str) -> Iterator[tuple[str, int, int]]:
    """(line, block, text, string, rune or regex; start; end) in order."""
    for m in _COMPILED[language].finditer(code):
        yield m.lastgroup, m.start(), m.end()


def inside(code: str, kind: str, a: int, b: int) -> str:
    """The text of a span without its marks."""
    s = code[a:b]
    if kind == "line":
        return re.sub(r"^(?:\#+!?|//+[/!]?)", "", s)
    if kind == "block":
        return "\n".join(re.sub(r"^[ \t]*\*+(?!/)[ \t]?", "", x) for x in re.sub(r"^/\*+!?|\*+/$", "", s).split("\n"))
    m = _OPEN.match(s)
    if not m:
        return s
    q = m.group().lstrip("rRbBuUfFtT")
    return s[m.end() : len(s) - len(q) if len(s) >= m.end() + len(q) and s.endswith(q) else len(s)]


def without_text(code: str, language: str) -> str:
    """The code with its comments and the contents of its strings left out."""
    out, at = [], 0
    for kind, a, b in spans(code, language):
        out.append(code[at:a])
        if kind in ("string", "text", "rune"):
            out.append('""')
        at = b
    return "".join(out) + code[at:]
