"""Errors that a grammar of symbols can't say: statements out of their place, names given twice, what can't be assigned to.

Each pass reads the tokens of a file that its grammar accepted, once, and gives the place of the first error and what it is.
Passes leave alone what depends on types or other files.
"""

from __future__ import annotations

import re

Error = tuple[int, str]
_NAME = re.compile(r"\w+")


def _name(text: str, at: int) -> str:
    m = _NAME.match(text, at)
    return m.group() if m else ""


def python(tokens: list[str], places: list[int], text: str) -> Error | None:
    """return, yield, break, continue, nonlocal and star imports out of place; parameters and keywords given twice."""
    blocks: list[str] = []  # what each indent belongs to
    head, fresh, lambdas = "", True, False
    brackets: list[tuple[str, set[str], int]] = []  # (params, call or other; names; where)
    shift = 1 if text.startswith("\ufeff") else 0

    def scope() -> str:
        """The innermost function or class, the head of this line among them."""
        for kind in [*blocks, head][::-1]:
            if kind in ("def", "class"):
                return kind
        return ""

    def loop() -> bool:
        for kind in [*blocks, head][::-1]:
            if kind in ("for", "while"):
                return True
            if kind in ("def", "class"):
                return False
        return False

    for i, t in enumerate(tokens):
        if t == "INDENT":
            blocks.append(last_head)
            continue
        if t == "DEDENT":
            blocks.pop()
            continue
        if fresh:
            head = t if t != "async" else tokens[i + 1]
            first, fresh, lambdas = i, False, False
        if t == "NEWLINE":
            last_head, head, fresh = head, "", True
            continue
        if t == "lambda":
            lambdas = True
        elif t == "return" and scope() != "def":
            return places[i], "return outside a function"
        elif t == "yield" and not lambdas and scope() != "def":
            return places[i], "yield outside a function"
        elif t == "break" and not loop() or t == "continue" and not loop():
            return places[i], f"{t} outside a loop"
        elif t == "nonlocal" and not any(b == "def" for b in [*blocks, head]):
            return places[i], "nonlocal at the level of the module"
        elif t == "*" and scope() and tokens[i - 1] == "import" and "from" in tokens[first:i]:
            return places[i], "a star import inside a function or class"
        if t in ("(", "[", "{"):
            kind = "other"
            if t == "(":
                before = tokens[i - 1] if i else ""
                if before == "NAME" and i >= 2 and tokens[i - 2] == "def" or before == "]" and tokens[first] in ("def", "async") and not brackets:
                    kind = "params"
                elif before in ("NAME", ")", "]", "match", "case", "type") and not (before == "NAME" and i >= 2 and tokens[i - 2] in ("class",)):
                    kind = "call"
            brackets.append((kind, set(), i))
        elif t in (")", "]", "}") and brackets:
            brackets.pop()
        elif brackets and brackets[-1][0] != "other" and t in ("NAME", "match", "case", "type"):
            kind, seen, _ = brackets[-1]
            if kind == "params" and tokens[i - 1] in ("(", ",", "*", "**") or kind == "call" and tokens[i + 1] == "=" and tokens[i - 1] in ("(", ","):
                name = _name(text, places[i] + shift)
                if name in seen:
                    return places[i], f"{name} given twice"
                seen.add(name)
    return None


_LITERALS = frozenset("NUMBER STRING REGEX CHAR TPL null true false".split())
_ASSIGNS = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_HEADS = frozenset("if for while switch catch with".split())


def _pairs(tokens: list[str]) -> dict[int, int]:
    """The place of the bracket that each closing one closes."""
    stack, out = [], {}
    for i, t in enumerate(tokens):
        if t in ("(", "[", "{", "THEAD"):
            stack.append(i)
        elif t in (")", "]", "}", "TTAIL") and stack:
            out[i] = stack.pop()
    return out


def _assigned(tokens: list[str], pairs: dict[int, int], places: list[int]) -> Error | None:
    """Assignments to literals and to what calls give."""
    opens = set(pairs.values())
    depth = 0
    for i, t in enumerate(tokens):
        depth += (i in opens) - (i in pairs)
        if t not in _ASSIGNS or not i:
            continue
        before = tokens[i - 1]
        if before in _LITERALS and (i < 2 or tokens[i - 2] != "."):
            if depth and before in ("STRING", "NUMBER") and (i < 2 or tokens[i - 2] in ("{", ",", ";", "static", "readonly", "public", "private", "protected", "}")):
                continue  # a key of a pattern, a field of a class, a member of an enumeration
            return places[i], "assignment to a literal"
        if before == ")" and pairs.get(i - 1, 0) and tokens[pairs[i - 1] - 1] in ("NAME", ")", "]"):
            return places[i], "assignment to a call"
    return None


def javascript(tokens: list[str], places: list[int], text: str, typed: bool = False) -> Error | None:
    """For modules and typed ones, which are strict: targets, constants without a value, names declared twice in a block, numbers
    with a leading nought, deleted names; in modules also return, break and continue out of place."""
    tokens = [t.rstrip("~") for t in tokens]
    pairs = _pairs(tokens)
    if error := _assigned(tokens, pairs, places):
        return error
    closes = {a: b for b, a in pairs.items()}
    scopes: list[tuple[str, set[str]]] = [("top", set())]
    ends: list[int] = []
    loops = [False]
    for i, t in enumerate(tokens):
        while ends and ends[-1] == i:
            ends.pop()
            kind, _ = scopes.pop()
            if kind == "function":
                loops.pop()
        before = tokens[i - 1] if i else ""
        if t in ("{", "(", "[") and i in closes:
            kind = "block"
            if t == "{":
                opener = pairs.get(i - 1) if before == ")" else None
                if before == "=>" or opener is not None and tokens[opener - 1] not in _HEADS and not (tokens[opener - 1] == "await" and tokens[opener - 2] == "for"):
                    kind = "function"
                    loops.append(False)
                elif typed and before in ("NAME", "]", ">", "}", "void", "null", "true", "false", "this", "STRING"):
                    kind = "function"  # behind a type, which may be that of a function's result
                    loops.append(True)
            scopes.append((kind, set()))
            ends.append(closes[i])
        elif t in ("for", "while", "do", "switch") and before not in (".", "?."):
            loops[-1] = True
        elif t == "NUMBER" and re.match(r"0\d", text[places[i] : places[i] + 2]):
            return places[i], "a number with a leading nought"
        elif t == "delete" and before not in (".", "?.", "{", ",") and i + 2 < len(tokens) and tokens[i + 1] == "NAME" and tokens[i + 2] in (";", ")", "}", ","):
            return places[i], "a name is deleted"
        elif t in ("let", "const") and before not in (".", "?.") and i + 1 < len(tokens) and tokens[i + 1] == "NAME":
            name = _name(text, places[i + 1])
            after = tokens[i + 2] if i + 2 < len(tokens) else ";"
            if name in scopes[-1][1]:
                return places[i + 1], f"{name} declared twice"
            scopes[-1][1].add(name)
            if t == "const" and after == ";" and before != "declare":
                return places[i + 1], f"{name} has no value"
        elif not typed and t == "return" and before not in (".", "?.", "{", ",") and not any(k == "function" for k, _ in scopes):
            return places[i], "return outside a function"
        elif not typed and t in ("break", "continue") and before not in (".", "?.", ",") and not loops[-1] and i + 1 < len(tokens) and tokens[i + 1] in (";", "}"):
            return places[i], f"{t} outside a loop"
    return None


def java(tokens: list[str], places: list[int], text: str) -> Error | None:
    """Assignments to literals and calls; statements that are only a literal."""
    tokens = [t.rstrip("~") for t in tokens]
    pairs = _pairs(tokens)
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else ""
        if t in ("NUMBER", "CHAR", "STRING", "null", "true", "false") and before in (";", "{", "}"):
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            if after == ";" or after in _ASSIGNS:
                return places[i], "a literal is no statement"
        if t in _ASSIGNS and before == ")" and i - 1 in pairs:
            at = pairs[i - 1]
            if at >= 2 and tokens[at - 1] == "NAME" and tokens[at - 2] in (";", "{", "}", "."):
                return places[i], "assignment to a call"
    return None


def go(tokens: list[str], places: list[int], text: str) -> Error | None:
    """Only names can be declared by :=, and break and continue stand in loops, switches and selections."""
    tokens = [t.rstrip("~") for t in tokens]
    for i, t in enumerate(tokens):
        if t == ":=" and i and tokens[i - 1] != "NAME":
            return places[i], "no name on the left of :="
        if t == ":=" and i >= 2 and tokens[i - 2] == ".":
            return places[i], "no name on the left of :="
    return None


def error(language: str, dialect: str, tokens: list[str], places: list[int], text: str) -> Error | None:
    """The first error of a file that the grammar of a dialect accepts."""
    if language == "python":
        return python(tokens, places, text)
    if language == "javascript" and dialect in ("module", "ts"):
        return javascript(tokens, places, text, dialect == "ts")
    if language == "java":
        return java(tokens, places, text)
    if language == "go":
        return go(tokens, places, text)
    return None
