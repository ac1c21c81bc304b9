"""Token types of source text, per language. Raises Bad with a position where no token can begin or end."""

from __future__ import annotations

import re
import unicodedata


class Bad(Exception):
    def __init__(self, at: int, why: str):
        super().__init__(f"{why} at {at}")
        self.at, self.why = at, why


#: Reserved words of the languages, fixed values.
PYTHON_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
PYTHON_SOFT = frozenset("match case type".split())
JS_WORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof let new null return super switch this throw true try typeof var void while with yield await static implements interface package private protected public".split())
JS_SOFT = frozenset("async of get set from as type namespace module declare abstract readonly keyof infer is asserts satisfies unique override accessor global require out meta target".split())
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
JAVA_WORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split())
JAVA_SOFT = frozenset("record sealed permits yield when module open requires exports opens uses provides to with transitive non".split())

_ID = r"[^\W\d]\w*"

_PY = re.compile(
    r"(?P<space>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\r\n]*)|(?P<newline>\r?\n|\r)"
    r"|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"
    r"|(?P<string>(?:[rRuU]|[bB][rR]?|[rR][bB])?(?:\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"|'''(?:\\[\s\S]|(?!''')[^\\])*'''|\"(?!\"\")(?:\\(?:\r\n|[\s\S])|[^\"\\\r\n])*\"|'(?!'')(?:\\(?:\r\n|[\s\S])|[^'\\\r\n])*'))"
    r"|(?P<fstring>(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|\"|'))"
    r"|(?P<name>" + _ID + r")"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:;.=!])"
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


def python(text: str) -> tuple[list[str], list[int]]:
    if text.startswith("\ufeff"):
        text = text[1:]
    if "\0" in text:
        raise Bad(text.index("\0"), "null character")
    kinds: list[str] = []
    places: list[int] = []
    indents = [(0, 0)]
    stack: list[tuple[str, str]] = []  # open brackets and f-strings
    at, n, fresh = 0, len(text), True
    match = _PY.match
    while at < n:
        if fresh and not stack:
            m = re.compile(r"[ \t\f]*").match(text, at)
            lead = m.group()
            end = m.end()
            if end < n and text[end] not in "#\r\n" and not re.compile(r"\\\r?\n").match(text, end):
                fresh = False
                lead = lead.rpartition("\f")[2]
                wide = len(lead.expandtabs(8)), len(lead.expandtabs(1))
                if wide[0] > indents[-1][0]:
                    if wide[1] <= indents[-1][1]:
                        raise Bad(at, "tabs and spaces mixed")
                    indents.append(wide)
                    kinds.append("INDENT")
                    places.append(end)
                else:
                    while wide[0] < indents[-1][0]:
                        indents.pop()
                        kinds.append("DEDENT")
                        places.append(end)
                    if wide != indents[-1]:
                        raise Bad(at, "unindent matches no outer level")
                at = end
                continue
            if end >= n:
                break
            at = end
        if stack and stack[-1][0] == "f":  # in the literal part of an f-string
            at = _fpart(text, at, kinds, places, stack)
            continue
        m = match(text, at)
        if m is None:
            raise Bad(at, "unterminated string" if text[at] in "\"'" else "unexpected character")
        kind, s = m.lastgroup, m.group()
        end = m.end()
        if kind == "space" or kind == "comment":
            pass
        elif kind == "newline":
            if not stack:
                if not fresh:
                    kinds.append("NEWLINE")
                    places.append(at)
                fresh = True
            elif len(stack) > 1 and any(x[0] == "f" and len(x[1]) == 1 for x in stack) and False:
                raise Bad(at, "line break in f-string")
        elif kind == "name":
            if not s.isascii() and not unicodedata.normalize("NFKC", s).isidentifier():
                raise Bad(at, "unexpected character")
            kinds.append(s if s in PYTHON_WORDS or s in PYTHON_SOFT else "NAME")
            places.append(at)
        elif kind == "number":
            if end < n and (text[end].isalnum() or text[end] == "_") and not re.compile(r"(?:if|else|or|and|in|is|for|not)\b").match(text, end):
                raise Bad(at, "invalid number")
            if re.fullmatch(r"0\d*[1-9]\d*", s.replace("_", "")):
                raise Bad(at, "leading zeros")
            kinds.append("NUMBER")
            places.append(at)
        elif kind == "string":
            kinds.append("STRING")
            places.append(at)
        elif kind == "fstring":
            quote = s.lstrip("fFrR")
            stack.append(("f", quote + ("r" if "r" in s.lower()[: -len(quote)] else "")))
            kinds.append("FS")
            places.append(at)
        else:
            top = stack[-1] if stack else None
            if top and top[0] == "{f":  # within a replacement field
                if s == "}":
                    stack.pop()
                    kinds.append("F}")
                    places.append(at)
                    at = end
                    continue
                if s[0] == ":" and s != ":=" or s == ":=":
                    stack.append(("f", "spec"))
                    kinds.append("F:")
                    places.append(at)
                    at += 1
                    continue
                if s == "!":
                    kinds.append("F!")
                    places.append(at)
                    at = end
                    continue
                if s == "=" and re.compile(r"=\s*[}!:]").match(text, at):
                    kinds.append("F=")
                    places.append(at)
                    at = end
                    continue
            if s == "!":
                raise Bad(at, "unexpected character")
            if s in _OPEN:
                stack.append((s, _OPEN[s]))
            elif s in _CLOSE:
                if not top or top[1] != s:
                    raise Bad(at, "unmatched bracket")
                stack.pop()
            kinds.append(s)
            places.append(at)
        at = end
    if stack:
        raise Bad(n, "never closed")
    if kinds and not fresh:
        kinds.append("NEWLINE")
        places.append(n)
    while len(indents) > 1:
        indents.pop()
        kinds.append("DEDENT")
        places.append(n)
    return kinds, places


def _fpart(text, at, kinds, places, stack):
    """One literal part of an f-string or of a format after a colon, up to its next field or end."""
    quote = stack[-1][1]
    n = len(text)
    if quote == "spec":
        outer = next(x[1] for x in reversed(stack[:-1]) if x[0] == "f" and x[1] != "spec")
        while at < n:
            c = text[at]
            if c == "{":
                stack.append(("{f", ""))
                kinds.append("F{")
                places.append(at)
                return at + 1
            if c == "}":
                stack.pop()
                return at
            if text.startswith(outer.rstrip("r"), at) or c == "\n" and len(outer.rstrip("r")) == 1:
                raise Bad(at, "unterminated field")
            at += 1
        raise Bad(at, "unterminated f-string")
    raw = quote.endswith("r")
    q = quote.rstrip("r")
    while at < n:
        c = text[at]
        if text.startswith(q, at):
            stack.pop()
            kinds.append("FE")
            places.append(at)
            return at + len(q)
        if c == "\\":
            if not raw and text.startswith("\\N{", at):
                end = text.find("}", at)
                at = end + 1 if end >= 0 else n
                continue
            at += 1 if text[at + 1 : at + 2] in "{}" else 2
        elif c == "{":
            if text.startswith("{{", at):
                at += 2
                continue
            stack.append(("{f", ""))
            kinds.append("F{")
            places.append(at)
            return at + 1
        elif c == "}":
            if not text.startswith("}}", at):
                raise Bad(at, "single } in f-string")
            at += 2
        elif c == "\n" and len(q) == 1:
            raise Bad(at, "unterminated f-string")
        else:
            at += 1
    raise Bad(at, "unterminated f-string")


_JS = re.compile(
    r"(?P<space>[^\S\r\n\u2028\u2029]+|\ufeff)|(?P<newline>\r\n?|[\n\u2028\u2029])|(?P<comment>//[^\r\n\u2028\u2029]*|/\*[\s\S]*?\*/)"
    r"|(?P<number>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:(?:0|[1-9](?:_?\d)*)n|(?:(?:\d(?:_?\d)*)\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)))"
    r"|(?P<name>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    r"|(?P<private>\#(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<string>\"(?:\\(?:\r\n|[\s\S])|[^\"\\\r\n])*\"|'(?:\\(?:\r\n|[\s\S])|[^'\\\r\n])*')"
    r"|(?P<op>\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\?\.(?!\d)|\?\?|==|!=|<=|>=|&&|\|\||\+\+|--|\*\*|<<|\+=|-=|\*=|%=|&=|\|=|\^=|[-+*%&|^~<>()\[\]{},:;.=!?@])"
)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\r\n\[])+/[A-Za-z]*")
#: After these a slash divides.
_VALUE_END = frozenset("NAME NUMBER STRING REGEX TPL TTAIL PRIVATE ) ] } this super null true false ++ --".split()) | JS_SOFT


def javascript(text: str) -> tuple[list[str], list[int]]:
    kinds: list[str] = []
    places: list[int] = []
    stack: list[str] = []
    control: list[bool] = []  # whether a bracket belongs to a statement, so that an expression begins behind it
    at, n, line = 0, len(text), ""
    last = ""
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    match = _JS.match
    while at < n:
        m = match(text, at)
        if m is None:
            c = text[at]
            if c == "`":
                kind, at2 = _template(text, at + 1, True)
                if kind == "THEAD":
                    stack.append("`")
                    control.append(False)
                kinds.append(kind + line)
                places.append(at)
                last, line, at = kind, "", at2
                continue
            if c == "/":
                r = _REGEX.match(text, at) if last not in _VALUE_END else None
                if r:
                    kind, end = "REGEX", r.end()
                else:
                    kind, end = ("/=", at + 2) if text.startswith("/=", at) else ("/", at + 1)
                    if text.startswith("/*", at):
                        raise Bad(at, "unterminated comment")
                kinds.append(kind + line)
                places.append(at)
                last, line, at = kind, "", end
                continue
            raise Bad(at, "unterminated string" if c in "\"'" else "unexpected character")
        group, s, end = m.lastgroup, m.group(), m.end()
        if group == "space":
            at = end
            continue
        if group == "newline":
            line, at = "~", end
            continue
        if group == "comment":
            if s[1] == "*" and ("\n" in s or "\r" in s):
                line = "~"
            at = end
            continue
        if group == "name":
            kind = s if s in JS_WORDS or s in JS_SOFT else "NAME"
            if last == "." or last == "?.":
                last = "NAME"
            else:
                last = kind
        else:
            if group == "number":
                if end < n and (text[end].isalnum() or text[end] in "_$"):
                    raise Bad(at, "invalid number")
                kind = "NUMBER"
            elif group == "string":
                kind = "STRING"
            elif group == "private":
                kind = "PRIVATE"
            else:
                kind = s
                if s in "([{":
                    stack.append(s)
                    control.append(s == "(" and last in ("if", "while", "for", "with"))
                elif s in ")]}":
                    if s == "}" and stack and stack[-1] == "`":
                        kind, end = _template(text, end, False)
                        if kind == "TTAIL":
                            stack.pop()
                            control.pop()
                        kinds.append(kind)
                        places.append(at)
                        last, line, at = kind, "", end
                        continue
                    if not stack or _OPEN.get(stack[-1]) != s:
                        raise Bad(at, "unmatched bracket")
                    stack.pop()
                    if control.pop():
                        kinds.append(kind + line)
                        places.append(at)
                        last, line, at = "control )", "", end
                        continue
            last = kind
        kinds.append(kind + line)
        places.append(at)
        line, at = "", end
    if stack:
        raise Bad(n, "never closed")
    return kinds, places


def _template(text, at, first):
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return ("TPL" if first else "TTAIL"), at + 1
        elif c == "$" and text.startswith("${", at):
            return ("THEAD" if first else "TMID"), at + 2
        else:
            at += 1
    raise Bad(at, "unterminated template")


_GO = re.compile(
    r"(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)"
    r"|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?|\d(?:_?\d)*\.?(?:[eE][+-]?\d+)?)i?)"
    r"|(?P<name>" + _ID + r")"
    r"|(?P<string>\"(?:\\(?:[abfnrtv\\\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3})|[^\"\\\n])*\"|`[^`]*`)"
    r"|(?P<rune>'(?:\\(?:[abfnrtv\\']|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3})|[^'\\\n])')"
    r"|(?P<op>\.\.\.|&\^=|<<=|>>=|:=|\+\+|--|&&|\|\||<-|==|!=|<=|>=|&\^|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^<>()\[\]{},:;.=!~])"
)
_GO_ENDS = frozenset("NAME NUMBER STRING RUNE break continue fallthrough return ++ -- ) ] }".split())


def go(text: str) -> tuple[list[str], list[int]]:
    kinds: list[str] = []
    places: list[int] = []
    stack: list[str] = []
    at, n = 0, len(text)
    if text.startswith("\ufeff"):
        at = 1
    match = _GO.match
    while at < n:
        m = match(text, at)
        if m is None:
            raise Bad(at, "unterminated literal" if text[at] in "\"'`" else "unexpected character")
        group, s, end = m.lastgroup, m.group(), m.end()
        if group == "newline" or group == "block" and "\n" in s:
            if kinds and kinds[-1] in _GO_ENDS:
                kinds.append(";")
                places.append(at)
        elif group in ("space", "line", "block"):
            pass
        else:
            if group == "name":
                kind = s if s in GO_WORDS else "NAME"
            elif group == "number":
                if end < n and (text[end].isalnum() or text[end] == "_"):
                    raise Bad(at, "invalid number")
                kind = "NUMBER"
            elif group == "op":
                kind = s
                if s in "([{":
                    stack.append(s)
                elif s in ")]}":
                    if not stack or _OPEN[stack.pop()] != s:
                        raise Bad(at, "unmatched bracket")
            else:
                kind = group.upper()
            kinds.append(kind)
            places.append(at)
        at = end
    if stack:
        raise Bad(n, "never closed")
    if kinds and kinds[-1] in _GO_ENDS:
        kinds.append(";")
        places.append(n)
    return kinds, places


_JAVA = re.compile(
    r"(?P<space>\s+|//[^\r\n]*|/\*[\s\S]*?\*/|\x1a\Z)"
    r"|(?P<number>(?:0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[xX](?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?\.?(?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?[pP][+-]?\d+[fFdD]?|0[bB][01](?:_*[01])*[lL]?|(?:(?:\d(?:_*\d)*)?\.\d(?:_*\d)*|\d(?:_*\d)*\.?)(?:[eE][+-]?\d(?:_*\d)*)?[fFdDlL]?))"
    r"|(?P<name>(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<string>\"\"\"[ \t\f]*\r?\n(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"|\"(?!\"\")(?:\\(?:[btnfrs\"'\\]|u+[0-9a-fA-F]{4}|[0-7]{1,3})|[^\"\\\r\n])*\"|\"\"(?!\"))"
    r"|(?P<char>'(?:\\(?:[btnfrs\"'\\]|u+[0-9a-fA-F]{4}|[0-7]{1,3})|[^'\\\r\n])')"
    r"|(?P<op>\.\.\.|<<=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~<>()\[\]{},:;.=!?@])"
)


def java(text: str) -> tuple[list[str], list[int]]:
    kinds: list[str] = []
    places: list[int] = []
    stack: list[str] = []
    at, n = 0, len(text)
    match = _JAVA.match
    while at < n:
        m = match(text, at)
        if m is None:
            raise Bad(at, "unterminated literal" if text[at] in "\"'" else "unterminated comment" if text.startswith("/*", at) else "unexpected character")
        group, s, end = m.lastgroup, m.group(), m.end()
        if group != "space":
            if group == "name":
                kind = s if s in JAVA_WORDS or s in JAVA_SOFT else "NAME"
            elif group == "number":
                if end < n and (text[end].isalnum() or text[end] in "_$"):
                    raise Bad(at, "invalid number")
                kind = "NUMBER"
            elif group == "op":
                kind = s
                if s in "([{":
                    stack.append(s)
                elif s in ")]}":
                    if not stack or _OPEN[stack.pop()] != s:
                        raise Bad(at, "unmatched bracket")
            else:
                kind = group.upper()
            kinds.append(kind)
            places.append(at)
        at = end
    if stack:
        raise Bad(n, "never closed")
    return kinds, places


_JSON = re.compile(r"(?P<space>[ \t\r\n]+)|(?P<string>\"(?:\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4})|[^\"\\\x00-\x1f])*\")|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<name>true|false|null)(?!\w)|(?P<comment>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<op>[{}\[\],:])")


def json(text: str) -> tuple[list[str], list[int]]:
    kinds: list[str] = []
    places: list[int] = []
    at, n = 0, len(text)
    while at < n:
        m = _JSON.match(text, at)
        if m is None:
            raise Bad(at, "unexpected character")
        if m.lastgroup != "space":
            kinds.append("COMMENT" if m.lastgroup == "comment" else m.group() if m.lastgroup == "op" else "VALUE" if m.lastgroup in ("number", "name") else "STRING")
            places.append(at)
        at = m.end()
    return kinds, places
