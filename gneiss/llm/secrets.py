"""Problem 5: credentials in source and configuration text.

A text is scanned for token formats, private key blocks, credentials in URLs, headers and comments, and literal values
given to names that say password, token or key. Then everything that may be an encoded literal, single ones as well as those
joined by an operator or wrapped over lines, is decoded from base64, hex, percent and escape encodings; key containers among the
results are parsed by their binary grammar to the end (PKCS#1, PKCS#8 plain or encrypted, SEC1, PKCS#12, OpenSSH), other
results are scanned and decoded again, layer by layer until nothing decodes any more. A hit inside is reported, and
redacted, as the whole enclosing literal. A literal that still opens after WORK bytes for each of its own counts as a hit.

Defined cases: null and empty texts have no finding; several secrets that start on one line give one row; a value is
redacted in place: its quotes, operators, line ends and everything else stay, also between the parts of a joined one; texts are
scanned whole, whatever their length.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.batches import map_rows

#: Bytes that are decoded for each byte of a literal, with a start that covers short ones.
WORK, WORK_LEAST = 256, 1 << 20
#: Published token formats, fixed values.
TOKENS = re.compile(
    r"(?<![A-Za-z0-9_-])(?:gh[opsur]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|glpat-[\w-]{18,}|xox[abposr]-[A-Za-z0-9-]{16,}"
    r"|[srp]k[-_](?:live|test|prod)[-_][A-Za-z0-9]{16,}|sk-[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{30,}|AIza[\w-]{35}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"
)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY(?: BLOCK)?-----((?:(?!-----)[\s\S])*)(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?")
URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]+)@[\w.-]+", re.I)
QUERY = re.compile(r"[?&;]([A-Za-z_][\w.-]*)=([^&\s\"'`<>#;]{6,})")
HEADER = re.compile(r"\b(?:Bearer|Basic|Token|token)\s+([A-Za-z0-9+/_.~=-]{12,})")
#: name, separator, literal: in quotes, or to the end of the line in configuration and comments
_NAMED = r"(?<![\w.-])(?=[\w.-]*?(?i:pass|pwd|pw|secret|token|key|cred|auth|pem|salt))"
QUOTED = re.compile(_NAMED + r"""(?P<name>[A-Za-z_][\w.-]*)["'`]?\]?[ \t]*(?::[ \t]*[\w.<>\[\], |]+?[ \t]*)?(?::=|=>|=|:|\|\||\?\?|\bor\b|,(?<=["'`],))[ \t]*(?:[rbuf]{0,2})?(?P<q>\"\"\"|'''|["'`])(?P<value>(?:\\.|(?!(?P=q)).)*?)(?P=q)""")
BARE = re.compile(r"""^[ \t]*(?:(?:\#|//|\*|--|;)+[ \t]*)?(?:export[ \t]+|set[ \t]+)?""" + _NAMED + r"""(?P<name>[A-Za-z_][\w.-]*)[ \t]*[=:][ \t]*(?P<value>[^\s"'`#;,(){}\[\]][^\s"'`(){}\[\]]*)[ \t]*(?:\#.*|;)?\r?$""", re.M)
#: literals joined by an operator, or by standing next to each other
JOIN = re.compile(r"""(?<!["'`\\\w])(["'])(?:\\.|(?!\1)[^\\\n])+\1(?:(?:[ \t]*\+[ \t]*|[ \t]+)(?:\\?\r?\n[ \t]*)?(?:\+[ \t]*)?\1(?:\\.|(?!\1)[^\\\n])+\1|\\?\r?\n[ \t]*(?:\+[ \t]*)?\1(?:\\.|(?!\1)[^\\\n])+\1)+""")
PART = re.compile(r"""(["'])((?:\\.|(?!\1)[^\\\n])*)\1""")
#: the password given as second argument of a login
LOGIN = re.compile(r"""(?i)\b(?:login|log_?in|authenticate|connect|sign_?in|set_?credentials|basic_?auth|credentials|auth)\(\s*(["'])[^"'\n]*\1\s*,\s*(["'])((?:\\.|(?!\2)[^\\\n])+)\2""")
#: in comments: a secret after a word that announces it, or an account with its password and nothing else
REMARK = re.compile(r"""\b(?i:password|passwd|passphrase|pass|pwd|pw|login|secret|token|key|creds?|credentials?)[ \t]*[:=]?[ \t]+(?P<value>[^\s"'`]{8,})[ \t]*\r?$""", re.M)
_IN_COMMENT = re.compile(r"(?:|.*\s)(?:\#+|//+|\*|--|;)[ \t]*(?:[\w.'-]+[ \t]+)*")
ACCOUNT = re.compile(r"""^[ \t]*(?:\#+|//+|\*|--|;)[ \t]*(?P<user>[A-Za-z][\w.-]*):(?P<value>[^\s:"'`]{8,})[ \t]*\r?$""", re.M)
_IDENTIFIER = re.compile(r"[a-z]+(?:_[a-z0-9]+)*|[A-Z]+(?:_[A-Z0-9]+)*|[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)*\d*|[\w.]+\(.*|[0-9a-f]+|[\w.-]+\.[A-Za-z]\w{0,5}|[\d.:-]+")

_STRONG = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "secret", "apikey", "cred", "credential", "credentials", "token", "pw", "authtoken"}
_KEYED = {"api", "access", "private", "encryption", "signing", "push", "upload", "auth", "client", "service", "deploy", "master", "account", "storage", "license", "admin", "app", "shared", "secret", "webhook", "hook", "crypto", "crypt", "aes", "hmac", "jwt", "session"}
#: A name that ends so names something about the secret, not the secret.
_ABOUT = {"url", "uri", "field", "name", "path", "file", "dir", "header", "label", "hint", "type", "count", "limit", "budget", "size", "len", "length", "md5", "sha", "sha1", "sha256", "sha512", "hash", "checksum", "id", "ids", "regex", "pattern", "policy", "min", "max", "env", "var", "ttl", "expiry", "prefix", "suffix", "format", "index", "integrity", "fingerprint", "endpoint", "placeholder", "column", "param", "key_name", "message", "error", "title", "text", "prompt", "help", "description", "total", "mode", "v"}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:.*(?:change[_-]?me|placeholder|your[_-]|[_-]your|example|dummy|redacted|insert|replace|set[_-]me|to[_-]?do|fixme|fill[_-]?in|sample|not[_-]?set|undefined|my[_-]?(?:secret|token|password|key|api)|enter[_-]|xxxx|\*\*\*\*|\.\.\.|0123456789|1234567|abcdef).*|(.)\1*|none|null|nil|true|false|empty|secret|password|passwd|token|test|testing|default|unset|n/?a|foo|bar|foobar|hunter2|admin|root|user|letmein|qwerty\d*)$"
)
_REFERENCE = re.compile(r"(?i)^(?:\$[a-z_({]|%\w+%|\{|<[^<>]*>?$|\[|@\w+/|env[:.]|vault:|arn:|ssm:|secret(?:s|ref)?[:./]|op://|ref[:+]|file:|keyring:|kms:|sops:|aws:|gcp:|azure:|!(?:ref|sub|vault|env|secret)\b|os\.|process\.|system\.|config\.|settings\.|getenv|self\.|this\.)|\$\{|\{\{|\}\}|<%|%\(|\$\(")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_kind(name: str) -> int:
    """2 for names of secrets, 1 for names of keys in general, 0 else."""
    parts = [w.lower() for w in _WORDS.findall(name.rpartition(".")[2])]
    if not parts or parts[-1] in _ABOUT or "public" in parts or "pub" in parts:
        return 0
    joined = "_".join(parts)
    if "token_budget" in joined or "max_token" in joined or "tokens" in parts:
        return 0
    if _STRONG & set(parts) or "api_key" in joined:
        return 2
    if "key" in parts and _KEYED & set(parts):
        return 2
    if parts[-1] in ("auth", "authorization") and len(parts) > 1:
        return 2
    return 1 if parts[-1] in ("key", "pem", "salt", "auth", "authorization") else 0


def usable(value: str, strict: bool = False) -> bool:
    """Whether a literal can be a secret. strict: nothing but its look speaks for it."""
    v = value.strip()
    if len(v) < (20 if strict else 8) or re.search(r"\s", v) or _PLACEHOLDER.match(v) or _REFERENCE.search(v) or _UUID.match(v):
        return False
    if re.match(r"(?:[a-z][a-z0-9+.-]*:)?//?[\w.-]*/?", v) and (v.startswith(("/", "./", "http")) or "://" in v):
        return v.startswith("/") and not re.fullmatch(r"[/\w.-]*", v) and _mixed(v) and not strict
    if re.match(r"(?i)(?:data:|sha\d+[-:]|md5[-:]|ssh-(?:rsa|ed25519)|urn:)", v) or re.search(r"%[sd](?![A-Za-z0-9])|\{\d*\}", v):
        return False
    if re.fullmatch(r"[\w-]+(?:\.[\w-]+)*\(.*\)", v) or re.fullmatch(r"(?:[a-z]+[_./-])*[a-z]+", v) or re.fullmatch(r"[A-Z][A-Z_]+", v) or re.fullmatch(r"[a-zA-Z]+", v) and len(v) < 20:
        return False
    if v.isdigit():
        return not strict and len(v) >= 12
    return _mixed(v) and (not strict or len(set(v)) >= 10)


def _mixed(v: str) -> bool:
    kinds = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    return kinds >= 2 and (any(c.isdigit() for c in v) or kinds >= 3 and len(v) >= 10 and not re.fullmatch(r"[A-Za-z_-]+\W*", v))


def _said(value: str) -> bool:
    """Whether what a comment gives is a secret: usable, of several kinds of characters, and no identifier, file or number."""
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    return kinds >= 3 and usable(value) and not _IDENTIFIER.fullmatch(value)


#: What stands between the parts of a literal that is written over several lines.
SEAM = re.compile(r"""(?:\\[nr])*["'`][ \t]*[+.,\\]?[ \t]*\\?\r?\n[ \t]*[+.]?[ \t]*[rRbBuUfF]?["'`]""")


def _pieces(text: str, a: int, b: int) -> tuple[tuple[int, int], ...]:
    """The parts of a span between its seams."""
    out, at = [], a
    for m in SEAM.finditer(text, a, b):
        out.append((at, m.start()))
        at = m.end()
    return (*out, (at, b))


def _direct(text: str) -> Iterator[tuple[int, int]]:
    for m in TOKENS.finditer(text):
        if not _PLACEHOLDER.match(m.group()):
            yield m.span()
    for m in PEM.finditer(text):
        body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", re.sub(r"(?m)^[A-Za-z-]+: .*$", "", m.group(2)))
        if len(body) >= 40 and len(set(body)) > 12:
            yield m.span()
    for m in REMARK.finditer(text):
        if _said(m.group("value")) and _IN_COMMENT.fullmatch(text, text.rfind("\n", 0, m.start()) + 1, m.start()):
            yield m.span("value")
    for m in ACCOUNT.finditer(text):
        if m.group("user").lower() not in _ABOUT and _said(m.group("value")):
            yield m.span("value")
    for m in URL.finditer(text):
        if len(m.group(2)) >= 4 and not _PLACEHOLDER.match(m.group(2)) and not _REFERENCE.search(m.group(2)) and "{" not in m.group(2):
            yield m.span(2)
    for m in QUERY.finditer(text):
        if name_kind(m.group(1)) == 2 and usable(m.group(2)):
            yield m.span(2)
    for m in HEADER.finditer(text):
        if usable(m.group(1)) and (len(m.group(1)) >= 16 and re.search(r"\d", m.group(1))):
            yield m.span(1)
    for m in QUOTED.finditer(text):
        kind = name_kind(m.group("name"))
        if kind and usable(m.group("value"), strict=kind == 1) and not _hides_nothing(m.group("value")) and m.group("value").lower() != m.group("name").lower():
            yield m.span("value")
    for m in BARE.finditer(text):
        kind = name_kind(m.group("name"))
        if kind and usable(m.group("value"), strict=kind == 1) and not re.search(r"[().]\w*\(|\w\.\w+\.\w+\(|^[a-z_]\w*(?:\.[A-Za-z_]\w*)+;?$|^\w+\[", m.group("value")) and not _hides_nothing(m.group("value")):
            yield m.span("value")


_B64 = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
_PLAIN = re.compile(r"(?:[A-Z][a-z]+)+\d*|[a-z]+(?:[_/-][a-z]+)*[_/-]?\d*|[a-z]+(?:[A-Z][a-z]+)*\d*|[A-Z_]+\d*")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{2}){12,}(?![A-Za-z0-9])")
_PCT = re.compile(r"[\w.~%+@:/!*'()=&?-]*%[0-9a-fA-F]{2}[\w.~%+@:/!*'()=&?-]*")
_ESC = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\}|\\[0-7]{3}|[\w.+/=:@!#$%^&*-])*(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\}|\\[0-7]{3})(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\}|\\[0-7]{3}|[\w.+/=:@!#$%^&*-])*")


def _unescape(s: str) -> str:
    return re.sub(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\u\{([0-9a-fA-F]{1,6})\}|\\([0-7]{3})", lambda m: chr(min(int(m[1] or m[2] or m[3], 16), 0x10FFFF) if not m[4] else int(m[4], 8)), s)


#: A percent sign encoded over and over; all layers at once.
_PERCENTS = re.compile(r"%(?:25)+(?=[0-9a-fA-F]{2})")


def opened(literal: str) -> Iterator[bytes]:
    """What a literal decodes to, by each encoding it can be in."""
    if "\\" in literal and (s := _unescape(literal)) != literal:
        yield s.encode(errors="replace")
    if "%" in literal and (s := unquote(_PERCENTS.sub("%", literal))) != literal:
        yield s.encode(errors="replace")
    if len(literal) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", literal):
        yield bytes.fromhex(literal)
    elif re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", literal):
        try:
            yield base64.b64decode(literal.rstrip("=").translate(str.maketrans("-_", "+/")) + "=" * (-len(literal.rstrip("=")) % 4))
        except (binascii.Error, ValueError):
            pass


def _text(raw: bytes) -> str | None:
    try:
        s = raw.decode()
    except UnicodeDecodeError:
        return None
    return s if len(s) >= 6 and sum(c.isprintable() or c in "\r\n\t" for c in s) == len(s) else None


def _hides_nothing(value: str) -> bool:
    """Whether the value is an encoding of a placeholder or reference."""
    for raw in opened(value):
        s = _text(raw)
        if s and len(s) >= 6 and (_PLACEHOLDER.match(s) or _REFERENCE.search(s)):
            return True
    return False


def der(raw: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at a position, if it is one."""
    if at + 2 > len(raw):
        return None
    tag, n, start = raw[at], raw[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or start + k > len(raw):
            return None
        n, start = int.from_bytes(raw[start : start + k], "big"), start + k
    return (tag, start, start + n) if start + n <= len(raw) else None


def elements(raw: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER elements that fill a range, or None."""
    out, at = [], start
    while at < end:
        e = der(raw, at)
        if not e or e[2] > end:
            return None
        out.append(e)
        at = e[2]
    return out


def openssh(raw: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: magic, cipher, kdf, options, number, public keys, the private part."""
    at, lengths = len(b"openssh-key-v1\0"), []
    if not raw.startswith(b"openssh-key-v1\0"):
        return False

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + n > len(raw):
            return None
        at += 4 + n
        return raw[at - n : at]

    head = [string(), string(), string()]
    if None in head or not re.fullmatch(rb"[a-z0-9@.-]+", head[0]) or not re.fullmatch(rb"[a-z0-9@.-]+", head[1]):
        return False
    number = int.from_bytes(raw[at : at + 4], "big")
    at += 4
    while len(lengths) < number:
        key = string()
        if key is None:
            return False
        lengths.append(len(key))
    private = string()
    return number > 0 and private is not None and len(private) >= 8


def private_container(raw: bytes) -> bool:
    """PKCS#1, SEC1, PKCS#8 plain or encrypted, PKCS#12 and OpenSSH private keys; not SPKI, certificates or requests."""
    if openssh(raw):
        return True
    outer = der(raw)
    if not outer or outer[0] != 0x30 or outer[2] != len(raw):
        return False
    parts = elements(raw, outer[1], outer[2])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    first = raw[parts[0][1] : parts[0][2]]
    if tags[0] == 0x02 and first in (b"\0", b"\1"):
        return len(tags) >= 9 and set(tags[:9]) == {0x02} or tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04]
    if tags[:2] == [0x02, 0x30] and first == b"\3":  # PKCS#12: what its authenticated safe holds is of type data or signed data
        inner = elements(raw, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06 and raw[inner[0][1] : inner[0][2]].startswith(bytes.fromhex("2a864886f70d0107"))
    return tags == [0x30, 0x04] and len(raw) > 40 and (der(raw, parts[0][1]) or (0,))[0] == 0x06


_RUN = {"%": (re.compile(r"%[0-9a-fA-F]{2}"), _PCT), "\\": (re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F{]|[0-7]{3})"), _ESC)}


def _encoded(text: str) -> Iterator[tuple[int, int]]:
    """Spans that may be encoded literals; for percent and escape sequences only the lines that hold some are searched."""
    for m in _B64.finditer(text):
        if not _PLAIN.fullmatch(m.group()) or m.group()[-1] == "=":
            yield m.span()
    for m in _HEX.finditer(text):
        yield m.span()
    for sign, (trigger, pattern) in _RUN.items():
        if sign not in text:
            continue
        at = 0
        while hit := trigger.search(text, at):
            a, b = text.rfind("\n", 0, hit.start()) + 1, text.find("\n", hit.end())
            b = len(text) if b < 0 else b
            yield from ((a + m.start(), a + m.end()) for m in pattern.finditer(text[a:b]))
            at = b


#: A line that holds nothing but a part of an encoded literal, and the first part behind the name it is given to.
_WRAPPED = re.compile(r"""^[ \t]*(?:[+.][ \t]*)?(?P<q>[rRbBuUfF]?["'`])?(?P<value>[A-Za-z0-9+/_-]{16,}={0,2})(?:\\[nr])*(?(q)["'`])[ \t]*[+.,;)\\]*[ \t]*(?:\r?\n|\Z)""", re.M)
_OPENING = re.compile(r"""["'`(|>=: \t](?P<value>[A-Za-z0-9+/_-]{16,})(?:\\[nr])*["'`]?[ \t]*[+.,\\]?[ \t]*\r?\n\Z""")
_CLOSING = re.compile(r"""[ \t]*(?P<value>[A-Za-z0-9+/_-]*={0,2})["'`]""")


def _wrapped(text: str) -> Iterator[tuple[tuple[int, int], ...]]:
    """The parts of encoded literals that go over several lines."""
    run: list[tuple[int, int]] = []
    end = -1
    for m in _WRAPPED.finditer(text):
        if m.start() != end:
            if len(run) > 1:
                yield _whole(text, run, end)
            run, start = [], text.rfind("\n", 0, max(0, m.start() - 1)) + 1
            if m.start() and (first := _OPENING.search(text, start, m.start())):
                run.append(first.span("value"))
        run.append(m.span("value"))
        end = m.end()
    if len(run) > 1:
        yield _whole(text, run, end)


def _whole(text: str, run: list[tuple[int, int]], end: int) -> tuple[tuple[int, int], ...]:
    """A run with what stands before the closing quote on the line behind it."""
    last = _CLOSING.match(text, end)
    return (*run, last.span("value")) if last and last.group("value") else tuple(run)


def _name_before(text: str, at: int) -> str:
    """The name that the literal at a position is given to."""

    def back(i: int, keep: str) -> int:
        while i and text[i - 1] in keep:
            i -= 1
        return i

    def word(i: int) -> int:
        while i and (text[i - 1].isalnum() or text[i - 1] in "_."):
            i -= 1
        return i

    i = back(at, " \t\r\n(")
    if not i or text[i - 1] not in "=:":
        return ""
    sign = text[i - 1]
    i = back(i - 1, " \t") if text[i - 2 : i - 1] != ":" else back(i - 2, " \t")
    i = back(i, "\"'")
    j = word(i)
    k = back(j, " \t")
    if sign == "=" and k and text[k - 1] == ":":  # what stands before the sign is a type
        i = back(back(k - 1, " \t"), "\"'")
        j = word(i)
    return text[j:i]


def _hides(literal: str, work: list[int]) -> bool:
    """Whether a secret comes out of a literal, layer by layer."""
    todo, seen = [literal], {literal}
    while todo:
        now = todo.pop()
        for raw in opened(now):
            work[0] -= len(raw)
            if private_container(raw):
                return True
            s = _text(raw)
            if not s or s in seen:
                continue
            seen.add(s)
            if work[0] < 0 or next(_direct(s), None) or next(_joined(s), None):
                return True
            todo += [s[a:b] for a, b in _encoded(s)]
            todo += ["".join(s[a:b] for a, b in parts) for parts in _wrapped(s)]
    return False


def _joined(text: str) -> Iterator[tuple[tuple[int, int], ...]]:
    """Secrets in literals that are joined, and passwords of logins."""
    for m in JOIN.finditer(text):
        parts = tuple((m.start() + p.start(2), m.start() + p.end(2)) for p in PART.finditer(m.group()))
        value = "".join(text[a:b] for a, b in parts)
        if TOKENS.fullmatch(value) or name_kind(_name_before(text, m.start())) == 2 and usable(value) and not _hides_nothing(value) or _PACKED.fullmatch(value) and _hides(value, _budget(value)):
            yield parts
    for m in LOGIN.finditer(text):
        if usable(m.group(3)):
            yield (m.span(3),)


_PACKED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}|[^\n]*(?:%[0-9a-fA-F]{2}|\\[xu])[^\n]*")


def _budget(literal: str) -> list[int]:
    return [WORK_LEAST + WORK * len(literal)]


def _scan(text: str) -> list[tuple[tuple[int, int], ...]]:
    """The secrets of a text, each as the parts it is written in."""
    found = [_pieces(text, a, b) for a, b in _direct(text)]
    found += _joined(text)
    for a, b in _encoded(text):
        if _hides(text[a:b], _budget(text[a:b])):
            found.append(((a, b),))
    for parts in _wrapped(text):
        value = "".join(text[a:b] for a, b in parts)
        if _hides(value, _budget(value)):
            found.append(parts)
    return found


def scan(text: str | None) -> list[tuple[tuple[int, int], ...]]:
    """Secrets in the order of their starts, each as its parts; those that overlap another are united with it."""
    if not text:
        return []
    out: list[list[tuple[int, int]]] = []
    for parts in sorted(set(_scan(text))):
        if out and parts[0][0] < out[-1][-1][1]:
            last = out[-1]
            for a, b in parts:  # what reaches beyond
                a = max(a, last[-1][1]) if a >= last[-1][0] else a
                if a < b and b > last[-1][1]:
                    if a == last[-1][1]:
                        last[-1] = (last[-1][0], b)
                    else:
                        last.append((max(a, last[-1][1]), b))
        else:
            out.append(list(parts))
    return [tuple(x) for x in out]


def redact(text: str | None, mark: str = "REDACTED", found: list | None = None) -> str | None:
    """The text with each secret replaced by mark; of one in several parts, the first by mark and the others by nothing."""
    if not text:
        return text
    out, at = [], 0
    for parts in scan(text) if found is None else found:
        for i, (a, b) in enumerate(parts):
            out += [text[at:a], "" if i else mark, "".join(re.findall(r"\r?\n", text[a:b]))]  # a block leaves as many lines
            at = b
    return "".join(out) + text[at:]


def find(df: DataFrame, src: str, key: str, text: str) -> DataFrame:
    """(src, row_key string, line_no from 1): the lines on which a secret starts."""

    def make():
        def call(k, t):
            seen = line = last = 0
            for (a, _), *_ in scan(t):
                line += t.count("\n", seen, a)
                seen = a
                if line + 1 != last:
                    last = line + 1
                    yield src, k, last

        return call

    return map_rows(df.select(F.col(key).cast("string").alias("k_"), F.col(text).alias("t_")).where("t_ is not null"), "src string, row_key string, line_no int", make)


def redacted(df: DataFrame, src: str, key: str, text: str) -> DataFrame:
    """(src, row_key, n_secrets, text) of the rows that hold secrets, redacted."""

    def make():
        def call(k, t):
            found = scan(t)
            if found:
                yield src, k, len(found), redact(t, found=found)

        return call

    return map_rows(df.select(F.col(key).cast("string").alias("k_"), F.col(text).alias("t_")).where("t_ is not null"), "src string, row_key string, n_secrets int, text string", make)
