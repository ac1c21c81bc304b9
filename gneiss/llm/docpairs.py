"""Problem 6: functions paired with their documentation.

Every function and method becomes a row of a symbol table: repository, package, qualified name, normalised signature,
whether it has a body, and its documentation, which is the docstring or, where that says nothing, the documentation
comment in its code. Definitions are joined with the documented declarations that stand apart from them (overload
signatures, interface methods, stubs): those of the same package, qualified name and signature, else the only declaration
of that name and signature in the repository. The documentation that belongs to the function itself comes first. What the
joined rows then hold passes the filter of meaning, or the row is dropped.

A package is the folder in Go and Java, and the file without its extension (.py and .pyi, .ts and .d.ts alike) elsewhere.
Signatures are the types of the parameters, or their names where there are none, without spaces, defaults, modifiers,
annotations, quotes and the packages of types; a list of names before one type counts once per name.

Defined cases: null code, names and docstrings are read as empty; repeated rows give one pair; chunk types count in any
case and with spaces around; other chunks are left out; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.batches import map_rows
from gneiss.session import cut

MIN_WORDS, MIN_CJK = 5, 10
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")
_WORD = re.compile(r"[^\W\d_](?:[\w'’-]*[^\W_])?")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+|\d+")
#: Tags of documentation comments; of these lines only the description counts.
_TAG = re.compile(r"^\s*(?:[@\\]\w+|:\w+(?:\s+[\w.\[\]]+){0,2}:)")
_TAG_HEAD = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|property|prop|throws|exception|raises|typedef|template)\s+(?:\{[^}]*\}\s*)?[\[\w.\]=$]+|[@\\]\w+(?:\s*\{[^}]*\})?|:(?:param|type|raises|keyword|arg)(?:\s+\w+)?\s+[\w.*]+:|:\w+:)\s*[-:–]?\s*")
_SECTION = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Attributes|参数|返回|引数|戻り値)\s*:?\s*$|^\s*-{3,}\s*$")
_PARAM_LINE = re.compile(r"^\s*[*\w.]+(?:\s*\([^)]*\))?\s*:\s*")
#: Wording that only marks that something is to be written or is inherited.
_STUB = re.compile(
    r"(?i)^\W{0,40}(?:todo|fixme|tbd|xxx|wip|to be (?:written|done|documented|added|defined)|documentation (?:goes here|pending|missing)|auto[- ]?generated|generated (?:stub|method|by)|(?:please )?(?:replace|fill|add|write|insert|edit|change) (?:this|in|me|the|your|a)\b.*\b(?:stub|text|documentation|docs?|docstring|description|comment|later|here|placeholder|template)|no (?:description|documentation|docs?|comment)|not (?:yet )?(?:documented|implemented|written)|undocumented|missing (?:doc|documentation|description)|see (?:the )?(?:base|super|parent|above|below|interface)|inherit(?:s|ed)?\b|\{@inheritdoc\}|@inheritdoc|same as (?:above|base|super|parent)|placeholder|stub\b|lorem ipsum|description (?:goes )?here|docstring|<[^<>]{0,80}(?:description|summary|insert)[^<>]{0,80}>)"
)
_EMPTY_WORDS = set("a an the this that these it its of for to and or in on at by with from is are be was will does do did can may used use uses using method function procedure routine helper utility class constructor simple simply just given current which when as via into here our we getter setter property accessor implementation called call calls".split())


def _lines(doc: str) -> list[str]:
    """What a documentation says without the heads of its tags."""
    out, section = [], False
    for line in doc.replace("\r", "").split("\n"):
        if _SECTION.match(line):
            section = True
            continue
        if _TAG.match(line):
            line = _TAG_HEAD.sub("", line, count=1)
        elif section:
            if not line.strip():
                section = False
            line = _PARAM_LINE.sub("", line, count=1)
        out.append(line)
    return out


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ies", "es", "s", "ing", "ed"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)] + ("y" if end == "ies" else "")
    return w


def meaningful(doc: str | None, name: str | None) -> bool:
    """Whether a documentation says something that the function's name does not."""
    if not doc or not doc.strip():
        return False
    body = "\n".join(_lines(doc)).strip()
    if _STUB.match(body) or not body:
        return False
    last = re.split(r"[.:#/]", name or "")[-1]
    if last and body.startswith(last + " "):
        body = body[len(last) :]
    if len(_CJK.findall(body)) >= MIN_CJK and len(_CJK.findall(body)) * 2 >= len(re.findall(r"\w", body)):
        return True
    words = [w for w in _WORD.findall(body) if not _CJK.search(w)]
    if len(words) < MIN_WORDS:
        return False
    known = {_stem(p) for p in _PARTS.findall(name or "")}
    said = {_stem(p) for w in words for p in _PARTS.findall(w) or [w]} - known
    return bool(said - {_stem(w) for w in _EMPTY_WORDS})


_LANGUAGE = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java"}
_BLOCK = re.compile(r"/\*+(.*?)\*/", re.S)
_ANNOTATION = re.compile(r"@[\w.]+(?:\([^()]*\))?[ \t]*(?:\r?\n|$)?|#\[[^\]]*\]\s*|(?:\r?\n)")
_PYDEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*(?:\[[^\]]*\])?", re.M)
_PYSTRING = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*[rRuU]?(\"\"\"|'''|\"|')")


def _unstar(comment: str) -> str:
    return "\n".join(re.sub(r"^[ \t]*\*? ?", "", line.rstrip()) for line in comment.split("\n")).strip()


def _after_signature(code: str, at: int) -> int:
    """The position behind a Python signature's colon."""
    depth, i, n = 0, at, len(code)
    quote = ""
    while i < n:
        c = code[i]
        if quote:
            if c == "\\":
                i += 1
            elif code.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
        elif c in "\"'":
            quote = c * 3 if code.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c == "#":
            i = code.find("\n", i)
            if i < 0:
                return n
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth <= 0:
            return i + 1
        i += 1
    return n


def comment_of(code: str, language: str) -> str:
    """The documentation comment in a function's code: a Python docstring, else the comment right before the declaration."""
    if language == "python":
        m = _PYDEF.search(code)
        if not m:
            return ""
        s = _PYSTRING.match(code, _after_signature(code, m.end()))
        if not s:
            return ""
        end = re.compile(r"(?:\\.|(?!" + s.group(1) + r")[\s\S])*").match(code, s.end()).end()
        first, _, rest = code[s.end() : end].partition("\n")
        return (first.strip() + "\n" + textwrap.dedent(rest)).strip()
    at, doc, gap = 0, "", 0
    while True:
        m = re.compile(r"[ \t]*(\r?\n)?").match(code, at)
        gap = gap + 1 if m.group(1) else gap
        at = m.end()
        if code.startswith("//", at):
            end = code.find("\n", at)
            end = len(code) if end < 0 else end
            line = re.sub(r"^//[/!]? ?", "", code[at:end].rstrip())
            doc = doc + "\n" + line if doc and gap <= 1 and run else line
            run, gap, at = True, 0, end
        elif b := _BLOCK.match(code, at):
            doc, run, gap, at = _unstar(b.group(1)), False, 0, b.end()
        elif m.group(1):
            continue
        elif code.startswith("@", at) and (a := re.compile(r"@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?").match(code, at)):
            at, gap = a.end(), 0
        else:
            return "" if gap > 1 else doc.strip()  # a comment apart from the declaration isn't its own


#: Brackets of a signature; angles are some only where types have parameters in them.
_ROUND, _ANGLED = ("([{", ")]}"), ("([{<", ")]}>")


def _brackets(language: str) -> tuple[str, str]:
    return _ANGLED if language in ("java", "typescript") else _ROUND


def _parts(text: str, at: int, brackets: tuple[str, str]) -> tuple[list[str], int]:
    """(the parts between commas of the brackets that open at a position, the position behind them); -1 if they don't close."""
    opens, closes = brackets
    depth, quote, parts, start, i = 0, "", [], at + 1, at
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in opens:
            depth += 1
        elif c in closes and not (c == ">" and text[i - 1] in "=-"):
            depth -= 1
            if depth == 0:
                return [*parts, text[start:i]], i + 1
        elif c == "," and depth == 1:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    return [], -1


def _before(text: str, sign: str, brackets: tuple[str, str]) -> str:
    """What stands before a sign outside brackets and strings."""
    opens, closes = brackets
    depth, quote = 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in opens:
            depth += 1
        elif c in closes and not (c == ">" and text[i - 1 : i] in ("=", "-")):
            depth -= 1
        elif c == sign and depth == 0 and text[i + 1 : i + 2] != ">":
            return text[:i]
    return text


def _type(text: str) -> str:
    """A type without spaces, quotes and the packages of its names."""
    return re.sub(r"(?:[^\W\d]\w*\.)+(?=[^\W\d])", "", re.sub(r"[\s\"']+", "", text))


def _kinds(parts: list[str], language: str) -> list[str]:
    out: list[str] = []
    brackets = _brackets(language)
    if language == "go":
        named = [p.split(None, 1) for p in parts if p.strip()]
        if any(len(p) == 2 and not p[0].endswith((".", "chan", "func")) for p in named):
            kind = ""
            for p in reversed(named):  # names before one type share it
                kind = p[1] if len(p) == 2 else kind
                out.append(_type(kind))
            return out[::-1]
        return [_type(" ".join(p)) for p in named]
    for part in parts:
        part = re.sub(r"(?:@[\w.]+(?:\([^()]*\))?\s+|\b(?:final|public|private|protected|readonly|override)\s+)*", "", _before(part, "=", brackets).strip(), count=1)
        if not part or part in ("self", "cls", "*", "/", "this") or language == "typescript" and part.startswith("this:"):
            continue
        if language == "java":
            kind = re.sub(r"\s*\.\.\.\s*", "[] ", part).rpartition(" ")[0] or part
        else:
            name = _before(part, ":", brackets)
            kind = part[len(name) + 1 :] or name.rstrip("?")
        out.append(_type(kind))
    return out


def signature(code: str, language: str, name: str) -> tuple[str, bool]:
    """(normalised parameter types, whether there is a body)."""
    last = re.escape(re.split(r"[.:#/]", name)[-1])
    m = re.search(r"\b" + last + r"\s*(?:<[^<>]*>|\[[^\]]*\])?\s*(?=\()", code) if last else None
    if not m:
        return "", True
    parts, end = _parts(code, m.end(), _brackets(language))
    if end < 0:
        return "", True
    rest = code[end:]
    body = "{" in rest if language != "python" else not re.fullmatch(r"[^:]*:\s*(?:[rRuU]?\"\"\"[\s\S]*?\"\"\"|[rRuU]?\'\'\'[\s\S]*?\'\'\')?\s*(?:\.\.\.|raise NotImplementedError(?:\([^()]*\))?)?\s*", rest)
    return ",".join(_kinds(parts, language)), body


def package_of(path: str, language: str) -> str:
    folder, _, file = path.replace("\\", "/").rpartition("/")
    if language in ("go", "java"):
        return folder
    return folder + "/" + re.sub(r"(?:\.d)?\.\w+$", "", file)


def declarations(chunks: DataFrame) -> DataFrame:
    """The symbol table, one row per chunk row of a function or method: (chunk_id, repo, package, symbol, signature, has_body, doc,
    doc_from, says: whether the documentation is meaningful)."""
    rows = chunks.where(F.lower(F.trim("chunk_type")).isin("function", "method")).select("chunk_id", "file_path", F.coalesce("name", F.lit("")).alias("n_"), F.coalesce("code", F.lit("")).alias("c_"), F.coalesce("docstring", F.lit("")).alias("d_"))

    def make():
        def call(key, path, name, code, docstring):
            path = path or ""
            language = _LANGUAGE.get(path.rpartition(".")[2].lower(), "")
            doc, origin = docstring.strip(), "docstring"
            says = meaningful(doc, name)
            if not says:
                doc, origin = comment_of(code, language) or doc, "comment"
                says = meaningful(doc, name)
            kinds, body = signature(code, language, name)
            yield key, path.partition("/")[0], package_of(path, language), name, kinds, body, doc or None, origin, says

        return call

    return map_rows(rows, "chunk_id string, repo string, package string, symbol string, signature string, has_body boolean, doc string, doc_from string, says boolean", make)


def pairs(chunks: DataFrame, with_code: bool = True) -> DataFrame:
    """(chunk_id, symbol, signature, doc, doc_from, code), one row per chunk_id with meaningful documentation."""
    found = cut(declarations(chunks))  # narrow, and read several times below
    key = ["repo", "symbol", "signature"]
    apart = found.where("not has_body and says and symbol <> ''").groupBy(*key, "package").agg(F.min("doc").alias("near"))
    sole = apart.groupBy(*key).agg(F.min("near").alias("far"), F.count("*").alias("n_")).where("n_ = 1").drop("n_")
    # a definition that speaks for itself needs no other; the rest meets the declarations that stand apart
    silent = found.where("has_body and not says")
    lent = silent.join(apart, [*key, "package"], "left").join(sole, key, "left").withColumn("declared", F.coalesce("near", "far"))
    joined = found.where("not has_body or says").withColumn("declared", F.lit(None).cast("string")).unionByName(lent.drop("near", "far"))
    doc = F.when(F.col("says"), F.col("doc")).otherwise(F.col("declared"))
    origin = F.when(F.col("says"), F.col("doc_from")).otherwise(F.lit("declaration"))
    out = joined.where("says or declared is not null").select("chunk_id", "symbol", "signature", doc.alias("doc"), origin.alias("doc_from")).dropDuplicates(["chunk_id"])
    if with_code:
        out = out.join(chunks.select("chunk_id", F.coalesce("code", F.lit("")).alias("code")), "chunk_id").dropDuplicates(["chunk_id"])
    return out
