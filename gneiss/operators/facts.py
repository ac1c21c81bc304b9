"""Facts about Python sources by the standard parser, and what follows from them across files.

Files are parsed one by one in Arrow batches; facts are rows. A file that doesn't parse falls back to patterns for its
definitions, so it is never lost.
"""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators.lines import latest

_SCHEMA = "file_id bigint, kind string, name string, line int, end_line int, names array<string>, flag boolean"
_ARROW = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_()]
#: Calls that block an event loop, fixed values.
BLOCKING = frozenset("time.sleep requests.get requests.post requests.put requests.delete requests.patch requests.head urllib.request.urlopen socket.connect socket.recv socket.send subprocess.run subprocess.call subprocess.Popen os.system os.popen".split())
_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)


def facts_of(text: str) -> list[tuple]:
    """(kind, name, line, end line, names, flag): function (parameters, has **kwargs), class (bases, has docstring),
    import (bound names), call (keyword names, has ** argument), handler (empty, is silent), fallback definitions; documented
    (functions: names are the number of statements; has docstring), variable (assigned name), blocking (call in an async function),
    shadowed (parameter that is never read while a settings object gives the same name)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [("function" if m[1] == "def" else "class", m[2], n := text.count("\n", 0, m.start()) + 1, n, [], False) for m in _DEF.finditer(text)]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            out.append(("function", node.name, node.lineno, node.end_lineno, [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)], a.kwarg is not None))
            out.append(("documented", node.name, node.lineno, node.end_lineno, [str(len(node.body))], ast.get_docstring(node) is not None))
            own = {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)} - {"self", "cls"}
            read = {x.id for s in node.body for x in ast.walk(s) if isinstance(x, ast.Name)}
            given = {x.attr for s in node.body for x in ast.walk(s) if isinstance(x, ast.Attribute) and re.search(r"(?i)config|cfg|settings|options", ast.unparse(x.value))}
            out += [("shadowed", node.name, node.lineno, node.end_lineno, [n], False) for n in sorted((own - read) & given)]
            if isinstance(node, ast.AsyncFunctionDef):
                calls = ((x, ast.unparse(x.func)) for s in node.body for x in ast.walk(s) if isinstance(x, ast.Call))
                out += [("blocking", name, x.lineno, x.end_lineno, [node.name], False) for x, name in calls if name in BLOCKING]
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, node.lineno, node.end_lineno, [ast.unparse(b) for b in node.bases], ast.get_docstring(node) is not None))
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            out.append(("variable", node.id, node.lineno, node.end_lineno, [], False))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            module = getattr(node, "module", None) or ""
            out.append(("import", module, node.lineno, node.end_lineno, [x.asname or x.name.split(".")[0] for x in node.names], False))
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
            if name:
                out.append(("call", name, node.lineno, node.end_lineno, [k.arg for k in node.keywords if k.arg], any(k.arg is None for k in node.keywords)))
        elif isinstance(node, ast.ExceptHandler):
            silent = all(isinstance(s, (ast.Pass, ast.Continue)) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in node.body)
            out.append(("handler", ast.unparse(node.type) if node.type else "", node.lineno, node.end_lineno, [], silent))
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """_SCHEMA: the facts of every Python file with content, once per file_id."""
    files = latest(files.select(*[c for c in ("file_id", "file_path", "raw_content", "ingested_at") if c in files.columns]))
    rows = files.where(F.col("raw_content").isNotNull() & (T.language(F.col("file_path")) == "python")).select("file_id", "raw_content")

    def run(batches):
        for b in batches:
            out = [(k, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in facts_of(t)]
            columns = list(zip(*out)) or [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW)], names=["file_id", "kind", "name", "line", "end_line", "names", "flag"])

    return rows.mapInArrow(run, _SCHEMA)


def unknown_keywords(facts: DataFrame) -> DataFrame:
    """(file_id, name, line, keyword): keywords of calls that no function of that name takes, unless one takes any.

    Parameters are rows: however many functions bear a name, nothing is collected per name."""
    own = facts.where("kind = 'function'")
    names = own.groupBy("name").agg(F.max("flag").alias("any"))
    takes = own.select("name", F.explode("names").alias("keyword")).distinct()
    calls = facts.where("kind = 'call' and size(names) > 0 and not flag").select("file_id", "name", "line", F.explode("names").alias("keyword")).distinct()
    return calls.join(names.where("not any").select("name"), "name", "left_semi").join(takes, ["name", "keyword"], "left_anti").select("file_id", "name", "line", "keyword")


def missing_arguments(facts: DataFrame, about: str = r"(?i)size|width|height|(^|_)[xy]$|scale|limit|count") -> DataFrame:
    """(file_id, name, line, parameter): calls that pass some keywords but not a size or place that every function of the name takes."""
    own = facts.where("kind = 'function'")
    many = own.groupBy("name").agg(F.count("*").alias("n"))
    takes = own.select("name", F.explode("names").alias("parameter")).where(F.col("parameter").rlike(about)).groupBy("name", "parameter").agg(F.count("*").alias("k")).join(many, "name").where("k = n").select("name", "parameter")
    calls = facts.where("kind = 'call' and size(names) > 0 and not flag").select("file_id", "name", "line", "names")
    return calls.join(takes, "name").where(~F.array_contains("names", F.col("parameter"))).select("file_id", "name", "line", "parameter").distinct()


def undocumented_functions(facts: DataFrame, above: int = 2) -> DataFrame:
    """(file_id, name, line): public functions of more than two statements without a docstring."""
    return facts.where("kind = 'documented' and not flag").where(~F.startswith("name", F.lit("_")) & (F.col("names")[0].cast("int") > above)).select("file_id", "name", "line")


def single_letters(facts: DataFrame, fine: tuple[str, ...] = ("i", "j", "k", "n", "x", "y", "_", "e", "f")) -> DataFrame:
    """(file_id, name, line): variables of one letter that are not customary."""
    return facts.where("kind = 'variable'").where((F.length("name") == 1) & ~F.col("name").isin(*fine)).select("file_id", "name", "line").distinct()


def class_names(facts: DataFrame) -> DataFrame:
    """(file_id, name, line, suggestion): classes that begin with a small letter."""
    return facts.where("kind = 'class'").where(F.col("name").rlike("^[a-z]")).select("file_id", "name", "line", F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)")).alias("suggestion"))


def blocking_calls(facts: DataFrame) -> DataFrame:
    """(file_id, name, line, inside): calls that block, inside asynchronous functions."""
    return facts.where("kind = 'blocking'").select("file_id", "name", "line", F.col("names")[0].alias("inside")).distinct()


def shadowed_parameters(facts: DataFrame) -> DataFrame:
    """(file_id, name, line, parameter): parameters that are ignored for a setting of the same name."""
    return facts.where("kind = 'shadowed'").select("file_id", "name", "line", F.col("names")[0].alias("parameter"))


def unused_helpers(facts: DataFrame) -> DataFrame:
    """(file_id, name, line): private functions that nothing calls by name."""
    called = facts.where("kind = 'call'").select("name").distinct()
    return facts.where("kind = 'function'").where(F.col("name").rlike("^_[^_]")).join(called, "name", "left_anti").select("file_id", "name", "line")


def undocumented_classes(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'class' and not flag").where(~F.startswith("name", F.lit("_"))).select("file_id", "name", "line")


def silent_handlers(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'handler' and flag").select("file_id", "line")


def repair_json(text: str | None) -> str | None:
    """The longest beginning of a cut JSON text, completed by closing what is open; None where nothing can be saved."""
    if not text:
        return None
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    decoder = json.JSONDecoder()
    try:
        return json.dumps(decoder.raw_decode(text, start)[0], ensure_ascii=False)
    except ValueError:
        pass
    stack, quoted, escaped, saved = [], False, False, []
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
            if quoted:
                continue
        elif c == '"':
            quoted = True
            continue
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                break
        if not quoted and (c in '}],"' or c.isalnum()):
            saved.append((i + (c != ","), "".join(reversed(stack))))
    for end, closing in reversed(saved[-400:]):
        try:
            return json.dumps(json.loads(text[start:end].rstrip().rstrip(",") + closing), ensure_ascii=False)
        except ValueError:
            continue
    return None


_TAG = r"<(button|a|input|select|form)\b([^>]*)>([^<]{0,80})"


def html_controls(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, tag, label, handled): controls of HTML pages, and whether they have a handler, address or type submit."""
    found = F.explode(F.regexp_extract_all(html, F.lit(_TAG), F.lit(0)))
    rows = pages.where(F.col(html).isNotNull()).select(key, found.alias("m"))
    attributes = F.regexp_extract("m", _TAG, 2)
    return rows.select(key, F.regexp_extract("m", _TAG, 1).alias("tag"), F.trim(F.regexp_extract("m", _TAG, 3)).alias("label"), attributes.rlike(r"(?i)\bon\w+\s*=|href\s*=\s*[\"'][^\"'#]|type\s*=\s*[\"']submit").alias("handled"))
