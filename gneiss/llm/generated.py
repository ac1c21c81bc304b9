"""Problem 1: files that nobody wrote by hand.

A random forest over compression ratio, token entropy, identifier lengths, comment density and other measures of a
file's text, and over signs of its path, decides on every file. Its labels are header notices (of tools, of minifiers, of
third-party copies, of lock files), and the comments at the head of every file are hidden from its measures; files
that hold nothing but literals bear no notice and are labelled by that. The signs of a path are folders of third-party copies
and of build products, names of lock files and of tools' output, and folders named after a library that the notices
of other files name; a file's own notice is not among them.

Files without a label are not all written by hand, so the forest is fitted twice: the second time without those unlabelled
files that the first forest doubts. It is fitted on at most OTHERS files of either label, those with the smallest hashes of
their ids; with fewer than LEAST labels of a kind there is no forest, and labels and paths decide.

Defined cases: null and empty content is judged by its path; a file delivered twice counts once; file paths may
use either separator; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import lexing
from gneiss.llm.batches import hashed, map_rows
from gneiss.session import cut

#: Files of either label that the forest is fitted on at most, fewest labels of a kind, trees and their depth.
OTHERS, LEAST, TREES, DEPTH = 20_000, 4, 80, 10
#: Likelihood from which a file is a case, and from which an unlabelled file is left out of the second fit. Below a half,
#: for cases among the files without a label lower it; on four tables the results are the same from 0.2 to 0.3.
THRESHOLD = DOUBT = 0.25
_DOCSTRING = re.compile(r"""[rRuU]?(\"{3}|'{3})""")

_TOOL = re.compile(
    r"(?i)@generated\b|\b(?:code|file|source|class|this file|output)?\s*(?:was |is |been )?(?:automatically|auto|machine)[- ]?(?:generated|written|created|produced)\b|\bcode generated by\b|\bgenerated (?:by|with|from|using) (?:the )?[\w.-]+.*(?:compiler|do not|edit|overwrit|changes|lost|\Z)"
    r"|\bdo not (?:edit|modify|change)\b|\bchanges (?:will be|are) (?:lost|overwritten|discarded)\b|\bnicht von hand (?:ändern|bearbeiten)|\b(?:automatisch )?erzeugt (?:mit|von|durch)\b|\bne pas modifier\b|\b(?:produit|généré|engendré)e? (?:automatiquement )?par\b|\bno (?:modificar|editar)\b|\bgenerado (?:automáticamente )?(?:por|con)\b|\bnão (?:modificar|editar|altere)\b|\bgerado (?:automaticamente )?(?:por|com)\b|自动生成|請勿|请勿(?:手工|手动)?(?:修改|编辑)|自動生成|編集しないで|(?:сгенерирован|создан)\w* (?:автоматически|программой|утилитой)|не (?:редактировать|изменять|править)"
)
_COPY = re.compile(
    r"(?i)\bupstream copy\b|\bpart of the ([\w.-]{1,80}) project, (?:release|version) v?\d|^\W{0,40}([\w.-]{1,80}) v?\d+\.\d+(?:\.\d+)?\b.*(?:https?://|\breleased under\b|\blicen[cs]e[ds]?\b|\bupstream\b|\(c\))|\bvendored (?:from|copy)\b|\bcopied (?:verbatim )?from (?:https?://|upstream)|\bthird[- ]party copy\b"
)
_LIBRARY = re.compile(r"(?i)\bpart of the ([\w.-]{1,80}) project\b|^\W{0,40}([a-z][\w.-]{0,80}?) v?\d+\.\d+(?:\.\d+)?\b")
_BANNER = re.compile(r"/\*!\s*([\w.-]+) v?\d+\.\d+[\w.]*\s*(?:\||\*/|-)")
#: Folders of third-party copies, fixed values; a folder below one of these is one library.
FOLDERS = r"(?:^|/)(?:vendor|_vendor|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|externals?|static/libs?|site-packages|jspm_packages|Pods)/[^/]+/"
PRODUCTS = r"(?:^|/)(?:dist|build/(?:lib|out|static|js)|target/classes|out/production)/[^/]+\.(?:js|mjs|css|map)$|\.(?:min|bundle|chunk)\.(?:js|mjs|css)$"
TOOL_FILES = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.go|\.pb\.(?:cc|h)|\.g\.dart|\.(?:gen|generated)\.\w+|_generated\.\w+|Grpc\.java)$|(?:^|/)(?:__generated__|gen-src|generated-sources?|generated|gen)/"
LOCKS = r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|poetry\.lock|Pipfile\.lock|composer\.lock|Cargo\.lock|go\.sum)$|[-.]lock\.json$"
_LOCK = re.compile(r'^\s*\{\s*"(?:lockfile_?version|lockversion|_meta|dependencies_hash)"\s*:|^# (?:This file is automatically @generated|yarn lockfile)', re.I)

FEATURES = (
    "compression", "token_entropy", "identifier_mean", "identifier_deviation", "identifier_distinct", "comment_density", "line_mean", "line_longest",
    "digits", "distinct_lines", "distinct_shapes", "blank", "longest_literal", "literal_share", "indents", "keywords", "upper", "symbols", "length", "code_left",
)
#: Code that does something, which a file of data has none of.
_DOES = re.compile(r"\b(?:def|function|func)\b\s*[\w(]|=>|\)\s*(?:throws [\w, .]+)?\{")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_NAME = re.compile(r"[^\W\d]\w*")
_FLOW = frozenset("if else elif for while return try catch except finally switch case break continue throw raise await yield".split())
_LITERAL = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
_PACKED = re.compile(r"(?m)^[ \t]*[A-Za-z0-9+/=_-]{40,}[ \t]*\r?$")  # a line of a literal that goes over many
_NUMBERS = re.compile(r"(?:-?\b\d[\w.]*\b\s*,?\s*)+")


def head(text: str) -> tuple[list[str], str]:
    """(the lines of the comments and the docstring at the head of a file, what follows them)."""
    lines = text.split("\n")
    out, i, block, quotes, documented = [], 0, False, "", False
    while i < len(lines):
        s = lines[i].strip()
        if quotes or not (block or documented) and (m := _DOCSTRING.match(s)):
            if not quotes:
                quotes, s = m.group(1), s[m.end() :]
                documented = True
            end = s.find(quotes)
            out.append(s if end < 0 else s[:end])
            if end >= 0:
                s, quotes = s[end + 3 :].strip(), ""
                if s and not s.startswith("#"):
                    lines[i] = s
                    break
        elif block:
            out.append(s.strip("*/ "))
            block = "*/" not in s
        elif s.startswith("/*"):
            end = s.find("*/")
            if end >= 0 and s[end + 2 :].strip():
                out.append(s[: end + 2])
                lines[i] = s[end + 2 :]
                break
            out.append(s)
            block = end < 0
        elif s.startswith(("#", "//", "--", ";")):
            out.append(s)
        elif s:
            break
        i += 1
    return out, "\n".join(lines[i:])


def notice(text: str) -> tuple[str, str]:
    """(tool, minified, copy, lock or '', the library that a notice names or '')."""
    comments, _ = head(text)
    for line in comments:
        if m := _BANNER.search(line):
            return "minified", m.group(1)
    for line in comments:
        if _COPY.search(line):
            m = _LIBRARY.search(line)
            return "copy", (m.group(1) or m.group(2) or "") if m else ""
        if _TOOL.search(line):
            return "tool", ""
    return "", ""


def measures(text: str, language: str) -> list[float]:
    """FEATURES of a file without the comments at its head."""
    _, body = head(text)
    if not body.strip():
        return [0.0] * len(FEATURES)
    raw = body.encode(errors="replace")
    n = len(body)
    tokens = _TOKEN.findall(body)
    counts = Counter(tokens)
    total = max(1, len(tokens))
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    names = _NAME.findall(body)
    sizes = [len(x) for x in names] or [0]
    mean = sum(sizes) / len(sizes)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes))
    comments = sum(b - a for kind, a, b in lexing.spans(body, language) if kind in ("line", "block"))
    lines = body.split("\n")
    full = [x for x in lines if x.strip()] or [""]
    shapes = {re.sub(r"\d+", "0", re.sub(r"[^\W\d]\w*", "a", x.strip())) for x in full}
    literals = [len(m) for _, m in _LITERAL.findall(body)]
    numbers = sum(len(m) for m in _NUMBERS.findall(body) if len(m) > 20)
    packed = sum(x for x in literals if x >= 40) + numbers + sum(map(len, _PACKED.findall(body)))
    left = n - packed - sum(c.isspace() for c in body)
    return [
        len(zlib.compress(raw, 6)) / len(raw), entropy, mean, deviation, len(set(names)) / max(1, len(names)), comments / n, n / len(lines), math.log1p(max(map(len, full))),
        sum(c.isdigit() for c in body) / n, len(set(full)) / len(full), len(shapes) / len(full), 1 - len(full) / len(lines), max(literals, default=0) / n, min(1.0, packed / n),
        len({len(x) - len(x.lstrip()) for x in full}) / 10, sum(counts[w] for w in _FLOW) / total, sum(c.isupper() for c in body) / n, sum(not c.isalnum() and not c.isspace() for c in body) / n, math.log1p(n), math.log1p(max(0, left)),
    ]


def only_data(text: str, language: str, m: list[float]) -> bool:
    """Whether a file of source holds next to nothing but literals."""
    if language in ("json", ""):
        return False
    return m[FEATURES.index("literal_share")] > 0.7 and m[FEATURES.index("keywords")] < 0.002 and not _DOES.search(head(text)[1])


def described(files: DataFrame) -> DataFrame:
    """(file_id, path, notice, library, data, features array) of every file, once per file_id."""
    rows = files.select("file_id", F.coalesce(F.regexp_replace("file_path", r"\\", "/"), F.lit("")).alias("p_"), F.coalesce("raw_content", F.lit("")).alias("t_"))

    def make():
        def call(key, path, text):
            language = lexing.language_of(path)
            kind, library = notice(text)
            if not kind and _LOCK.search(head(text)[1]):
                kind = "lock"
                text = text.partition("\n")[2] if "\n" in text else text  # the line that says so is hidden
            m = measures(text, language)
            yield key, path, kind, library.lower(), only_data(text, language, m), m

        return call

    return map_rows(rows, "file_id bigint, path string, notice string, library string, data boolean, features array<double>", make, heavy=True).dropDuplicates(["file_id"])


def signed(found: DataFrame) -> DataFrame:
    """found with the signs of its path among its features; the library a file itself names counts if another names it too."""
    libraries = found.where("notice in ('copy', 'minified') and library <> ''").groupBy(F.col("library").alias("l_")).agg(F.count("*").alias("n_"))
    # names are joined, not collected
    segments = F.split(F.lower("path"), "/")
    below = F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0)))
    folders = found.select("file_id", "library", F.explode(F.array_distinct(F.transform(below, lambda x: F.regexp_replace(x, r"[-_@]v?\d+(?:\.\d+)*$", "")))).alias("l_"))
    named = folders.join(libraries, "l_").where(F.col("n_") > (F.col("l_") == F.col("library")).cast("int")).select("file_id").distinct().withColumn("named", F.lit(True))
    signs = [by_path() == "copy", by_path() == "product", by_path() == "lock", F.col("path").rlike(TOOL_FILES), F.coalesce("named", F.lit(False))]
    found = found.join(named, "file_id", "left")
    return found.withColumn("features", F.concat("features", F.array(*[x.cast("double") for x in signs]))).withColumn("named", signs[-1])


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", array_to_vector("features"))


def by_path():
    """What the path alone says."""
    path = F.col("path")
    return F.when(path.rlike(FOLDERS), "copy").when(path.rlike(PRODUCTS), "product").when(path.rlike(LOCKS), "lock").otherwise("")


def _forest(tools: DataFrame, others: DataFrame) -> RandomForestClassificationModel | None:
    both = tools.select("features", F.lit(1.0).alias("label")).unionByName(others.select("features", F.lit(0.0).alias("label")))
    sizes = {r["label"]: r["n"] for r in both.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(0.0, 0), sizes.get(1.0, 0)) < LEAST:
        return None
    rows = _vectors(both).withColumn("weight", F.when(F.col("label") == 1, F.lit(max(1.0, sizes[0.0] / sizes[1.0]))).otherwise(1.0))
    return RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.8).fit(rows)


def _rated(model: RandomForestClassificationModel, found: DataFrame) -> DataFrame:
    return model.transform(_vectors(found)).withColumn("likelihood", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def fit(found: DataFrame) -> RandomForestClassificationModel | None:
    """The forest, or None where labels are too few."""
    labelled = (F.col("notice") != "") | F.col("data")
    telling = labelled | (by_path() != "") | F.col("path").rlike(TOOL_FILES) | F.col("named")
    tools = cut(hashed(found.where(labelled), "file_id", OTHERS).select("features"))
    others = cut(hashed(found.where(~telling), "file_id", OTHERS).select("features"))
    first = _forest(tools, others)
    return first and _forest(tools, _rated(first, others).where(F.col("likelihood") < DOUBT)) or first


def judged(files: DataFrame) -> DataFrame:
    """(file_id, path, by_hand boolean, why, likelihood) of every file; why names what else speaks for a case, or the look alone."""
    found = cut(signed(cut(described(files))))  # a few numbers a file, read by several jobs below
    model = fit(found)
    speaks = F.when(F.col("notice") != "", F.col("notice")).when(by_path() != "", by_path()).when(F.col("named"), F.lit("copy")).when(F.col("data"), F.lit("data")).otherwise("")
    if model is None:
        found = found.withColumn("likelihood", F.lit(None).cast("double"))
        why = speaks
    else:
        found = _rated(model, found)
        why = F.when(F.col("likelihood") < THRESHOLD, "").when(speaks != "", speaks).otherwise("look")
    return found.select("file_id", "path", (why == "").alias("by_hand"), why.alias("why"), "likelihood")


def nodes_judged(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, file_id, by_hand, why): the nodes whose file_path, however written, names a judged file."""
    path = F.regexp_replace(F.regexp_replace("file_path", r"\\+", "/"), r"^(?:\./|/)+", "")
    clean = found.select("file_id", "by_hand", "why", F.col("path").alias("clean"))
    own = nodes.select("id", path.alias("clean")).where("clean <> ''")
    return own.join(clean, "clean").select("id", "file_id", "by_hand", "why").distinct()
