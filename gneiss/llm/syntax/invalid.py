"""Problem 3: source files that do not parse.

Every file is read by the lexer of its extension's language and parsed once with all dialects of that language together;
a file rejected by every dialect that the extension allows is flagged, with the line of the furthest token reached. What a
grammar accepts is then checked for the early errors of that dialect, over its tokens.

Defined cases: null content is not judged; an empty Python, JavaScript, TypeScript or Java file is valid, an empty Go or
JSON one is not; extensions without a grammar are never flagged; a file delivered twice counts once; whole files are
parsed, whatever their length. A parse error of the lexer is an error of the file, never of the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.batches import map_rows
from gneiss.llm.syntax import early, grammars, lexers
from gneiss.llm.syntax.gll import recognise

#: Language and allowed dialects by extension.
EXTENSIONS = {
    "py": ("python", ("python3",)),
    "js": ("javascript", ("module",)),
    "mjs": ("javascript", ("module",)),
    "cjs": ("javascript", ("sloppy", "module")),
    "ts": ("javascript", ("ts",)),
    "go": ("go", ("go",)),
    "java": ("java", ("java",)),
    "json": ("json", ("strict",)),
}


def parse(text: str, language: str) -> tuple[tuple[str, ...], int, str]:
    """(dialects of the language that accept, line of the error or 0, what is wrong)."""
    lexer, _, dialects, _ = grammars.LANGUAGES[language]
    grammar = grammars.grammar(language)
    try:
        tokens, places = lexer(text)
    except lexers.Bad as bad:
        return (), text.count("\n", 0, bad.at) + 1, bad.why
    mask, far = recognise(grammar, tokens)
    accepted, first = [], None
    for d in dialects:
        if mask & grammar.bits[d]:
            wrong = early.error(language, d, tokens, places, text)
            first = first or wrong
            if not wrong:
                accepted.append(d)
    if accepted or first:
        return tuple(accepted), text.count("\n", 0, first[0]) + 1 if first else 0, first[1] if first else ""
    at = places[far] if far < len(places) else len(text)
    return (), text.count("\n", 0, at) + 1, f"unexpected {tokens[far].rstrip('~')}" if far < len(tokens) else "unexpected end"


def check(text: str, extension: str) -> tuple[bool, tuple[str, ...], int, str]:
    """(valid, dialects that accept, line, why)."""
    language, allowed = EXTENSIONS[extension]
    accepted, line, why = parse(text, language)
    valid = bool(set(accepted) & set(allowed))
    if valid:
        return True, accepted, 0, ""
    return valid, accepted, line, why if why else "only valid as " + ", ".join(accepted)


def judged(files: DataFrame) -> DataFrame:
    """(file_id, repo, extension, valid, dialects, line, why) of every file with content and a grammar, once per file_id."""
    rows = files.select("file_id", "repo", F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1)).alias("e_"), F.col("raw_content").alias("t_"))
    rows = rows.where(F.col("t_").isNotNull() & F.col("e_").isin(*EXTENSIONS))

    def make():
        def call(key, repo, extension, text):
            yield (key, repo, extension, *check(text, extension))

        return call

    found = map_rows(rows, "file_id bigint, repo string, extension string, valid boolean, dialects array<string>, line int, why string", make, heavy=True)
    return found.dropDuplicates(["file_id"])


def rates(found: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, share) with totals by repo, by language and over all (nulls)."""
    kinds = {e: "typescript" if e == "ts" else lang for e, (lang, _) in EXTENSIONS.items()}
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return (
        found.withColumn("language", names[F.col("extension")])
        .cube("repo", "language")
        .agg(F.count("*").alias("n_files"), F.sum((~F.col("valid")).cast("int")).alias("n_invalid"), F.avg((~F.col("valid")).cast("double")).alias("share"))
    )
