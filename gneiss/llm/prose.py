"""Problem 4: natural language inside code, by compression.

Comments (neighbouring lines together), string literals and docstrings are split into sentences; sentences of enough
words are encoded with one zstandard dictionary per language, built from labelled documents and docstrings, and one built from code.
The shortest encoding wins, and must beat that of code, which statements of SQL are part of, by a margin, else the span is code
and not text; nothing but the sizes of the encodings decides that, in every script and whatever the punctuation.

The dictionaries are fitted on SAMPLE documents and SAMPLE chunks, those with the smallest hashes of their ids, and of
each language at most DICTIONARY bytes. Sentences whose words speak for another language than the document's label, as
in documents of several languages or with a wrong label, are left out; docstrings get the language of their words.

Defined cases: null code and docstrings hold nothing; labels count in any case and null ones are skipped; the code of a
module chunk is its docstring; repeated rows give one row; where a language has no labelled text it is never found.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import lexing
from gneiss.llm.batches import hashed, map_rows

LANGS = ("en", "zh", "ja", "de", "fr", "es", "pt", "ru")
#: Rows of each kind that the dictionaries are fitted on, their largest size, and the bytes of a dictionary.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 3000, 4000, 48 * 1024
#: An encoding as text must be shorter than that as code by this share.
MARGIN = 0.05
MIN_WORDS, MIN_CJK = 5, 10
#: Common words of the languages written with spaces, fixed values; labelled text besides the documents.
COMMON = {
    "en": "the of and to in a is that this for it as was with be by on not he she his her but at are or from have an they which one you were all their there been if more when will would who so no please replace can has do any use only add by text later function",
    "de": "der die das und ist in zu den nicht von sie mit dem sich ein eine auf für als auch es an werden aus er hat dass wird bei nach durch nur noch wie oder wenn über so zum zur",
    "fr": "le la les de des et un une est en que qui dans pour ne pas sur au par plus avec ce il elle sont se aux mais ou comme cette tout être avant après si",
    "es": "el la los las de y en que un una es por con no para su se del al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también antes después",
    "pt": "o a os as de e em que um uma é por com não para se do da no na dos das ao como mais mas foi ele ela ou quando muito sem já também antes depois pela pelo",
    "ru": "и в не на что с по это как а то все она так его но да ты к у же вы за бы только её мне было вот от меня ещё нет о из ему теперь когда если для после",
}
#: Compression level; the dictionaries are small enough for a thorough search.
LEVEL = 6
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
_KANA = re.compile(r"[぀-ヿ]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_PLAIN_WORD = re.compile(r"^[\"'(\[«“‘¿¡„*_-]*[^\W\d_]+(?:['’-][^\W\d_]+)*[\"')\]»”’.,;:!?…*_-]*$")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]»”]*\s+|(?<=[。！？])|\n[ \t]*\n|\n(?=[ \t]*(?:[-*•]|\d+[.)])[ \t])|(?=[@:](?:param|returns?|throws|raises|type)\b)")
_CODEY = re.compile(r"[{};]|\w\(|\w\[\w|==|!=|:=|=>|->|\b\w+_\w+_?\w*\b|\b[a-z]+[A-Z]\w*|\w\.\w+\(|</?\w|&&|\|\||%[sd]|\$\{|[\w-]+=\S")
_SQL = re.compile(r"(?i)^\s*(?:select\b.+\bfrom\b|insert\s+into\b|update\s+\w+\s+set\b|delete\s+from\b|create\s+(?:table|index|view)\b|alter\s+table\b|drop\s+table\b|with\s+\w+\s+as\s*\()")


def sentences(text: str) -> list[str]:
    return [s for part in _SENTENCE.split(text.replace("\r", "")) if part and (s := " ".join(part.split()))]


def enough(sentence: str) -> bool:
    """Whether a sentence has words or characters enough to count as running text."""
    if len(_CJK.findall(sentence)) >= MIN_CJK:
        return True
    return sum(1 for w in sentence.split() if _PLAIN_WORD.match(w)) >= MIN_WORDS


def pieces(code: str, language: str, kind: str) -> list[tuple[str, str]]:
    """(comment, string or docstring; text) of a chunk's code; comments on neighbouring lines are one."""
    if kind == "module":
        return [("docstring", code)]
    out: list[tuple[str, str]] = []
    lines: list[str] = []
    end = -1
    for sort, a, b in lexing.spans(code, language):
        if sort == "line":
            body = lexing.inside(code, sort, a, b).strip()
            head = code[end:a] if end >= 0 else "x"
            if not (lines and head.strip() == "" and head.count("\n") == 1):
                if lines:
                    out.append(("comment", "\n".join(lines)))
                lines = []
            lines.append(body)
            end = b
        elif sort == "block":
            out.append(("comment", lexing.inside(code, sort, a, b)))
        elif sort in ("string", "text"):
            body = lexing.inside(code, sort, a, b)
            i = a
            while i and code[i - 1] in " \t\r":
                i -= 1
            if language == "python" and sort == "text" and (not i or code[i - 1] in ":\n"):
                out.append(("docstring", body))
            else:
                out.append(("string", body.replace("\\n", "\n").replace('\\"', '"').replace("\\'", "'").replace("\\t", " ")))
    if lines:
        out.append(("comment", "\n".join(lines)))
    return out


def segments(text: str) -> list[str]:
    """Sentences of a comment; lines that look like code part it."""
    out, run = [], []
    lines = text.split("\n")
    for line, following in zip(lines, [*lines[1:], ""]):
        s = line.strip()
        if s and not run and _apart(s, following.strip()):
            out.append(s)
        elif s and _CODEY.search(s) and not enough_plain(s):
            out += sentences("\n".join(run))
            out.append(s)
            run = []
        else:
            run.append(line)
            follows = following.strip()
            if follows and enough(s) and (follows[0].isupper() or _CJK.match(follows) and enough(follows)):
                out += sentences("\n".join(run))  # two sentences without a full stop between them
                run = []
    return out + sentences("\n".join(run))


def enough_plain(line: str) -> bool:
    words = line.split()
    return bool(_CJK.search(line)) or sum(1 for w in words if _PLAIN_WORD.match(w) and not _CODEY.search(w)) >= max(3, 0.6 * len(words))


def _apart(line: str, following: str) -> bool:
    """Whether a short line is a remark of its own and not the beginning of the sentence that follows."""
    return len(line.split()) <= 4 and not _CJK.search(line) and (following[:1].isupper() or bool(_CJK.match(following)))


class Identifier:
    """Encodes with one dictionary per language; made once per task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.by = {}
        for name, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17)
            self.by[name] = zstandard.ZstdCompressor(dict_data=d, compression_params=parameters)
        self.known: dict[str, str] = {}

    def size(self, name: str, raw: bytes) -> int:
        return len(self.by[name].compress(raw))

    def candidates(self, sentence: str) -> tuple[str, ...]:
        if len(_CJK.findall(sentence)) >= MIN_CJK:
            names = ("zh", "ja")
        elif len(_CYRILLIC.findall(sentence)) * 2 > len(sentence.replace(" ", "")):
            names = ("ru",)
        else:
            names = ("en", "de", "fr", "es", "pt")
        return tuple(n for n in names if n in self.by)

    def language(self, sentence: str) -> str:
        """The language of a sentence, or '' for code and what no dictionary fits."""
        got = self.known.get(sentence)
        if got is None:
            if len(self.known) >= 50_000:
                self.known.clear()
            got = self.known[sentence] = self._language(sentence)
        return got

    def _language(self, sentence: str) -> str:
        raw = sentence.encode()
        names = self.candidates(sentence)
        if not names:
            return ""
        n, _, best = min((self.size(name, raw), LANGS.index(name), name) for name in names)
        if "code" in self.by and n > self.size("code", raw) * (1 - MARGIN):
            return ""
        return best if n < len(raw) * 1.1 + 8 else ""


def fit(docs: DataFrame, chunks: DataFrame) -> dict[str, bytes]:
    """The dictionaries, from bounded samples of labelled documents and of code."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select(F.lower(F.trim("lang")).alias("lang"), "text", "doc_id")
    labelled = hashed(rows.where(F.col("lang").isin(*LANGS)), "doc_id", SAMPLE).select("lang", "text").toPandas()
    parts = chunks.where(F.col("code").isNotNull() & (F.length("code") <= SAMPLE_CHARS) & ~F.lower(F.trim("chunk_type")).eqNullSafe("module")).select("code", "file_path", "docstring", "chunk_id")
    code = hashed(parts, "chunk_id", SAMPLE).select("code", "file_path", "docstring").toPandas()
    return dictionaries(labelled, [(c, lexing.language_of(p)) for c, p in zip(code.code, code.file_path)], [x for x in code.docstring if x])


def _grams(sentence: str) -> list[str]:
    """Words, or pairs of characters where there are no words."""
    if len(_CJK.findall(sentence)) >= MIN_CJK // 2:
        kind = "kana" if _KANA.search(sentence) else "han"
        return [kind] + [sentence[i : i + 2] for i in range(len(sentence) - 1)]
    return [w.strip("\"'()[]«»“”’.,;:!?…*").lower() for w in sentence.split()]


class Words:
    """Which language the words of a sentence speak for, counted over labelled text."""

    def __init__(self, labelled: list[tuple[str, str]]):
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, sentence in labelled:
            counts[lang].update(_grams(sentence))
        totals = {lang: sum(c.values()) for lang, c in counts.items()}
        self.langs = sorted(counts)
        self.weight: dict[str, dict[str, float]] = {}
        for lang, c in counts.items():
            for gram, n in c.items():
                self.weight.setdefault(gram, {})[lang] = math.log(1 + n * 1e5 / totals[lang])

    def language(self, sentence: str) -> str:
        score = dict.fromkeys(self.langs, 0.0)
        for gram in _grams(sentence):
            for lang, w in self.weight.get(gram, {}).items():
                score[lang] += w
        best = max(self.langs, key=lambda x: (score[x], x), default="")
        return best if best and score[best] > 0 else ""


def dictionaries(labelled: pd.DataFrame, code: list[tuple[str, str]], docstrings: list[str] = ()) -> dict[str, bytes]:
    prose = [(lang, s) for lang, text in zip(labelled.lang, labelled.text) for s in sentences(re.sub(r"```[\s\S]*?(?:```|\Z)", "\n\n", text)) if enough(s) and not _CODEY.search(s)]
    words = Words(prose + [(lang, text) for lang, text in COMMON.items() if any(x == lang for x, _ in prose)])
    kept = [(lang, s) for lang, s in prose if words.language(s) == lang]
    spoken = [(words.language(s), s) for text in docstrings for s in sentences(text) if enough(s) and not _CODEY.search(s)]
    half = DICTIONARY // 2
    out = {}
    for lang in LANGS:
        ours, theirs = [s for x, s in kept if x == lang], [s for x, s in spoken if x == lang]
        if ours:
            out[lang] = (_build(theirs, half) + b"\n" + _build(ours, DICTIONARY - half))[:DICTIONARY]
    lines: list[str] = []
    for text, language in code:
        for line in lexing.without_text(text, language).split("\n"):
            if len(line.split()) > 1:
                lines.append(" ".join(line.split()))
        for sort, a, b in lexing.spans(text, language):
            if sort == "string" and _SQL.match(body := lexing.inside(text, sort, a, b)):
                lines.append(body)
    if lines:
        out["code"] = _build(lines, DICTIONARY)
    return out


def _build(parts: list[str], size: int) -> bytes:
    """Distinct parts up to a size: those that repeat first, up to half of it, the others spread over all of them."""
    counts = Counter(parts)
    often = [p for p, n in counts.most_common() if n >= 3]
    head: list[str] = []
    room = size // 2
    for p in often:
        if (room := room - len(p.encode()) - 1) < 0:
            break
        head.append(p)
    known = set(head)
    parts = [p for p in counts if p not in known]
    size -= sum(len(p.encode()) + 1 for p in head)
    total = sum(len(p.encode()) + 1 for p in parts)
    step = max(1.0, total / size)
    picked = [parts[int(i * step)] for i in range(int(len(parts) / step))]
    return "\n".join(picked + head[::-1]).encode()


def found(chunks: DataFrame, known: dict[str, bytes], with_sizes: bool = False) -> DataFrame:
    """(chunk_id, file_path, kind, lang, n_chars, total): text of each kind and language in every chunk row."""
    shared = chunks.sparkSession.sparkContext.broadcast(known)  # at most nine dictionaries of DICTIONARY bytes
    rows = chunks.select("chunk_id", "file_path", F.lower(F.trim("chunk_type")).alias("t_"), "code", "docstring")

    def make():
        identifier = Identifier(shared.value)

        def call(key, path, sort, code, docstring):
            got: dict[tuple[str, str], int] = {}
            parts = pieces(code, lexing.language_of(path), sort or "") if code else []
            seen = set()
            if docstring and docstring.strip():
                parts.append(("docstring", docstring))
            for kind, text in parts:
                for s in segments(text):
                    if enough(s) and (lang := identifier.language(s)):
                        if kind == "docstring":
                            if s in seen:
                                continue
                            seen.add(s)
                        got[kind, lang] = got.get((kind, lang), 0) + len(s)
            for (kind, lang), n in got.items():
                yield key, path, kind, lang, n, len(code or "")

        return call

    return map_rows(rows, "chunk_id string, file_path string, kind string, lang string, n_chars int, total int", make, heavy=True)


def shares(chunks: DataFrame, known: dict[str, bytes]) -> DataFrame:
    """(file_path, lang, n_chars, share): a file's text by language, and its share of the code of the file's chunks.

    Class chunks are left out, for their methods are chunks of their own; repeated rows count once.
    """
    rows = chunks.where(~F.lower(F.trim("chunk_type")).eqNullSafe("class"))
    # repeated rows are dropped where nothing but numbers is left of them
    text = found(rows, known).dropDuplicates(["chunk_id", "kind", "lang"]).groupBy("file_path", "lang").agg(F.sum("n_chars").alias("n_chars"))
    sizes = rows.select("chunk_id", "file_path", F.length(F.coalesce("code", F.lit(""))).alias("n_")).dropDuplicates(["chunk_id"])
    total = sizes.groupBy("file_path").agg(F.sum("n_").alias("total"))
    return text.join(total, "file_path").select("file_path", "lang", "n_chars", (F.col("n_chars") / F.greatest("total", F.lit(1))).alias("share"))
