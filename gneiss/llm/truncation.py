"""Problem 10: texts cut off on their way.

First the hidden storage limits: lengths of every text are recomputed under other encodings (code points, UTF-8, UTF-16,
HTML and JSON escapes, CRLF line ends) and counted by source over all texts, however they end; a length at which a
source's different texts pile up, and beyond which it has next to none, is a limit. Then endings are inspected. A text at
a limit of its source is cut unless it ends as only a complete one does. Elsewhere, where a transfer broke off, the ending
alone must show it: broken characters, open code fences, brackets and links, short table rows, sentences without an end,
items and titles whose last word is only the beginning of what the corpus has after the same word, and items
that end on words on which whole items of the corpus don't end. Copies share a verdict.

Defined cases: null, empty and blank texts are complete; complete texts without a full stop (titles, single words, lists,
tables, code blocks, signatures) are complete; null sources form a group of their own; a source whose texts all have
one length has a format, not a limit; copies count once for limits; repeated rows give one row; texts of any length
count, however short.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.batches import map_rows
from gneiss.session import cut

#: A pile is this many different texts of a source at one length, and from one to the other share of its texts.
PILE, PILE_SHARE, FIXED_SHARE = 5, 0.02, 0.95
#: Texts beyond a limit, as a share of the pile at it.
BEYOND = 0.05
_TERMINAL = re.compile(r"[.!?。！？।؟…‥｡;；:：][\"'”’»›）)\]】」』*_`]*$")
_DOTS = re.compile(r"(?:\.{3,}|…|\[(?:\.\.\.|…|truncated|cut|more)\]|\((?:truncated|continued|more)\)|<truncated>)\s*$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_REMARK = re.compile(r"[(\[（][^()\[\]（）]*[)\]）]$")
_URL = re.compile(r"^<?https?://\S+$")
_WHOLE_URL = re.compile(r"^<?https?://[\w-]+(?:\.[\w-]+)+/\S+$")
_FOOTER = re.compile(r"^(?:--\s?\S.*|[^\W\d][\w-]*(?: [\w-]+){0,3}:\s[^\s.!?。！？][^.!?。！？]*|#{1,6}\s.*|[=~_-]{3,})$")
_WORD = re.compile(r"[^\W_]+(?:['’_-][^\W_]+)*")


def lengths(text: str) -> dict[str, int]:
    """How long a text is for storages that count or escape in other ways."""
    crlf = text.replace("\r\n", "\n").replace("\n", "\r\n")
    escaped = html.escape(text)
    quoted = json.dumps(text, ensure_ascii=False)
    return {
        "chars": len(text),
        "utf8": len(text.encode(errors="replace")),
        "utf16": len(text.encode("utf-16-le", errors="replace")) // 2,
        "html": len(escaped),
        "html_utf8": len(escaped.encode(errors="replace")),
        "json": len(quoted) - 2,
        "json_utf8": len(quoted.encode(errors="replace")) - 2,
        "json_ascii": len(json.dumps(text)) - 2,
        "crlf": len(crlf),
        "crlf_utf8": len(crlf.encode(errors="replace")),
    }


ENCODINGS = tuple(lengths(""))


def _bare(line: str) -> str:
    """A line without closing decoration: symbols, check marks, emoji and a remark in brackets after a full stop."""
    line = line.rstrip()
    while line and (unicodedata.category(line[-1]) in ("So", "Sk", "Cf", "Mn") or line[-1].isspace()) and line[-1] != "�":
        line = line[:-1]
    return re.sub(r"(?<=[.!?。！？])\s*\([^()]*\)$", "", line)


def ending(text: str | None) -> tuple[str, str, str, str]:
    """(verdict cut, whole or unsure, kind of ending, word before the last, last word)."""
    if not text or not text.strip():
        return "whole", "blank", "", ""
    t = text.replace("\r\n", "\n").replace("\r", "\n").rstrip()
    if t.endswith("�"):
        return "cut", "broken character", "", ""
    if m := _DOTS.search(t):
        before = t[: m.start()].rstrip()
        return ("whole" if not before or re.search(r"[.!?。！？]$", before) else "cut"), "dots", "", ""
    lines = t.split("\n")
    fences = [x.strip() for x in lines if x.lstrip().startswith("```")]
    if len(fences) % 2:
        return "cut", "open fence", "", ""
    last = lines[-1].strip()
    if last.startswith("`") and set(last) == {"`"}:
        return ("whole", "fence", "", "") if len(last) >= 3 else ("cut", "open fence", "", "")
    decorated = last
    last = _bare(last)
    if not last:
        return "whole", "symbols", "", ""
    words = _WORD.findall(last)
    tail = (words[-2] if len(words) > 1 else "", words[-1] if words else "")
    if last.startswith("|"):
        rows = [x.strip() for x in lines[:-1] if x.strip().startswith("|")]
        whole = last.endswith("|") and len(last) > 1 and (not rows or last.count("|") == rows[0].count("|"))
        return ("whole" if whole else "cut"), "table", *tail
    if _ITEM.match(decorated) or re.fullmatch(r"[-*+•]|\d+[.)]?", decorated) and len(lines) > 1 and _ITEM.match(lines[-2]):
        before = [_bare(x) for x in lines[:-1] if _ITEM.match(x)]
        if _REMARK.search(last) or decorated != last:
            return "whole", "list", *tail
        if before and all(_REMARK.search(x) for x in before) or not _ITEM.match(decorated):
            return "cut", "list", *tail  # every item before it closes with a remark, or only its mark is there
        if _TERMINAL.search(last):
            return "whole", "list", *tail
        return "unsure", "list", *tail
    if _URL.match(last):
        return ("whole" if _WHOLE_URL.match(last) else "cut"), "address", *tail
    alone = len(lines) == 1 or not lines[-2].strip()
    ends = _TERMINAL.search(last) and not re.search(r"[;；:：,，]$", last)
    if not ends and (re.search(r"\[[^\]]*\]\([^)]*$|\[[^\]]*$", last) or last.count("(") > last.count(")") or last.count("{") > last.count("}") or last.count("`") % 2):
        return "cut", "open bracket", *tail
    if ends:
        return "whole", "sentence", *tail
    if alone and len(lines) > 1 and _FOOTER.match(last):
        return "whole", "footer", *tail
    if decorated != last:
        return "whole", "decorated", *tail
    if not re.search(r"[.!?](?:\s|$)|[。！？]", t):
        return "unsure", "title" if len(lines) == 1 else "lines", *tail  # a text without any sentence
    return "cut", "sentence", *tail


def endings(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, content hash, verdict, kind, before, last, n array by ENCODINGS) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k_"), F.coalesce(F.col(source), F.lit("")).alias("s_"), F.xxhash64(F.col(text), F.length(text)).alias("h_"), F.col(text).alias("t_"))

    def make():
        def call(k, s, h, t):
            verdict, sort, before, last = ending(t)
            yield k, s, h, verdict, sort, before.lower(), last.lower(), list(lengths(t).values()) if t and t.strip() else []

        return call

    return map_rows(rows, f"`{key}` {kind}, source string, content bigint, verdict string, kind string, before string, last string, n array<int>", make)


def limits(found: DataFrame) -> DataFrame:
    """(source, encoding, most, own): lengths at which a source's texts pile up with next to none beyond.

    Lengths are counted once, by source and encoding; what follows reads the counts, at most one row per length. A byte
    limit may leave a broken character of up to three bytes more or less, so neighbouring lengths count together. Where
    half of a pile ends as complete texts do, texts of that length are merely common."""
    texts = found.where("size(n) > 0").groupBy("source", "content").agg(F.first("n").alias("n"), F.first(F.col("verdict") == "whole").alias("whole"))
    counts = texts.select("source", "whole", F.posexplode("n").alias("encoding", "length")).groupBy("source", "encoding", "length").agg(F.count("*").alias("own"), F.sum(F.col("whole").cast("int")).alias("whole"))
    group = W.partitionBy("source", "encoding")
    by_length = group.orderBy("length")
    counts = (
        counts.withColumn("texts", F.sum("own").over(group))
        .withColumn("pile", F.sum("own").over(by_length.rangeBetween(-3, 0)))
        .withColumn("beyond", F.col("texts") - F.sum("own").over(by_length.rangeBetween(W.unboundedPreceding, 3)))
    )
    piles = counts.where((F.col("pile") >= PILE) & (F.col("own") >= F.greatest(F.lit(PILE), F.col("texts") * PILE_SHARE)) & (F.col("pile") <= F.col("texts") * FIXED_SHARE) & (F.col("beyond") <= F.col("own") * BEYOND) & (F.col("whole") * 2 < F.col("own")))
    return piles.groupBy("source", "encoding").agg(F.max(F.struct("own", "length")).alias("top")).select("source", "encoding", F.col("top.length").alias("most"), F.col("top.own").alias("own"))


#: Words that are sent to the tasks at most, to count only what is asked for; beyond, every pair of words is counted.
ASKED = 200_000


def words_seen(docs: DataFrame, unsure: DataFrame, text: str = "text", most: int = ASKED) -> DataFrame:
    """(before, word, n_end, n_inside, n_any): words by the word before them, where either is asked for by unsure (before, last);
    where they end or stand inside list items that aren't a text's last line, and anywhere but at the end of a text."""
    sides = unsure.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("w")), F.struct(F.lit(1).alias("side"), F.col("last").alias("w")))).alias("s")).select("s.*").distinct()
    few = sides.limit(most + 1).collect()
    asked = docs.sparkSession.sparkContext.broadcast(tuple(frozenset(r["w"] for r in few if r["side"] == i) for i in (0, 1)) if len(few) <= most else None)

    def run(batches):
        known = asked.value
        for b in batches:
            ends, inside, anywhere = Counter(), Counter(), Counter()
            for t in b.column(0).to_pylist():
                lines = t.replace("\r", "").rstrip().split("\n")
                for i, line in enumerate(lines):
                    item, last = _ITEM.match(line), i == len(lines) - 1
                    words = _WORD.findall((_bare(line.strip()) if item or last else line).lower())
                    if not words:
                        continue
                    pairs = list(zip(["", *words], words))
                    final = pairs.pop()
                    if not last:
                        pairs.append(final)
                    if known is not None:
                        befores, lasts = known
                        pairs = [p for p in pairs if p[0] in befores or p[1] in lasts]
                    anywhere.update(pairs)
                    if item and not last:
                        if pairs and pairs[-1] is final:
                            ends[pairs.pop()] += 1
                        inside.update(pairs)
            keys = list(anywhere)
            counts = [pa.array([c[k] for k in keys], pa.int64()) for c in (ends, inside, anywhere)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *counts], names=["before", "word", "n_end", "n_inside", "n_any"])

    rows = docs.select(F.col(text).alias("t_")).where("t_ is not null")
    return rows.mapInArrow(run, "before string, word string, n_end bigint, n_inside bigint, n_any bigint").groupBy("before", "word").agg(*(F.sum(c).alias(c) for c in ("n_end", "n_inside", "n_any")))


def told_by_words(unsure: DataFrame, words: DataFrame) -> DataFrame:
    """(before, last, mid_item, mid_word) for each of the distinct (before, last) at the end of an unsure text."""
    asked = unsure.select("last").distinct()
    by_word = words.join(asked, words.word == asked["last"], "left_semi").groupBy(F.col("word").alias("last")).agg(F.sum("n_end").alias("w_end"), F.sum("n_inside").alias("w_inside"), F.sum("n_any").alias("w_any"))
    # beginnings of the words known after the same word, of the lengths that are asked for there
    sizes = unsure.groupBy("before").agg(F.collect_set(F.length("last")).alias("sizes"))  # at most one number per length of a word
    parts = (
        words.join(sizes, "before")
        .select("before", "word", (F.col("n_end") + F.col("n_inside")).alias("in_items"), "n_any", F.explode(F.filter("sizes", lambda n: n < F.length("word"))).alias("n_"))
        .groupBy("before", F.substring("word", F.lit(1), F.col("n_")).alias("last"))
        .agg(F.sum("in_items").alias("longer_items"), F.sum("n_any").alias("longer"))
    )
    exact = words.select("before", F.col("word").alias("last"), F.col("n_end").alias("pair_end"), F.col("n_inside").alias("pair_inside"), F.col("n_any").alias("pair_any"))
    known = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        unsure.join(by_word, "last", "left")
        .join(exact, ["before", "last"], "left")
        .join(parts, ["before", "last"], "left")
        .select(
            "before",
            "last",
            ((known("pair_end") * 10 < known("longer_items")) | (known("w_end") * 10 < known("w_inside")) | (known("pair_end") * 10 < known("pair_inside"))).alias("mid_item"),
            ((known("pair_any") * 10 < known("longer")) & (known("w_any") * 10 < known("longer")) & (F.col("last") != "")).alias("mid_word"),
        )
    )


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, cut boolean, at_limit boolean, kind) of every row."""
    found = cut(endings(docs, key, text, source))  # a few numbers and words a text, read by several jobs below
    at = limits(found).groupBy("source").agg(F.collect_list(F.struct("encoding", "most")).alias("limits"))  # at most one per encoding
    none = F.array().cast("array<struct<encoding:int,most:int>>")
    found = found.join(at, "source", "left").withColumn("at_limit", F.exists(F.coalesce("limits", none), lambda x: F.get(F.col("n"), x["encoding"]) == x["most"])).drop("limits", "n")
    asked = cut(found.where("verdict = 'unsure' and not at_limit").select("before", "last").distinct())
    told = told_by_words(asked, cut(words_seen(docs, asked, text)))
    found = found.join(told, ["before", "last"], "left")
    by_words = F.when(F.col("kind") == "list", F.col("mid_item")).otherwise(F.col("mid_word"))
    cut_itself = F.when(F.col("at_limit"), F.col("verdict") != "whole").otherwise((F.col("verdict") == "cut") | (F.col("verdict") == "unsure") & F.coalesce(by_words, F.lit(False)))
    found = found.withColumn("cut", cut_itself)
    shared = found.where("cut").select("content").distinct().withColumn("copy", F.lit(True))
    return found.join(shared, "content", "left").select(key, "source", (F.col("cut") | F.coalesce("copy", F.lit(False))).alias("cut"), "at_limit", "kind")


def rates(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, n_texts, n_cut, n_at_limit, share) of every source; n_at_limit counts the cut texts that a storage limit explains."""
    one = lambda c: F.sum(c.cast("int"))
    return judged(docs, key, text, source).groupBy("source").agg(F.count("*").alias("n_texts"), one(F.col("cut")).alias("n_cut"), one(F.col("cut") & F.col("at_limit")).alias("n_at_limit"), F.avg(F.col("cut").cast("double")).alias("share"))
