"""Licence detection with ordered signature rules, in Spark's own expressions only.

Paragraphs (lines up to a blank one, joined, without comment leaders) that hold none of
a few stems are passed over; on the others a rule's regex is tried only where its keyword
stands, so statements may wrap over line ends. Of overlapping detections, one that lies
within another of higher priority (or of the same priority and longer, or equal
and earlier in the list) is suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES

#: Phrases of whole words whose places are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Characters that are no ASCII letter or digit; everything beyond ASCII is part of a word.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: White space, and what leads a line of a comment.
_LEADER = r"\n[\s*#;%>|!/]*+(?:--\s*+)?"
_GAP = rf"[ \t\r\f\x0B]++(?:{_LEADER})?|{_LEADER}"
_BLANK = r"\n[ \t\r\f\x0B*#;%>|!/]*+\n"
#: An identifier's expression ends with its line; the sign keeps the next line apart.
_TAG, _TAG_END = r"(spdx-license-identifier[^\n]*+)\n", "$1\x01\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _stems(keywords: list[str]) -> list[str]:
    """Shortest keywords such that each keyword contains one of them."""
    out: list[str] = []
    for k in sorted(set(keywords), key=lambda k: (len(k), k)):
        if not any(s in k for s in out):
            out.append(k)
    return out


def _any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def _with(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _spans(line: Column, regex: Column, label: Column, priority: Column, order: Column) -> Column:
    """All matches of regex in the line: struct<label, priority, order, start, end>.

    What lies between the matches comes from split, the matches themselves from
    regexp_extract_all; their lengths add up to the places.
    """

    def places(x: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(x["gaps"], i))
            end = start + F.length(F.get(x["found"], i))
            span = F.struct(label.alias("label"), priority.alias("priority"), order.alias("order"), start.alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        none = F.array().cast("array<struct<label:string,priority:int,order:int,start:int,end:int>>")
        first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        steps = F.when(F.size(x["found"]) > 0, F.sequence(F.lit(0), F.size(x["found"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, first, add, lambda acc: acc["spans"])

    return _with(F.struct(F.split(line, regex, -1).alias("gaps"), F.regexp_extract_all(line, regex, F.lit(0)).alias("found")), places)


def _unsuppressed(found: Column) -> Column:
    def within(f: Column, g: Column) -> Column:
        longer = (g["end"] - g["start"]) > (f["end"] - f["start"])
        same = (g["end"] == f["end"]) & (g["start"] == f["start"])
        above = (g["priority"] > f["priority"]) | ((g["priority"] == f["priority"]) & (longer | (same & (g["order"] < f["order"]))))
        return (g["start"] <= f["start"]) & (g["end"] >= f["end"]) & above

    return _with(found, lambda x: F.filter(x, lambda f: ~F.exists(x, lambda g: within(f, g))))


def detections(text: Column, rules: tuple[tuple[str, int, str, str], ...] = RULES) -> Column:
    """array<struct<label,priority>> of a text's detections that nothing suppresses, distinct.

    Matches lie within one paragraph, whose runs of white space and line ends with
    comment leaders count as one space; equal paragraphs count once. Null gives null.
    """
    low = F.lower(text)
    table = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(p).alias("priority"), F.lit(n).alias("order"), F.lit(k).alias("keyword"), F.lit(r).alias("regex")) for n, (a, p, k, r) in enumerate(rules)))
    stems = _stems([k for _, _, k, _ in rules])

    def joined(part: Column) -> Column:
        tagged = F.when(part.contains("spdx-license-identifier"), F.regexp_replace(part, _TAG, _TAG_END)).otherwise(part)
        return F.regexp_replace(tagged, _GAP, " ")

    def in_line(line: Column) -> Column:
        tried = F.filter(table, lambda r: line.contains(r["keyword"]))
        found = F.flatten(F.transform(tried, lambda r: _spans(line, r["regex"], r["label"], r["priority"], r["order"])))
        return F.transform(_unsuppressed(found), lambda f: F.struct(f["label"].alias("label"), f["priority"].alias("priority")))

    # A stem may wrap too, so its longest word decides which paragraphs are joined.
    words = _stems([max(s.split(), key=len) for s in stems])
    parts = F.array_distinct(F.filter(F.split(low, _BLANK, -1), lambda part: _any(part, words)))
    lines = F.filter(F.transform(parts, joined), lambda line: _any(line, stems))
    none = F.array().cast("array<struct<label:string,priority:int>>")
    return F.when(_any(low, words), F.array_distinct(F.flatten(F.transform(lines, in_line)))).otherwise(F.when(text.isNotNull(), none))


def phrase_places(text: Column, phrases: tuple[tuple[str, str], ...] = PHRASES) -> Column:
    """array<struct<start,label>> of the places, by word from 0, where a phrase's words stand consecutively, in order."""
    def at(words: Column) -> Column:
        def place(w: Column, i: Column) -> Column:
            out = F.lit(None).cast("string")
            for phrase, label in phrases:
                first, *rest = phrase.split(" ")
                same = w == first
                for k, other in enumerate(rest, 1):
                    same = same & F.coalesce(F.get(words, i + k) == other, F.lit(False))
                out = F.when(same, F.lit(label)).otherwise(out)
            return F.struct(i.cast("bigint").alias("start"), out.alias("label"))

        return F.filter(F.transform(words, place), lambda p: p["label"].isNotNull())

    last = sorted({p.rpartition(" ")[2] for p, _ in phrases})
    words = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(_any(F.lower(text), last), _with(words, at)).otherwise(none)


def scan(docs: DataFrame, rules: tuple[tuple[str, int, str, str], ...] = RULES) -> DataFrame:
    """docs with n_words, places, detections and licence_score added (columns of these names are replaced).

    n_words: words of the whole text. places: array<struct<start,label>> of PHRASES.
    detections: array<struct<label,priority>>. licence_score: 0 without any, else
    from 0 to 1, the highest priority as a share of 100, at least 0.3 with a phrase.
    Null text is empty. Every row and other column stays; nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / 100
    return (
        docs.withColumn("n_words", F.regexp_count(text, F.lit(_WORD)).cast("bigint"))
        .withColumn("places", phrase_places(text)).withColumn("detections", detections(text, rules))
        .withColumn("licence_score", F.greatest(best, F.when(F.size("places") > 0, F.lit(0.3)).otherwise(F.lit(0.0))))
    )


def check_rules(rules: tuple[tuple[str, int, str, str], ...] = RULES) -> None:
    """Raise ValueError for a rule that is malformed; the tests call it."""
    for label, priority, keyword, regex in rules:
        re.compile(regex)
        if not (label and keyword and keyword == keyword.lower() and 0 < priority <= 100):
            raise ValueError(f"rule {label}: {keyword}")
