"""Personal data and the terms that give it away, in Spark's own expressions and joins only.

Patterns find e-mail addresses, IP addresses, card and phone numbers. These are the entities to
protect. How much a term near them tells is estimated from the whole corpus: every word
position is a draw, near(c) says that it lies in the context of an occurrence of entity c, and
PMI(t; c) = log2(p(t, near c) / (p(t) p(near c))) is what seeing t tells of c. A term discloses c
if its PMI reaches IC(c) / alpha, with IC(c) = -log2 p(near c), all that there is to tell (Sanchez
and Batet 2016). In documents that name c, such a term becomes its class (a number, a code, a word) or, where
even the class discloses c, is removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, join_counted

#: Kinds in their order, what a text with one must hold, and the pattern. Possessive repeats and the look behind (a
#: match that starts within a run starts at the run's first character too) only save time on long runs.
KINDS = (
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", None, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Four parts of at most 255, whatever zeros lead.
_IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: A context reaches over so many characters on each side of an occurrence, without words that it would cut.
REACH = 80
#: A term is a word of so many characters; its class is by its characters.
TERM_LENGTHS = (3, 64)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Items that one step of a fold appends one by one; steps append whole runs of them.
RUN = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def positions(text: Column, pattern: str) -> Column:
    """All matches of the pattern in order: array of (start, end, value, before, after); before and after reach to the next match.

    Places are what lies between matches added up, so a text is read through twice, not once for each match.
    Patterns match no empty string. Sums are folded in runs of RUN, so a text with very many
    matches does not copy its array for each of them.
    """
    item = "start bigint, end bigint, value string, before string, after string"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    def state(at: Column, found: Column) -> Column:
        return F.struct(at.cast("bigint").alias("at"), found.cast(f"array<struct<{item.replace(' ', ':').replace(',:', ',')}>>").alias("found"))

    def runs(acc: Column, run: Column) -> Column:
        return F.aggregate(run, state(acc["at"], F.array()), step, lambda s: F.struct(s["at"].alias("at"), F.concat(acc["found"], s["found"]).alias("found")))

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN)), lambda k: F.slice(all_, k.cast("int") * RUN + 1, RUN))

    def zipped(gaps: Column) -> Column:
        n = F.size(gaps) - 1
        return F.arrays_zip(F.slice(gaps, 1, n).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.slice(gaps, 2, n).alias("after"))

    folded = let(let(F.split(text, pattern, -1), zipped), lambda z: F.aggregate(cut(z), state(F.lit(0), F.array()), runs)["found"])
    return F.when(F.regexp_like(text, F.lit(pattern)), folded).otherwise(state(F.lit(0), F.array())["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits (a string of 0-9) pass the Luhn check: every second one from the right doubled, sums of digits, a multiple of ten."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    one = lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(_IP))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """One name for all forms of an entity."""
    return F.concat(F.lit(f"{kind}:"), F.translate(value, _UPPER, _LOWER) if kind == "email" else value if kind == "ip" else _digits(value))


def _spans_of(text: Column, kind: str, must: str | None, pattern: str) -> Column:
    def told(m: Column) -> Column:
        before = F.when(F.length(m["before"]) <= REACH, m["before"]).otherwise(F.regexp_replace(F.right(m["before"], F.lit(REACH)), f"^{_WORD}", ""))
        after = F.when(F.length(m["after"]) <= REACH, m["after"]).otherwise(F.regexp_replace(F.left(m["after"], F.lit(REACH)), f"{_WORD}$", ""))
        return F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _entity(kind, m["value"]).alias("entity"),
            before.alias("before"), after.alias("after"),
        )

    spans = F.transform(F.filter(positions(text, pattern), lambda m: _passes(kind, m["value"])), told)
    if must is None:
        return spans
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,entity:string,before:string,after:string>>")
    return F.when(F.contains(text, F.lit(must)), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """Personal data in text by kind, then start: array of (kind, start, end, entity, before, after).

    Leftmost matches of each kind that do not overlap; those that fail their test are dropped and not tried again.
    before and after are the whole words within REACH characters.
    """
    return F.concat(*(_spans_of(text, *kind) for kind in KINDS))


def _class(term: Column) -> Column:
    return F.when(F.regexp_like(term, F.lit("^[0-9]+$")), "number").when(F.regexp_like(term, F.lit("[0-9]")), "code").otherwise("word")


def _is_term(word: Column) -> Column:
    return F.length(word).between(*TERM_LENGTHS)


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): how often each word stands in all texts, lower-cased A-Z; counted in each task before the shuffle."""
    words = texts.select(F.explode(F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


def context_terms(spans: DataFrame) -> DataFrame:
    """(row, entity, term, start, end) once for each word in the context of an occurrence in spans (row, spans).

    A position between two occurrences of one entity counts once for it.
    """
    one = spans.select("row", F.explode("spans").alias("s")).select("row", "s.*")

    def words(side: str, begin: Column) -> Column:
        here = positions(F.col(side), _WORD)
        return F.transform(here, lambda m: F.struct(F.translate(m["value"], _UPPER, _LOWER).alias("term"), (begin + m["start"]).alias("start"), (begin + m["end"]).alias("end")))

    both = F.concat(words("before", F.col("start") - F.length("before")), words("after", F.col("end")))
    out = one.select("row", "entity", F.explode(both).alias("w")).select("row", "entity", "w.*").where(_is_term(F.col("term")))
    return out.dropDuplicates(["row", "entity", "start"])


def disclosing(terms: DataFrame, counts: DataFrame, scratch: Scratch, alpha: float = 1.1, least: int = 2) -> DataFrame:
    """(entity, term, instead, n) of all pairs in terms (saved) whose PMI reaches IC(entity) / alpha; n says how often they meet.

    counts (saved) are those of the whole corpus. Pairs that meet less than ``least`` times tell
    too little to judge. ``instead`` is the class that takes the term's place, or empty where the class discloses
    the entity as well.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    pairs = scratch.save(terms.groupBy("entity", "term").agg(F.count("*").alias("n")).withColumn("class", _class(F.col("term"))), "pairs")
    near = pairs.groupBy("entity", "class").agg(F.sum("n").alias("n_near"))
    near = scratch.save(near.withColumn("near", F.sum("n_near").over(Window.partitionBy("entity"))), "near")  # three classes an entity
    tells = lambda both, own: F.log2(both * F.lit(float(total)) / (own * F.col("near"))) * alpha >= F.log2(F.lit(float(total)) / F.col("near"))
    classes = counts.where(_is_term(F.col("term"))).groupBy(_class(F.col("term")).alias("class")).agg(F.sum("n").alias("of_class"))
    near = near.join(F.broadcast(classes), "class").withColumn("instead", F.when(tells(F.col("n_near"), F.col("of_class")), "").otherwise(F.concat(F.lit("["), F.upper("class"), F.lit("]"))))
    often = scratch.save(pairs.where(F.col("n") >= least), "often")
    with_term = often.groupBy("term").agg(F.count("*").alias("n")).join(counts.withColumnRenamed("n", "of_term"), "term")
    rated = join_counted(often.withColumnRenamed("n", "both"), scratch.save(with_term, "terms"), ["term"], often.count())
    rated = rated.join(near.select("entity", "class", "near", "instead"), ["entity", "class"])
    return rated.where(tells(F.col("both"), F.col("of_term"))).select("entity", "term", "instead", F.col("both").alias("n"))


def find(docs: DataFrame, alpha: float = 1.1, least: int = 2, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all, if None), pii_base and pii_terms, for every row.

    pii_base: array of (kind, start, end), as base_spans() has them. pii_terms: array of (start, end, instead) of the
    words that disclose an entity of the same row, by start; none overlaps personal data. Places count
    characters (code points) from 0, ends are exclusive. docs has text (null: empty). Columns called pii_base and
    pii_terms are replaced. Repeated rows each have their result; all count in the statistics.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("pii_base", "pii_terms")]
    row = fresh(docs.columns, "row")
    scratch = Scratch(docs.sparkSession, "sanitise")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*keep, base_spans(text).alias("pii_base"), F.monotonically_increasing_id().alias(row))
    found = scratch.save(found, "spans")  # so that row stays the same
    spans = found.where(F.size("pii_base") > 0).select(F.col(row).alias("row"), F.col("pii_base").alias("spans"))
    terms = scratch.save(context_terms(spans), "terms")
    counts = scratch.save(word_counts(docs.select(text.alias("text"))), "counts")
    pairs = scratch.save(disclosing(terms, counts, scratch, alpha, least), "disclosing")
    hits = join_counted(terms, pairs, ["entity", "term"], terms.count())
    extra = _apart(hits.groupBy("row", "start", "end").agg(F.min("instead").alias("instead")), spans)
    extra = extra.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "instead"))).alias("pii_terms"))
    slim = F.transform("pii_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = found.withColumn("pii_base", slim).join(extra.withColumnRenamed("row", row), row, "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,instead:string>>")
    return out.withColumn("pii_terms", F.coalesce("pii_terms", none)).drop(row)


def _apart(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """The hits (row, start, end, instead) that overlap none of their row's spans: one pass over both by start."""
    own = spans.join(hits.select("row").distinct(), "row", "left_semi").select("row", F.explode("spans").alias("s"))
    own = own.select("row", "s.start", "s.end", F.lit(None).cast("string").alias("instead"), F.lit(True).alias("base"))
    both = own.unionByName(hits.withColumn("base", F.lit(False)))
    until = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("ended", F.max(F.when(F.col("base"), F.col("end"))).over(until)).withColumn("begins", F.min(F.when(F.col("base"), F.col("start"))).over(after))
    clear = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce("begins", F.col("end")) >= F.col("end"))
    return both.where(~F.col("base") & clear).select("row", "start", "end", "instead")


def clean_text(text: Column, base: Column, terms: Column) -> Column:
    """text with personal data as [KIND] and disclosing terms as their class or gone.

    Overlapping spans become one, named after the first of them. The text is cut as UTF-32, where a place is an
    offset, so cutting takes time by its length, not by that times the number of spans.
    """
    named = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("instead")))
    spans = F.array_sort(F.concat(named, F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["instead"].alias("instead")))))
    empty = lambda at: F.struct(at.cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def rest(units: Column, begin: Column, end: Column) -> Column:
        return F.decode(F.substring(units, (begin * 4 + 1).cast("int"), ((end - begin) * 4).cast("int")), "UTF-32")

    def cut(units: Column, all_: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            more = F.concat(acc["parts"], F.array(rest(units, acc["at"], s["start"]), s["instead"]))
            fresh_ = s["start"] >= acc["at"]
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh_, more).otherwise(acc["parts"]).alias("parts"))

        def runs(acc: Column, run: Column) -> Column:
            return F.aggregate(run, empty(acc["at"]), step, lambda s: F.struct(s["at"].alias("at"), F.concat(acc["parts"], s["parts"]).alias("parts")))

        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN)), lambda k: F.slice(all_, k.cast("int") * RUN + 1, RUN))
        end = F.length(units) / 4
        return F.aggregate(pieces, empty(F.lit(0)), runs, lambda s: F.concat(F.array_join(s["parts"], ""), rest(units, s["at"], end.cast("bigint"))))

    return F.when((F.size(base) + F.size(terms)) == 0, text).otherwise(let(F.encode(text, "UTF-32"), lambda u: let(spans, lambda a: cut(u, a))))


def sanitise(docs: DataFrame, alpha: float = 1.1, least: int = 2) -> DataFrame:
    """docs with their texts cleaned; null texts stay null. Columns and their order are those of docs."""
    found = find(docs, alpha, least)
    return found.withColumn("text", clean_text(F.col("text"), F.col("pii_base"), F.col("pii_terms"))).select(*docs.columns)
