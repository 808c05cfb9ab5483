"""Abbreviations that texts define as `long form (short form)`, and what each use of one means at its place in the order of rows.

Short and long form are aligned from right to left (Schwartz and Hearst, 2003): each letter or digit of the short form is found as far
right as can be, anywhere in a word, and the first one at the start of a word. All of it is column expressions; the work is linear in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import let
from .ordering import greatest_before
from .store import freed, spread, written

# The fewest and most characters of a short form, the most words in it, and how many words of the text before may belong to it:
# the lesser of its characters plus five and twice its characters.
SHORTEST, LONGEST, WORDS, MORE, TIMES = 2, 10, 2, 5, 2
#: Up to so many different short forms (of at most LONGEST characters) are broadcast to the rows; more are joined by a shuffle.
FEW = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "[ \\t\\r\\n]+"


def lowered(c: Column) -> Column:
    """A-Z only, so that no text gets longer or shorter."""
    return F.translate(c, _UPPER, _LOWER)


def lowered_word(c: Column) -> Column:
    """As lowered(), quicker for words in ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(lowered(c))


def long_form(short: Column, before: Column) -> Column:
    """The end of before (words with single spaces) that short stands for; null if none does."""
    # a space for all but letters and digits, and one at the end, so that a letter and a space is a letter that starts a word
    backwards = F.concat(F.reverse(F.regexp_replace(lowered(before), r"[^\p{L}\p{N}]", " ")), F.lit(" "))
    marks = F.reverse(F.filter(F.split(lowered(short), ""), lambda c: c.rlike(r"^[\p{L}\p{N}]$")))
    find = lambda what, text, at: F.nullif(F.call_function("locate", what, text, at), F.lit(0))
    step = lambda at, c, text: find(c, text, at + 1)
    inner = F.slice(marks, 1, F.greatest(F.size(marks) - 1, F.lit(0)))
    at = F.aggregate(inner, F.lit(0), lambda at, c: step(at, c, backwards))
    end = find(F.concat(F.try_element_at(marks, F.lit(-1)), F.lit(" ")), backwards, at + 1)
    found = F.substr(before, F.length(before) - end + 1)
    return F.when(F.length(found) > F.length(short), found)


def definitions(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, at (the place among the text's parentheses), short and long, as written."""
    # an opening parenthesis with the piece before it, from its last closing one on; a text is split once, however many it has, and of a
    # piece only the last words are looked at, from its end
    short = lambda x: F.regexp_extract(F.left(x, F.lit(LONGEST + 1)), rf"^([^()]{{{SHORTEST},{LONGEST}}})\)", 1)
    fits = lambda s: s.rlike(r"^[\p{L}\p{N}]") & s.rlike(r"\p{L}") & (F.size(F.split(s, _SPACE)) <= WORDS)
    opening = lambda p: F.filter(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: F.struct(i.alias("at"), short(x).alias("short"))), lambda x: fits(x.short))
    few = rf"^[ \t\r\n]*+(?:[^ \t\r\n]++[ \t\r\n]*+){{1,{LONGEST + MORE}}}+"
    before = lambda p, i: F.reverse(F.regexp_extract(F.reverse(F.substring_index(F.get(p, i), ")", -1)), few, 0))
    opened = let(F.split(F.col(text), r"\("), lambda p: F.transform(opening(p), lambda x: F.struct(x.at.alias("at"), x.short.alias("short"), before(p, x.at).alias("before"))))
    out = rows.select(*keep, F.explode(opened).alias("x"))
    words = F.filter(F.split("x.before", _SPACE), lambda w: w != "")
    out = out.select(*keep, "x.at", "x.short", words.alias("_words"))
    n = F.length("short")
    most = F.least(n + MORE, n * TIMES, F.size("_words"))
    out = out.where(F.size("_words") > 0)
    last = F.array_join(F.slice("_words", F.size("_words") - most + 1, most), " ")
    # the alignment is heavy: pairs are dealt over all tasks first, and written, so that the condition below isn't evaluated before
    out = written(spread(out.select(*keep, "at", "short", last.alias("_last"))))
    return out.select(*keep, "at", "short", long_form(F.col("short"), F.col("_last")).alias("long")).where("long IS NOT NULL")


def learned(rows: DataFrame, text: str) -> DataFrame:
    """short, long (in lower case) and how often texts define one as the other."""
    return definitions(rows, text, []).groupBy("short", lowered(F.col("long")).alias("long")).agg(F.count("*").alias("n"))


def expanded(rows: DataFrame, text: str, order: str) -> DataFrame:
    """order (a number, one a row), short (in lower case) and long: for every word of a row's text that rows before it have defined,
    its latest definition, in the order of rows and, within one, of its text. A row doesn't see its own definitions or later ones.

    An as-of join without a sort of each short form's rows in one task: running greatest values in two levels, so a short form that a
    third of all rows use is spread over ranges. Of the words, those that no row defines stay where they are while short forms are FEW."""
    found = written(definitions(rows, text, [order]).withColumn("short", lowered(F.col("short"))))
    last = found.groupBy("short", order).agg(F.max_by("long", "at").alias("long"))
    # distinct words first: a text has its words several times; those that differ in case alone are one below
    words = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    words = F.filter(words, lambda w: F.length(w).between(SHORTEST, LONGEST))
    uses = rows.select(order, F.explode(words).alias("short")).select(order, lowered_word(F.col("short")).alias("short"))
    shorts = found.select("short").distinct()
    if shorts.count() <= FEW:
        shorts = F.broadcast(shorts)
    uses = uses.join(shorts, "short", "left_semi")
    events = last.select("short", order, "long", F.lit(False).alias("use")).unionByName(uses.select("short", order, F.lit(None).cast("string").alias("long"), F.lit(True).alias("use")))
    # one row a short form and place, so that a row's own definition isn't before its use
    events = events.groupBy("short", order).agg(F.max("long").alias("long"), F.bool_or("use").alias("use"))
    value = F.when(F.col("long").isNotNull(), F.struct(F.col(order).alias("at"), F.col("long").alias("long")))
    seen = greatest_before(events, order, value, "_seen", group=["short"])
    freed(found)  # the events are written by now
    return seen.where(F.col("use") & F.col("_seen").isNotNull()).select(order, "short", F.col("_seen.long").alias("long"))
