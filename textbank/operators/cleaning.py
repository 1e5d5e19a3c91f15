"""Text cleaning, step by step and as a whole."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textbank.functions.text import let, strip
from textbank.operators.common import short_batches

#: Text whose UTF-8 was read as Latin-1, and what it was meant to be, in order of replacement.
MOJIBAKE = [
    ("\xc3\xa2\xc2\x80\xc2\x99", "’"),
    ("\xc3\xa2\xc2\x80\xc2\x98", "‘"),
    ("\xc3\xa2\xc2\x80\xc2\x9c", "“"),
    ("\xc3\xa2\xc2\x80\xc2\x9d", "”"),
    ("\xc3\xa2\xc2\x80\xc2\x94", "--"),
    ("\xc3\xa2\xc2\x80\xc2\x93", "-"),
    ("\xc3\xa2\xc2\x80\xc2\xa6", "..."),
    ("\xc3\xa2\xc2\x82\xc2\xac", "€"),
    ("\xc3\xa9", "é"),
    ("\xc3\xa8", "è"),
    ("\xc3\xa0", "à"),
    ("\xc3\xa2", "â"),
    ("\xc3\xaa", "ê"),
    ("\xc3\xae", "î"),
    ("\xc3\xb4", "ô"),
    ("\xc3\xbb", "û"),
    ("\xc3\xa7", "ç"),
    ("\xc3\xbc", "ü"),
    ("\xc3\xb6", "ö"),
    ("\xc3\xa4", "ä"),
    ("\xef\xbf\xbd", ""),
]
_SPACE = " \t\n\x0b\f\r"
#: Times that a line may occur in a text.
MOST_REPEATS = 2
#: Ligatures and letter forms.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ſ": "s", "ı": "i"}
#: Quotes, and dashes that become one hyphen or two.
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "′": "'", "″": '"', "´": "'"}
DASHES = {"–": "-", "−": "-"}
LONG_DASHES = {"—": "--", "―": "--"}
#: Invisible characters.
ZERO_WIDTH = r"[​‌‍‎‏﻿­⁠᠎͏]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: Phrases of lines that a publisher prints on every page.
BOILERPLATE = [
    r"This OpenStax book is available for free",
    r"Access for free at openstax\.org",
    r"Access for free at cnx\.org",
    r"OpenStax is part of Rice University",
    r"This work is licensed under a Creative Commons",
    r"Attribution 4\.0 International",
    r"CC BY 4\.0",
    r"©\s*\d{4}\s*Rice University",
]


#: Words in lower case of which every phrase above has one.
BOILERPLATE_WORDS = ("openstax", "cnx.org", "creative commons", "attribution 4.0", "cc by 4.0", "rice university")
_FIRST = {*(wrong[0] for wrong, _ in MOJIBAKE), *LIGATURES, *QUOTES, *DASHES, *LONG_DASHES}
#: Any character but those of Latin-1 that no step on single characters looks for, named one by one, as that is one look into a table.
_LOOKED_FOR = "[^" + "".join(f"\\x{i:02x}" for i in range(256) if chr(i) not in _FIRST and not re.match(ZERO_WIDTH + "|" + CONTROL, chr(i))) + "]"


def fix_mojibake(c: Column) -> Column:
    for wrong, right in MOJIBAKE:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def fix_ligatures(c: Column) -> Column:
    for wrong, right in LIGATURES.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def straighten(c: Column) -> Column:
    """Quotes and dashes in ASCII."""
    c = F.translate(c, "".join([*QUOTES, *DASHES]), "".join([*QUOTES.values(), *DASHES.values()]))
    for wrong, right in LONG_DASHES.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def drop_invisible(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, ZERO_WIDTH, ""), CONTROL, "")


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def compose(c: Column) -> Column:
    """Unicode normal form C."""
    short_batches()
    return _compose(c)


def join_hyphenated(c: Column) -> Column:
    return F.regexp_replace(c, r"-[^\S\n]*+\n\s*+([a-z])(?!\p{M})", "$1")


def join_sentences(c: Column) -> Column:
    """Line breaks inside a sentence as spaces."""
    return F.regexp_replace(c, r"\n(?<![.!?:;]\n)(?=[a-z](?!\p{M}))", " ")


def _may_have_boilerplate(lower: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in BOILERPLATE_WORDS])


def drop_boilerplate(c: Column, phrases: list[str] | None = None) -> Column:
    whole = lambda x, some: F.regexp_replace(x, r"(?imd)^[^\n]*(?:" + "|".join(some) + r")[^\n]*", "")
    if phrases:
        return whole(c, phrases)
    # The last phrase may go over several lines; the others are looked for in lines that have one of their words.
    lines = F.transform(F.split(whole(c, BOILERPLATE[-1:]), "\n"), lambda x: F.struct(x.alias("line"), F.lower(x).alias("lower")))
    return F.array_join(F.transform(lines, lambda x: F.when(_may_have_boilerplate(x["lower"]) & x["line"].rlike("(?i)" + "|".join(BOILERPLATE)), "").otherwise(x["line"])), "\n")


def drop_running_heads(c: Column) -> Column:
    """Lines of a chapter's number and a bar, in either order."""
    return F.regexp_replace(c, r"(?imd)^(?:(?:\d{1,4}\s+)?Chapter\s+\d{1,2}\s*\|[^\n]{0,80}$|[^\n]{0,80}\|\s*Chapter\s+\d{1,2}\s*(?:\d{1,4})?$)", "")


def drop_page_numbers(c: Column) -> Column:
    """Without lines of a number of up to four digits that stand between blank lines or at an end."""
    number, empty = r"^\s*\d{1,4}\s*\z", r"^\s*\z"

    def kept(lines: Column) -> Column:
        blank = lambda i: F.coalesce(F.get(lines, i).rlike(empty), F.lit(True))
        return F.filter(lines, lambda x, i: ~(x.rlike(number) & blank(i - 1) & blank(i + 1)))

    return F.array_join(let(F.split(c, "\n"), kept), "\n")


def drop_pipe_noise(c: Column) -> Column:
    return F.regexp_replace(c, r"(?md)^[|\s]{3,}$", "")


def _limited(lines: list[str]) -> list[str]:
    seen: Counter[str] = Counter()
    kept = []
    for line in lines:
        key = line.strip().lower()
        seen[key] += 1
        if not key or seen[key] <= MOST_REPEATS:
            kept.append(line)
    return kept


@F.pandas_udf(StringType())
def _limit(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "\n".join(_limited(t.split("\n"))), na_action="ignore")


def limit_repeated_lines(c: Column) -> Column:
    """Each line, by its trimmed lower case, at most twice; blank lines always."""
    short_batches()
    return _limit(c)


_NUMBER = re.compile(r"\s*\d{1,4}\s*", re.ASCII).fullmatch
_NOISE = re.compile(r"^[|\s]{3,}$", re.ASCII | re.MULTILINE)


def _finished(t: str) -> str:
    lines = t.split("\n")
    blank = [True, *(not x or not x.strip(_SPACE) for x in lines), True]
    t = "\n".join([x for i, x in enumerate(lines) if not (blank[i] and blank[i + 2] and _NUMBER(x))])
    t = _NOISE.sub("", t)
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
    return "\n".join(_limited(t.split("\n")))


@F.pandas_udf(StringType())
def finish_lines(text: pd.Series) -> pd.Series:
    """drop_page_numbers, drop_pipe_noise, compose and limit_repeated_lines in one pass."""
    return text.map(_finished, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def finish_each(texts: pd.Series) -> pd.Series:
    """finish_lines for each text of an array; null texts stay."""
    return texts.map(lambda own: [t if t is None else _finished(t) for t in own], na_action="ignore")


def tidy_space(c: Column) -> Column:
    c = F.regexp_replace(c, r"[^\S\n]{2,}", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?md)[^\S\n]+$", "")
    return strip(c)


def _characters(c: Column) -> Column:
    """The steps on single characters, taken only where a line has one that they look for."""
    for step in (fix_mojibake, fix_ligatures, straighten, drop_invisible):
        c = step(c)
    return c


def _plain_steps(c: Column) -> Column:
    line = lambda x: F.when(x.rlike(_LOOKED_FOR), _characters(x)).otherwise(x)
    c = F.array_join(F.transform(F.split(c, "\n"), line), "\n")
    for step in (join_hyphenated, join_sentences, drop_boilerplate, drop_running_heads):
        c = step(c)
    return c


def clean(c: Column) -> Column:
    """All steps; null and empty texts as they are. Composition comes late: until then a letter with a mark after it counts as marked."""
    short_batches()
    return F.when(c.isNull() | (c == ""), c).otherwise(tidy_space(finish_lines(_plain_steps(c))))


def clean_each(c: Column) -> Column:
    """clean for each text of an array; null arrays, null texts and empty ones as they are."""
    short_batches()
    return F.transform(finish_each(F.transform(c, _plain_steps)), tidy_space)


def clean_rows(rows: DataFrame, texts: list[str], arrays: list[str] = ()) -> DataFrame:
    """rows with the text columns and each text of the array columns cleaned."""
    return rows.withColumns({**{t: clean(F.col(t)) for t in texts}, **{a: clean_each(F.col(a)) for a in arrays}})


def noise_ratio(c: Column) -> Column:
    """Control, format and surrogate characters, invisible ones three times and boilerplate fifty times, per character, 1 at most."""
    marks = F.regexp_count(c, F.lit(r"[\p{Cc}\p{Cf}\p{Cs}]")) + 3 * F.regexp_count(c, F.lit(ZERO_WIDTH)) + 50 * F.when(_may_have_boilerplate(F.lower(c)), F.regexp_count(c, F.lit(r"(?imd)^[^\n]*(?:" + "|".join(BOILERPLATE) + r")[^\n]*"))).otherwise(0)
    return F.when(F.length(c) > 0, F.least(F.lit(1.0), marks / F.length(c))).otherwise(0.0)


def changed_rows(rows: DataFrame, noise: float = 0.01) -> DataFrame:
    """_id, book_id, text (cleaned), changed: what a back-fill has to write."""
    out = rows.select("_id", "book_id", clean(F.col("text")).alias("cleaned"), F.col("text").alias("before"))
    return out.withColumn("changed", F.coalesce((F.col("cleaned") != F.col("before")) | (noise_ratio(F.col("before")) > noise), F.lit(False))).select("_id", "book_id", F.col("cleaned").alias("text"), "changed")


def noisiest(rows: DataFrame, least: float = 0.005, most: int = 10) -> DataFrame:
    """The noisiest rows with 300 characters before and after cleaning: a report."""
    ratio = F.round(noise_ratio(F.col("text")), 6)
    top = rows.withColumn("noise", ratio).where(F.col("noise") > least).orderBy(F.desc("noise"), "_id").limit(most)
    return top.select("_id", "noise", F.substring("text", 1, 300).alias("before"), F.substring(clean(F.col("text")), 1, 300).alias("after"))
