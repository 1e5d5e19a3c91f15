"""Structure of a book: chapter and section headings, packing of pages, and what makes a block worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbank.functions.text import matches, strip, text_or_empty
from textbank.operators.folds import carried_last, composed, latch, packing

#: Forms of a chapter heading, most certain first; number, then title.
CHAPTER_FORMS = [
    r"(?md)^[ \t]*[Cc]hapter[ \t]+(\d{1,3})[ \t]*[:|]?[ \t]+([A-Z][^\n]{3,80})",
    r"(?md)^[ \t]*CHAPTER[ \t]+(\d{1,3})[ \t]*[:|]?[ \t]+([A-Z][^\n]{3,80})",
    r"(?md)^[ \t]*(\d{1,2})\.?[ \t]{1,4}([A-Z][a-zA-Z ]{5,70})[ \t]*$",
]
#: Titles of what is not a chapter.
FRONT_MATTER = r"^(?:preface|foreword|acknowledg(?:e)?ments?|table\s+of\s+contents|contents|copyright|dedication|about\s+the\s+authors?|answer\s+key|answers?|solutions?|glossary|references|bibliography|index)$"
#: A line of a table of contents.
CONTENTS_LINE = r"^\s*(?:(?:chapter\s+)?\d{1,2}\.?\s+[A-Z][^\n]{3,90}|[A-Z][A-Za-z ]{3,90})\s*(?:\.{2,}|\s{3,})\s*\d{1,4}\s*$"
SECTION = r"(?md)^(\d{1,2}\.\d{1,2})\s+([A-Z][^\n]{5,80})$"
#: Words of teaching text.
TEACHING = (
    r"\bdefin(?:ition|e[sd]?)\b|\btheor(?:em|y)\b|\bformula\b|\bexample\s+\d+\b|\bsolution\b|\bnote\b|\bproperties?\s+of\b|\bif\s+x\s+is\b|\bwhere\b|\bequals?\b"
    r"|\bstandard\s+deviation\b|\bmean\b|\bprobability\b|\bdistribution\b|\bhypothesis\b|\bregression\b|\bvariance\b|\bconfidence\b|\bcorrelation\b"
)
#: Headings of text to skip.
SKIP = (
    r"\bpractice\s+test\b|\bbring(?:ing)?\s+it\s+together\b|\bhomework\b|\breview\s+questions?\b|\bchapter\s+review\b|\bkey\s+terms?\b|\bthis\s+openstax\b"
    r"|\bdownload\s+for\s+free\b|\btable\s+of\s+contents\b|\bappendix\b|\bindex\b"
)
#: Terms of the subject.
TERMS = (
    r"\b(Standard Deviation|Variance|Mean|Median|Mode|Probability|Distribution|Hypothesis|Regression|Correlation|Confidence Interval|Central Limit Theorem|Normal Distribution"
    r"|Binomial|Poisson|Chi-Square|ANOVA|p-value|t-test|z-score|F-ratio|Type I|Type II)\b"
)
#: Signs of a formula.
FORMULA = r"[=÷×±√∑∫µσ²]|\b\w+\s*=\s*[\w\d()\[\]]+\s*/|[A-Za-z]\s*[₀₁₂]\b|χ²"


def lines_of(c: Column) -> Column:
    """Lines with something on them."""
    return F.filter(F.split(text_or_empty(c), "\r\n|\n|\r"), lambda x: x.rlike(r"\S"))


def heading_title(c: Column) -> Column:
    """A title without leaders and page number; a vertical tab is no blank here, and only the end is one."""
    ends = lambda x: F.trim(x, F.lit(" \t\n\f\r"))
    c = F.regexp_replace(ends(c), r"[ \t\n\f\r]*\.{2,}[ \t\n\f\r]*\d+[ \t\n\f\r]*\z", "")
    c = F.regexp_replace(c, r"[ \t\n\f\r]+\d{1,4}[ \t\n\f\r]*\z", "")
    return ends(F.regexp_replace(c, r"([ \t\n\f\r]*\.[ \t\n\f\r]*){2,}\z", ""))


def is_front_matter(title: Column) -> Column:
    return matches(F.regexp_replace(F.trim(title, F.lit(" \t\n\f\r")), r"[ \t\n\f\r]+", " "), FRONT_MATTER[:-1] + r"\z")


def chapter_heading(text: Column) -> Column:
    """Struct of num and title of the first sound heading, by the most certain form; null without one."""

    def of(form: str) -> Column:
        found = F.regexp_extract_all(text_or_empty(text), F.lit(form), F.lit(0))
        parts = F.transform(found, lambda x: F.struct(F.regexp_extract(x, form, 1).try_cast("int").alias("num"), heading_title(F.regexp_extract(x, form, 2)).alias("title")))
        return F.get(F.filter(parts, lambda p: p["num"].between(1, 50) & (F.length(p["title"]) >= 4) & ~is_front_matter(p["title"])), 0)

    return F.coalesce(*[of(f) for f in CHAPTER_FORMS])


def is_contents_page(text: Column) -> Column:
    lines = F.transform(lines_of(text), strip)
    named = F.contains(F.lower(F.array_join(F.slice(lines, 1, 12), " ")), F.lit("table of contents"))
    return named | (F.size(F.filter(F.slice(lines, 1, 80), lambda x: matches(x, CONTENTS_LINE))) >= 4)


def teaching_density(text: Column) -> Column:
    """Share of full lines that have a word of teaching text; 0 without lines."""
    lines = lines_of(text)
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: matches(x, TEACHING))) / F.size(lines)).otherwise(0.0)


def is_skip_block(text: Column, density: float = 0.15) -> Column:
    """Blank, mostly numbered exercises, or under a heading to skip with little teaching text."""
    every = F.split(text_or_empty(text), "\r\n|\n|\r")
    numbered = F.size(F.filter(every, lambda x: x.rlike(r"^\s*\d{1,3}\.\s+[A-Z]"))) / F.size(every)
    return (~F.coalesce(text.rlike(r"\S"), F.lit(False))) | (numbered > 0.35) | (matches(F.substring(text, 1, 300), SKIP) & (teaching_density(text) < density))


def key_terms(text: Column) -> Column:
    """Defined terms, then terms of the subject, in lower case, each once, longer than three characters."""
    defined = F.regexp_extract_all(text_or_empty(text), F.lit(r"([A-Z][a-z]+(?:\s+[A-Z]?[a-z]+){0,4})\s+(?:is|are)\s+(?:defined|called|known)"), F.lit(1))
    known = F.regexp_extract_all(text_or_empty(text), F.lit("(?i)" + TERMS), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(defined, known), lambda t: F.lower(strip(t))), lambda t: F.length(t) > 3))


def has_formula(text: Column) -> Column:
    return F.coalesce(text.rlike(FORMULA), F.lit(False))


def has_example(text: Column) -> Column:
    return matches(text, r"\bExample\s+\d+")


def topic(title: Column) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.lit("General"))


def garbled(text: Column) -> Column:
    """Whether less than 0.4 of the bytes are ASCII."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.nullif(F.octet_length(text), F.lit(0)) < 0.4, F.lit(False))


def formula_lines(text: Column) -> Column:
    return F.filter(F.split(text_or_empty(text), "\n"), lambda x: x.rlike(r"[=√∑∫±≤≥^]") & (F.length(strip(x)) >= 4))


def table_rows(grid: Column, least: float = 0.2) -> Column:
    """A grid of cells as pipe-joined rows, if it has two rows and enough filled cells; else null."""
    cells = F.flatten(grid)
    filled = F.size(F.filter(cells, lambda x: F.coalesce(x.rlike(r"\S"), F.lit(False))))
    return F.when((F.size(grid) >= 2) & (F.try_divide(filled, F.size(cells)) >= least), F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, text_or_empty), " | ")), "\n"))


def latch_chapters(headings: DataFrame, rule: str = "next", pieces: int | None = None) -> DataFrame:
    """book_id, page, num, title, accepted of headings (book_id, page, num, title).

    In order of page, number and title a heading is accepted if it is a book's
    first, repeats the current chapter, or, by rule "next", is the next one, or
    goes back to 1 once; by rule "near" it is at most three further. One row a
    heading; those without a number are left out. A book lies over as many pieces
    as it needs, each mapped from every chapter number that occurs.
    """
    rows = headings.where("num IS NOT NULL").select("book_id", F.col("page").cast("int").alias("page"), F.col("num").cast("int").alias("num"), "title")
    numbers = sorted(r[0] for r in rows.select("num").distinct().collect())
    return composed(rows, ["book_id"], ["page", "num", "title"], latch(rule, numbers), pieces)


def carry_forward(pages: DataFrame, chapters: DataFrame, pieces: int | None = None) -> DataFrame:
    """pages (book_id, page, text) with chapter_num, chapter_title and section_title in force on each page.

    chapters are accepted headings. A section holds until the next; a chapter
    starts with "Introduction". A book lies over as many pieces as it needs.
    """
    heads = chapters.where("accepted").select("book_id", "page", F.col("num").alias("num_"), F.col("title").alias("title_"))
    section = F.get(F.reverse(F.regexp_extract_all(text_or_empty(F.col("text")), F.lit(SECTION), F.lit(2))), 0)
    joined = pages.join(heads, ["book_id", "page"], "left").withColumn("section_", F.coalesce(section, F.when(F.col("num_").isNotNull(), "Introduction")))
    out = carried_last(joined, ["book_id"], ["page", "num_"], {"num_": "chapter_num", "title_": "chapter_title", "section_": "section_title"}, pieces)
    return out.withColumn("section_title", F.coalesce("section_title", F.lit("Introduction"))).drop("num_", "title_", "section_")


def section_headings(pages: DataFrame) -> DataFrame:
    """book_id, page, place, number, title: every section heading."""
    found = pages.select("book_id", "page", F.posexplode(F.regexp_extract_all(text_or_empty(F.col("text")), F.lit(SECTION), F.lit(0))).alias("place", "raw"))
    return found.select("book_id", "page", "place", F.regexp_extract("raw", SECTION, 1).alias("number"), F.regexp_extract("raw", SECTION, 2).alias("title"))


def pack_pages(pages: DataFrame, size: int = 3000, pieces: int | None = None) -> DataFrame:
    """book_id, segment, block, page_start, page_end, text: pages joined greedily until a block has `size` characters or a boundary comes.

    pages has book_id, page, text, boundary (the page opens a chapter or section);
    a null text is empty. Pages are told their block piece by piece, however long
    the book, and gathered by block, of which none has more than `size` characters
    and one page.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pages.select("book_id", F.col("page").cast("long").alias("page"), text.alias("text"), F.length(text).alias("length_"), F.coalesce("boundary", F.lit(False)).alias("boundary"))
    labelled = composed(rows, ["book_id"], ["page", "text"], packing(size), pieces)
    gathered = labelled.groupBy("book_id", "segment", "block").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("own"))
    return gathered.select("book_id", "segment", "block", F.col("own")[0]["page"].alias("page_start"), F.element_at("own", -1)["page"].alias("page_end"), F.array_join(F.transform("own", lambda x: x["text"]), "\n").alias("text"))


def keep_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of 40 characters and more that are not to be skipped."""
    return blocks.where((F.length("text") >= 40) & ~is_skip_block(F.col("text")))


def describe(blocks: DataFrame) -> DataFrame:
    """blocks with teaching_density, key_terms, has_formula and has_example."""
    t = F.col("text")
    return blocks.withColumns({"teaching_density": F.round(teaching_density(t), 6), "key_terms": key_terms(t), "has_formula": has_formula(t), "has_example": has_example(t)})


def list_chapters(headings: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, num, title: the first title of each number; (0, "Entire Document") for a book without one."""
    first = headings.groupBy("book_id", "num").agg(F.min_by("title", "page").alias("title"))
    rest = books.select("book_id").distinct().join(first.select("book_id").distinct(), "book_id", "left_anti").select("book_id", F.lit(0).alias("num"), F.lit("Entire Document").alias("title"))
    return first.unionByName(rest)


def triage_descriptions(rows: DataFrame) -> DataFrame:
    """_id, extra_text, image_texts from descriptions (_id, pos, description): "TEXT:" goes to the text, "CHART:" to the images, "NO_CHART" nowhere."""
    d = strip(F.col("description"))
    upper = F.upper(d)
    kind = F.when(upper.startswith("TEXT:"), "text").when(upper.startswith("NO_CHART"), "none").otherwise("image")
    body = strip(F.regexp_replace(d, r"(?i)^(TEXT|CHART):", ""))
    parts = rows.select("_id", F.struct("pos", kind.alias("kind"), body.alias("body")).alias("p")).groupBy("_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    of = lambda k: F.transform(F.filter("ps", lambda p: (p["kind"] == k) & (p["body"] != "")), lambda p: p["body"])
    return parts.select("_id", F.array_join(of("text"), "\n").alias("extra_text"), of("image").alias("image_texts"))
