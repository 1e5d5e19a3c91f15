"""Column functions on text: tokens, keys, answers, replies, numbers."""

from __future__ import annotations

import ast
import html
import math
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, MapType, StringType, StructField, StructType

#: Function words that say nothing about a match.
STOPWORDS = (
    "the", "and", "for", "with", "what", "how", "does", "this", "that", "from", "are", "was", "were", "which", "into", "about", "when", "then",
    "than", "them", "its", "can", "will", "each", "between", "using", "use", "you", "your", "have", "has", "had", "would", "could", "should",
    "there", "their",
)
#: Words of a rubric that are not keywords.
RUBRIC_STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "must", "can", "need", "dare", "and", "or", "but", "if", "in", "on", "at", "to", "for", "of", "with", "by",
    "from", "up", "about", "into", "through", "during", "before", "after", "above", "below", "between", "each", "every", "both", "few", "more",
    "most", "other", "some", "such", "than", "too", "very", "just", "because", "as", "until", "while", "although", "though", "that", "this", "these",
    "those", "it", "its", "they", "them", "their", "1", "2", "3", "4", "5", "mark", "marks", "marks:", "correct", "correct:",
)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body of a column that is computed once, however often body or a lambda in it names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Without ASCII white space of any kind at the ends."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def capital(c: Column) -> Column:
    """The first letter in upper case, the others in lower case, letter by letter: one without a single other form stays (ß, ﬁ), a final sigma is any sigma."""
    first = F.substring(c, 1, 1)
    upper = F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(first)
    return F.concat(upper, F.lower(F.translate(F.substr(c, F.lit(2)), "İΣ", "iσ")))


def matches(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case; false for null."""
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def tokens(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(pattern), F.lit(0))


def distinct_tokens(c: Column) -> Column:
    """Different tokens of three letters or digits and more, without function words, plurals folded."""
    kept = F.filter(tokens(c, "[a-z0-9]{3,}"), lambda t: ~t.isin(*STOPWORDS))
    fold = lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, 1, F.length(t) - 1)).otherwise(t)
    return F.array_distinct(F.transform(kept, fold))


def rubric_keywords(c: Column) -> Column:
    """Words of a rubric that an answer should have, duplicates kept."""
    return F.filter(tokens(c, r"(?U)\b[a-z][a-z0-9\-]{2,}\b"), lambda t: ~t.isin(*RUBRIC_STOPWORDS))


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that are tokens of the answer; 0.5 without keywords."""
    both = F.struct(tokens(answer, r"(?U)\b[a-z][a-z0-9\-]*\b").alias("own"), keywords.alias("keys"))
    return let(both, lambda s: F.when(F.size(s["keys"]) == 0, 0.5).otherwise(F.size(F.filter(s["keys"], lambda k: F.array_contains(s["own"], k))) / F.size(s["keys"])))


def safe_csv(c: Column) -> Column:
    """With a quote in front where a spreadsheet would read a formula."""
    return F.when(c.rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def ellipsis(c: Column, n: int = 80) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def display_name(c: Column) -> Column:
    """Camel case and separators to spaced title case."""
    return F.initcap(strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2"), "[-_]+", " "), " +", " ")))


def content_id(name: Column, content: Column) -> Column:
    """Slug of the name, up to 40 characters, and 16 of the content's SHA-256."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", F.substring(slug, 1, 40), F.substring(F.sha2(content.cast("binary"), 256), 1, 16))


def prefix_key(c: Column, n: int = 80) -> Column:
    return F.lower(strip(F.substring(text_or_empty(c), 1, n)))


def stem_of(question: Column, cap: int = 500) -> Column:
    """What stands before the first option line."""
    return F.substring(strip(F.get(F.split(text_or_empty(question), r"\n[A-D]\.\s"), 0)), 1, cap)


def mask_secrets(c: Column) -> Column:
    """Without the values of keys and bearer tokens."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)(key=)[^&\s]+", "$1***"), r"(?i)(bearer )\S+", "$1***")


def line_options(question: Column) -> Column:
    """Map of the options given one a line as "A. text"; the first of a letter wins."""
    found = F.regexp_extract_all(text_or_empty(question), F.lit(r"(?m)^\s*([A-D])[.)]\s+(.+?)\s*$"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"([A-D])[.)]", 1).alias("key"), strip(F.regexp_replace(x, r"^\s*[A-D][.)]\s+", "")).alias("value")))
    first = lambda letter: F.get(F.filter(pairs, lambda p: p["key"] == letter), 0)
    return F.map_from_entries(F.array_compact(F.array(*[first(x) for x in "ABCD"])))


def option_key(c: Column) -> Column:
    """Lower case, with single spaces and without closing punctuation, to compare options."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(text_or_empty(c))), r"\s+", " "), r"[.;,]+$", "")


def answer_letter(value: Column, options: Column | None = None) -> Column:
    """A to D from a bare letter, a decorated one, or the text of an option; else null."""
    v = strip(text_or_empty(value))
    bare = F.nullif(F.regexp_extract(F.upper(v), r"^\(?([A-D])[).:]?$", 1), F.lit(""))
    decorated = F.nullif(F.upper(F.regexp_extract(v, r"(?i)^(?:option|answer|choice)?\s*(?:is|:)?\s*\(?([A-D])(?:[).:]\s|\)|$)", 1)), F.lit(""))
    if options is None:
        return F.coalesce(bare, decorated)
    by_text = F.get(F.map_keys(F.map_filter(options, lambda _, o: option_key(o) == option_key(v))), 0)
    return F.coalesce(bare, by_text, decorated)


def correct_letter(model_answer: Column, options: Column) -> Column:
    """The letter that a model answer names, or whose option it contains."""
    v = text_or_empty(model_answer)
    named = F.nullif(F.upper(F.regexp_extract(v, r"(?i)\b(?:correct (?:answer|option)|answer|option)\s*(?:is|:)?\s*\(?([A-D])\b", 1)), F.lit(""))
    opening = F.nullif(F.regexp_extract(v, r"^\s*\(?([A-D])[).:]", 1), F.lit(""))
    held = F.get(F.map_keys(F.map_filter(options, lambda _, o: (F.length(o) > 0) & F.contains(option_key(v), option_key(o)))), 0)
    return F.coalesce(named, opening, held)


def true_false(value: Column) -> Column:
    """Boolean of the usual words; null for others."""
    v = F.regexp_replace(strip(F.lower(text_or_empty(value))), r"[.!]+$", "")
    return F.when(v.isin("true", "t", "yes", "y", "correct"), True).when(v.isin("false", "f", "no", "n", "incorrect"), False)


def true_false_key(model_answer: Column) -> Column:
    """True or False from an explicit word, a negation or an affirmation; True if there is none."""
    v = strip(F.lower(text_or_empty(model_answer)))
    return (
        F.when(v.rlike(r"^(the statement is )?false\b"), "False")
        .when(v.rlike(r"^(the statement is )?true\b"), "True")
        .when(v.rlike(r"\bfalse\b|\bincorrect\b|\bnot (true|correct)\b|\bno\b|\bnever\b|\bcannot\b|n't\b"), "False")
        .otherwise("True")
    )


def delimiters_balanced(c: Column) -> Column:
    """Parentheses in pairs; with LaTeX, dollar signs and braces too."""
    latex = c.rlike(r"\\[a-zA-Z]+")
    count = lambda x: F.regexp_count(c, F.lit(x))
    return (count(r"\(") == count(r"\)")) & (~latex | ((count(r"\$") % 2 == 0) & (count(r"\{") == count(r"\}"))))


def needs_latex(c: Column) -> Column:
    """Whether formulas stand in the text without dollar signs."""
    return F.coalesce(~c.contains("$") & c.rlike(r"[√∑∫±≤≥≠^]|\bsqrt\(|\\frac|[a-zA-Z]_[a-zA-Z0-9]"), F.lit(False))


def rewrite_ok(original: Column, rewritten: Column) -> Column:
    """A rewrite of plausible length that has dollar signs."""
    n = F.length(original)
    return F.coalesce((F.length(rewritten) >= 0.6 * n) & (F.length(rewritten) <= 3 * n + 120) & rewritten.contains("$"), F.lit(False))


def strip_fences(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?m)^```[a-zA-Z]*\s*$", ""))


def option_value(c: Column) -> Column:
    """The first number of an option; null if it has none."""
    return F.regexp_extract(F.replace(text_or_empty(c), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def within_tolerance(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Relative difference to b of at most tolerance."""
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12)) <= tolerance


def four_figures(x: Column) -> Column:
    """x rounded to four significant figures."""
    digits = F.pow(F.lit(10.0), 3 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * digits) / digits)


def unmangle_latex(c: Column) -> Column:
    """Form feeds and backspaces that swallowed the start of a LaTeX command, as commands again."""
    return F.replace(F.replace(c, F.lit("\x08"), F.lit("\\b")), F.lit("\x0c"), F.lit("\\f"))


def stringify_map(c: Column) -> Column:
    """A map of strings as "Key: value." sentences."""
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), e["value"], F.lit("."))), " ")


#: A book's own labels, and what a reader is told instead.
LABELS = {"table": "table", "figure": "figure", "fig.": "figure", "chart": "chart", "example": "example", "exercise": "exercise"}
LABEL = r"(?:Table|Figure|Fig\.|Chart|Example|Exercise)\s+\d+(?:\.\d+)+"


def generic_labels(c: Column) -> Column:
    """Numbered labels of the book ("Table 1.9") as "the table below", with a capital where a sentence starts."""
    for label, name in LABELS.items():
        word = label.replace(".", r"\.")
        c = F.regexp_replace(c, rf"(?i)(^|[.!?]\s+)(?:the\s+)?{word}\s+\d+(?:\.\d+)+", f"$1The {name} below")
        c = F.regexp_replace(c, rf"(?i)\b(?:the\s+)?{word}\s+\d+(?:\.\d+)+", f"the {name} below")
    return c


def throttle_class(status: Column, body: Column) -> Column:
    """none, transient or quota, from a reply's status and text."""
    squashed = F.regexp_replace(F.lower(text_or_empty(body)), r"[\s_\-]+", "")
    return F.when(status != 429, "none").when(squashed.rlike("insufficientquota|perday|daily|billing|quotaexceeded"), "quota").otherwise("transient")


def retry_after(body: Column) -> Column:
    """Seconds that a reply asks to wait; null if it names none."""
    return F.regexp_extract(F.lower(text_or_empty(body)), r"(?:retry|try again)[^0-9]{0,20}(\d+(?:\.\d+)?)\s*s", 1).try_cast("double")


def json_array(raw: Column, schema: str) -> Column:
    """The array of objects in a reply; an unfinished last object is cut off; null if there is none."""
    span = F.regexp_extract(text_or_empty(raw), r"(?s)\[.*\]", 0)
    cut = F.concat(F.regexp_extract(text_or_empty(raw), r"(?s)(\[.*\})", 1), F.lit("]"))
    kind = f"array<{schema}>"
    return F.coalesce(F.from_json(F.nullif(span, F.lit("")), kind), F.from_json(F.nullif(cut, F.lit("]")), kind))


def marking_reply(raw: Column, max_marks: Column) -> Column:
    """Struct of mark (within 0 and max_marks), feedback and parsed from a marker's reply.

    Read as it is, with lone backslashes doubled, and without control characters;
    failing these, the mark is searched for in the text.
    """
    body = F.regexp_extract(text_or_empty(raw), r"(?s)\{.*\}", 0)
    kind = "struct<mark:double,feedback:string>"
    doubled = F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', r"\\\\\\\\")
    plain = F.regexp_replace(doubled, r"[\x00-\x1f]", " ")
    tries = [F.from_json(F.nullif(x, F.lit("")), kind) for x in (body, doubled, plain)]
    found = F.coalesce(*[F.when(t["mark"].isNotNull(), t) for t in tries])
    salvaged = F.regexp_extract(text_or_empty(raw), r'"?mark"?\s*[:=]\s*(-?\d+(?:\.\d+)?)', 1).try_cast("double")
    mark = F.coalesce(found["mark"], salvaged)
    return F.struct(F.when(mark.isNotNull(), F.greatest(F.lit(0.0), F.least(max_marks.cast("double"), mark))).alias("mark"), F.coalesce(found["feedback"], F.lit("")).alias("feedback"), mark.isNotNull().alias("parsed"))


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}
_FUNCTIONS = {"sqrt": math.sqrt, "log": math.log, "log10": math.log10, "exp": math.exp, "abs": abs, "factorial": math.factorial, "comb": math.comb, "round": round}


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return node.value
    if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
        return _OPERATORS[type(node.op)](_value(node.operand))
    if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
        a, b = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow) and (abs(b) > 100 or abs(a) > 1e6):
            raise ValueError("power out of range")
        return _OPERATORS[type(node.op)](a, b)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and not node.keywords:
        args = [_value(a) for a in node.args]
        if node.func.id in ("factorial", "comb") and any(a > 170 for a in args):
            raise ValueError("argument out of range")
        return _FUNCTIONS[node.func.id](*args)
    raise ValueError("not arithmetic")


@F.pandas_udf(DoubleType())
def arithmetic(expression: pd.Series) -> pd.Series:
    """Value of an arithmetic expression; null for anything else, too long or out of range."""

    def one(e: str | None) -> float | None:
        try:
            v = float(_value(ast.parse(e.replace("^", "**"), mode="eval"))) if e and len(e) <= 200 else None
        except (ValueError, SyntaxError, ArithmeticError, TypeError, RecursionError, AttributeError):
            return None
        return v if v is not None and math.isfinite(v) else None

    return pd.Series([one(e) for e in expression], dtype="float64")


_RULE = re.compile(r"^[-: ]+$")


@F.pandas_udf(StructType([StructField("html", StringType()), StructField("n_blanks", IntegerType())]))
def table_html(markdown: pd.Series) -> pd.DataFrame:
    """A pipe table as HTML, and how many of its cells are question marks or empty below the header."""

    def one(md: str | None) -> tuple[str, int]:
        rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in (md or "").split("\n") if line.count("|") >= 2]
        rows = [r for r in rows if not all(_RULE.match(c) for c in r)]
        if len(rows) < 2:
            return f"<pre>{html.escape(md or '')}</pre>", 0
        width = len(rows[0])
        blanks, out = 0, ["<table><thead><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in rows[0]) + "</tr></thead><tbody>"]
        for r in rows[1:]:
            cells = (r + [""] * width)[:width]
            blanks += sum(c in ("", "?") for c in cells)
            out.append("<tr>" + "".join(f"<td>{html.escape(c or '?')}</td>" for c in cells) + "</tr>")
        return "".join([*out, "</tbody></table>"]), blanks

    return pd.DataFrame([one(m) for m in markdown], columns=["html", "n_blanks"])


_MARK = re.compile(r"(?<![A-Za-z0-9])\(?([A-D])[).:]\s+")


@F.pandas_udf(StructType([StructField("stem", StringType()), StructField("options", MapType(StringType(), StringType()))]))
def split_mcq(question: pd.Series) -> pd.DataFrame:
    """Stem and options of a question with options in its text: the first run of A, B, C (and D) marks; text from an answer line on is dropped."""

    def one(q: str | None) -> tuple[str, dict[str, str]]:
        text = re.split(r"(?im)^\s*(?:correct\s+)?answer\s*:", q or "")[0]
        marks = list(_MARK.finditer(text))
        for i, m in enumerate(marks):
            run = [m]
            for other in marks[i + 1 :]:
                if len(run) < 4 and other.group(1) == "ABCD"[len(run)]:
                    run.append(other)
            if m.group(1) == "A" and len(run) >= 3:
                ends = [*(r.start() for r in run[1:]), len(text)]
                values = [re.sub(r"\s+", " ", text[r.end() : e]).strip() for r, e in zip(run, ends, strict=True)]
                return text[: m.start()].strip(), dict(zip("ABCD", values, strict=False))
        return text.strip(), {}

    return pd.DataFrame([one(q) for q in question], columns=["stem", "options"])


def chunk_score(density: Column, formula: Column, example: Column, terms: Column) -> Column:
    """How much there is to ask about a chunk: density, formulas, examples and more than two terms; 1 at most."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return F.least(F.lit(1.0), 0.5 * density + 0.2 * flag(formula) + 0.2 * flag(example) + 0.1 * flag(F.size(terms) > 2))


def concept_queries(question: Column, rubric: Column, most: int = 3) -> Column:
    """Up to three different queries about an answer: the question, its beginning up to a comma or question mark, and the rubric's beginning."""
    parts = F.array(F.substring(strip(text_or_empty(question)), 1, 300), strip(F.regexp_extract(text_or_empty(question), r"^[^,?.]{8,}", 0)), F.substring(strip(text_or_empty(rubric)), 1, 200))
    full = F.filter(parts, lambda p: p != "")
    keys = F.transform(full, F.lower)
    return F.slice(F.filter(full, lambda p, i: F.array_position(keys, F.lower(p)) == i + 1), 1, most)


def prompt_block(text: Column, chapter: Column, section: Column, tables: Column, images: Column, cap: int = 2000) -> Column:
    """A chunk as a prompt shows it: headings, what else it holds, text."""
    mark = lambda c, name: F.when(F.size(c) > 0, F.concat(F.lit(f"[{name}: "), F.size(c).cast("string"), F.lit("]")))
    return F.concat_ws("\n", F.concat_ws(" > ", F.nullif(chapter, F.lit("")), F.nullif(section, F.lit(""))), mark(tables, "tables"), mark(images, "figures"), F.substring(text_or_empty(text), 1, cap))


def has_inline_table(c: Column) -> Column:
    """Whether a text carries a table itself: HTML, or two lines with two bars."""
    return F.contains(F.lower(c), F.lit("<table")) | (F.size(F.filter(F.split(c, "\n"), lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2)) >= 2)
