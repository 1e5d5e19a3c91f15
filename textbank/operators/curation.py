"""Curation of a question bank: normalising, near-duplicates, quotas, gates, repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textbank.functions.text import LABEL, answer_letter, correct_letter, delimiters_balanced, let, line_options, matches, option_value, prefix_key, strip, text_or_empty, true_false, true_false_key, within_tolerance
from textbank.operators.chunking import sentences

#: What a question may be, and the level that goes with a difficulty.
TYPES = ("mcq", "true_false", "short_answer")
DIFFICULTIES = ("easy", "medium", "hard")
DEFAULT_LEVEL = {"easy": "L1", "medium": "L3", "hard": "L5"}
LEVELS = ("L1", "L2", "L3", "L4", "L5")
#: The share of each level in a bank.
LEVEL_SHARES = {"L1": 0.15, "L2": 0.20, "L3": 0.30, "L4": 0.20, "L5": 0.15}
#: Levels allowed for each difficulty.
BANDS = {"easy": ("L1", "L2"), "medium": ("L3", "L4"), "hard": ("L5",)}
#: What a stem says when it needs a table, a figure, or a value to be found.
TABLE_REFERENCE = r"\bthe (?:following |data )?table\b|\bfollowing table\b|\bin the table\b|\btable\s+\d+\b|\bthe data (?:below|above)\b|\bdata (?:in|from) the table\b|\bthe table (?:below|above)\b"
FIGURE_REFERENCE = (
    r"\bshown (?:below|above|in the figure)\b|\bthe (?:figure|graph|chart|plot|histogram|diagram)\s+(?:below|above)\b|\b(?:figure|graph|chart|plot|exhibit)\s+\d+\b"
    r"|\bin the (?:figure|graph|chart|plot|histogram|diagram)\b|\b(?:according to|based on) the (?:figure|graph|chart|plot|diagram)\b"
)
FILL_IN = r"\b(find|compute|calculate|determine|fill in|complete the table|missing|the value of|solve for|what is the (?:value|probability|mean|variance))\b"
DANGLING = r"(?:,|=|\+|\bthe|\ba|\ban|\bof|\bto|\band|\bor|\bis|\bare|\bwith|\bfor|\bwhere|\bwhen|\bwhich|\bthan|\bbecause|\bso that)\s*$"
#: Openings of questions that only ask for recall.
TRIVIAL = r"^\s*(?:what is (?:the definition|a|an|meant)|define|name|list|state|who|when|which of the following (?:is|are) (?:the )?(?:definition|example))\b"


def validate(questions: DataFrame, expected: str = "short_answer") -> DataFrame:
    """Questions with a text and an answer, with sound type, marks, difficulty and level."""
    kind = F.lower(strip(text_or_empty(F.col("question_type"))))
    kind = F.when(kind.isin(*TYPES), kind).otherwise(expected)
    kind = F.when(matches(F.col("question_text"), r"^\s*true or false"), "true_false").otherwise(kind)
    difficulty = F.lower(strip(text_or_empty(F.col("difficulty"))))
    difficulty = F.when(difficulty.isin(*DIFFICULTIES), difficulty).otherwise("medium")
    level = F.upper(strip(text_or_empty(F.col("bloom_level"))))
    default = F.when(difficulty == "easy", "L1").when(difficulty == "hard", "L5").otherwise("L3")
    sound = questions.where((strip(text_or_empty(F.col("question_text"))) != "") & (strip(text_or_empty(F.col("model_answer"))) != ""))
    return sound.withColumns({"question_text": strip(F.col("question_text")), "model_answer": strip(F.col("model_answer")), "question_type": kind, "difficulty": difficulty, "bloom_level": F.when(level.isin(*LEVELS), level).otherwise(default), "max_marks": F.coalesce(F.col("max_marks").try_cast("double"), F.lit(5.0))})


#: Options for letters that a question lacks, with the topic in them, and what comes when these are used up.
DISTRACTORS = (
    "It applies only when every observed value in {topic} is identical.",
    "It removes the need to check the conditions or assumptions of the method.",
    "It reverses the interpretation of the relationship described in the question.",
    "It treats a sample result as if it were always the exact population value.",
    "It is unrelated to probability, sampling, or statistical inference.",
)
LAST_DISTRACTOR = "An incorrect interpretation of {topic}."
NO_ANSWER = "The best answer correctly applies the concept in the question."


#: How a model answer names its letter before it says what the answer is.
ANSWER_LEADS = (r"(?i)^\s*(?:the\s+)?(?:correct\s+)?(?:answer|option|choice)(?:\s+is)?\s*[:\-]?\s*[A-D][).:\-]?\s*", r"(?i)^\s*[A-D][).:\-]\s*")


def _topical(form: str, topic: Column) -> Column:
    before, _, after = form.partition("{topic}")
    return F.concat(F.lit(before), topic, F.lit(after)) if "{topic}" in form else F.lit(form)


def answer_as_option(model_answer: Column) -> Column:
    """A model answer as the text of an option: without a letter in front, its first sentence or 180 characters if it is long."""
    text = strip(F.regexp_replace(text_or_empty(model_answer), r"\s+", " "))
    for lead in ANSWER_LEADS:
        text = strip(F.regexp_replace(text, lead, ""))
    first = strip(F.get(F.split(text, r"(?<=[.!?])\s+", 2), 0))
    short = F.when(F.length(first).between(20, 180), first).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, 180), r"[ ,;:]+$", ""), F.lit(".")))
    return F.when(text == "", NO_ANSWER).when(F.length(text) > 180, short).otherwise(text)


def normalise_mcq(questions: DataFrame) -> DataFrame:
    """mcq rows with options (map of A to D), a rebuilt text, correct_answer and filled (the letters that were made up).

    Given options come before those in the text. The key is the stored letter, or
    what the model answer says, or A; its option, if missing, is the model answer.
    Other missing options are filled with distractors about the topic (topic_tag,
    if there is such a column), none of them the correct text.
    """
    inline = line_options(F.col("question_text"))
    given = F.coalesce(F.col("options"), F.create_map().cast("map<string,string>"))
    found = lambda x: F.coalesce(F.nullif(strip(given[x]), F.lit("")), F.nullif(strip(inline[x]), F.lit("")))
    own = F.map_filter(F.create_map(*[v for x in "ABCD" for v in (F.lit(x), found(x))]), lambda _, v: v.isNotNull())
    stem = strip(F.get(F.split("question_text", r"\n\s*[A-D][.)]\s"), 0))
    out = questions.withColumns({"options": own, "stem_": stem})
    key = F.coalesce(answer_letter(F.col("correct_answer"), F.col("options")), correct_letter(F.col("model_answer"), F.col("options")), F.lit("A"))
    topic = F.coalesce(F.nullif(strip(F.col("topic_tag")), F.lit("")), F.lit("this topic")) if "topic_tag" in questions.columns else F.lit("this topic")
    out = out.withColumn("correct_answer", key).withColumn("correct_", F.coalesce(F.col("options")[F.col("correct_answer")], answer_as_option(F.col("model_answer"))))
    wrong = F.filter(F.array(*[_topical(d, topic) for d in DISTRACTORS]), lambda d: F.lower(d) != F.lower("correct_"))
    missing = F.filter(F.array(*map(F.lit, "ABCD")), lambda x: F.col("options")[x].isNull() & (x != F.col("correct_answer")))
    out = out.withColumns({"filled": missing, "wrong_": F.slice(wrong, 1, 3)})
    full = lambda x: F.coalesce(F.col("options")[x], F.when(F.col("correct_answer") == x, F.col("correct_")), F.get("wrong_", (F.array_position("filled", F.lit(x)) - 1).cast("int")), _topical(LAST_DISTRACTOR, topic))
    out = out.withColumn("options", F.create_map(*[v for x in "ABCD" for v in (F.lit(x), full(x))]))
    text = F.concat(F.col("stem_"), *[F.concat(F.lit(f"\n{x}. "), F.col("options")[x]) for x in "ABCD"])
    return out.withColumn("question_text", text).drop("stem_", "correct_", "wrong_")


def derive_key(questions: DataFrame) -> DataFrame:
    """questions with correct_answer filled in where it can be derived: a letter, or True and False; what is stored stays."""
    options = line_options(F.col("question_text"))
    derived = F.when(F.col("question_type") == "mcq", correct_letter(F.col("model_answer"), options)).when(F.col("question_type") == "true_false", true_false_key(F.col("model_answer")))
    return questions.withColumn("correct_answer", F.coalesce(F.nullif(strip(F.col("correct_answer")), F.lit("")), derived))


def dedup_by_prefix(questions: DataFrame, n: int = 80, order: str = "_id") -> DataFrame:
    """The first row of each beginning of n characters; rows without text are dropped."""
    keyed = questions.withColumn("key_", prefix_key(F.col("question_text"), n)).where("key_ <> ''")
    return keyed.withColumn("n_", F.row_number().over(Window.partitionBy("key_").orderBy(order))).where("n_ = 1").drop("key_", "n_")


def keep_first_of_similar(rows: DataFrame, pairs: DataFrame, cut, max_rounds: int | None = None) -> DataFrame:  # noqa: ANN001
    """rows (_id) without those similar to an earlier row that is kept itself; pairs (a, b) with a < b are similar.

    Row by row this is a loop; here each round keeps rows without an undecided
    earlier neighbour and drops their neighbours, which gives the same rows. cut
    materialises a frame between rounds. Rounds go on until no pair is open; a
    chain needs one for two of its rows. If max_rounds is given and pairs are
    still open after it, an error is raised.
    """
    edges = cut(pairs.select("a", "b").distinct())
    dropped: list[DataFrame] = []
    rounds = 0
    while not edges.isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"similar pairs are still open after {rounds} rounds")
        rounds += 1
        waiting = edges.select(F.col("b").alias("_id")).distinct()
        # Heads: earlier ends of open pairs that wait for nothing.
        heads = edges.select(F.col("a").alias("_id")).distinct().join(waiting, "_id", "left_anti")
        gone = cut(edges.join(heads.withColumnRenamed("_id", "a"), "a", "left_semi").select(F.col("b").alias("_id")).distinct())
        if gone.isEmpty():  # the least end of all pairs is a head, unless a pair is not in order
            raise ValueError("similar pairs must have a < b")
        dropped.append(gone)
        edges = cut(edges.join(gone.withColumnRenamed("_id", "a"), "a", "left_anti").join(gone.withColumnRenamed("_id", "b"), "b", "left_anti").join(heads.withColumnRenamed("_id", "a"), "a", "left_anti"))
    return rows.join(reduce(DataFrame.unionByName, dropped), "_id", "left_anti") if dropped else rows


def drop_bank_duplicates(rows: DataFrame, similar: DataFrame) -> DataFrame:
    """rows without those that similar (a = bank, b = row) names."""
    return rows.join(similar.select(F.col("b").alias("_id")).distinct(), "_id", "left_anti")


def level_gaps(questions: DataFrame, target: int) -> DataFrame:
    """bloom_level, target, n, needed for levels of which there is less than half the target."""
    shares = F.array(*[F.struct(F.lit(k).alias("bloom_level"), F.lit(max(1, round(target * v))).alias("target")) for k, v in LEVEL_SHARES.items()])
    wanted = questions.sparkSession.range(1).select(F.inline(shares))
    n = questions.groupBy("bloom_level").agg(F.count("*").alias("n"))
    out = wanted.join(n, "bloom_level", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.where(F.col("n") < F.col("target") / 2).withColumn("needed", F.col("target") - F.col("n"))


def balance_levels(questions: DataFrame, group: str, target: int) -> DataFrame:
    """Up to `target` questions of each group: each level's quota in input order, level by level, then the rest in input order."""
    place = F.row_number().over(Window.partitionBy(group, "bloom_level").orderBy("_id"))
    quota = F.coalesce(*[F.when(F.col("bloom_level") == k, F.lit(max(1, round(target * v)))) for k, v in LEVEL_SHARES.items()], F.lit(0))
    in_quota = place <= quota
    ranked = questions.withColumn("over", F.when(in_quota, 0).otherwise(1))
    slot = F.row_number().over(Window.partitionBy(group).orderBy("over", F.when(F.col("over") == 0, F.col("bloom_level")), "_id"))
    return ranked.withColumn("slot", slot).where(F.col("slot") <= target)


def enforce_band(questions: DataFrame) -> DataFrame:
    """bloom_level moved to the first allowed one for the difficulty where it lies outside."""
    outside = F.coalesce(*[F.when((F.col("difficulty") == d) & ~F.col("bloom_level").isin(*levels), F.lit(levels[0])) for d, levels in BANDS.items()])
    return questions.withColumn("bloom_level", F.coalesce(outside, F.col("bloom_level")))


def drop_trivial(questions: DataFrame, group: str) -> DataFrame:
    """Without hard questions that only ask for recall, but for groups where none would be left."""
    keep = ~((F.col("difficulty") == "hard") & (matches(F.col("question_text"), TRIVIAL) | F.col("bloom_level").isin("L1", "L2")))
    return questions.withColumn("keep_", keep).withColumn("any_", F.max(F.col("keep_").cast("int")).over(Window.partitionBy(group))).where("keep_ OR any_ = 0").drop("keep_", "any_")


def rejection(questions: DataFrame) -> DataFrame:
    """questions with reason: why a question cannot be shown, the first that holds; null if it can."""
    t = strip(text_or_empty(F.col("question_text")))
    low = F.lower(t)
    fill = matches(t, FILL_IN)
    assets = F.coalesce(F.col("assets"), F.array().cast("array<struct<kind:string,table_html:string,image_id:string>>")) if "assets" in questions.columns else F.array().cast("array<struct<kind:string,table_html:string,image_id:string>>")
    table = F.get(F.filter(assets, lambda a: a["kind"] == "table"), 0)
    figure = F.exists(assets, lambda a: (a["kind"] == "figure") | a["image_id"].isNotNull())
    html = F.lower(text_or_empty(table["table_html"]))
    pipes = F.filter(F.split(t, "\n"), lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2)
    inline_ok = (F.contains(low, F.lit("<table")) | (F.size(pipes) >= 2)) & (fill | ~F.exists(pipes, lambda x: x.rlike(r"\|\s*\?\s*(\||$)")))
    table_ok = F.when(table.isNotNull(), F.contains(html, F.lit("<table")) & (fill | ~F.contains(html, F.lit("?")))).otherwise(inline_ok)
    options = F.map_filter(line_options(t), lambda _, v: v != "")
    texts = F.transform(F.map_values(options), F.lower)
    key = F.upper(strip(text_or_empty(F.col("correct_answer"))))
    mcq = F.col("question_type") == "mcq"
    reason = F.coalesce(
        F.when(t == "", "empty"),
        F.when(F.contains(t, F.lit("____")) | F.contains(low, F.lit("[blank]")) | F.contains(low, F.lit("todo")) | F.contains(low, F.lit("<...>")) | F.contains(low, F.lit("<…>")), "placeholder"),
        F.when(t.rlike(r"[=:]\s*\?") & ~fill, "stray question mark"),
        F.when(~delimiters_balanced(t), "unbalanced delimiters"),
        F.when(matches(t, DANGLING), "truncated"),
        F.when(matches(t, r"\b" + LABEL), "source label"),
        F.when(matches(t, TABLE_REFERENCE) & ~table_ok, "table missing"),
        F.when(matches(t, FIGURE_REFERENCE) & ~figure, "figure missing"),
        F.when(mcq & (F.size(options) < 2), "too few options"),
        F.when(mcq & (F.size(F.array_distinct(texts)) < F.size(texts)), "repeated options"),
        F.when(mcq & (key != "") & ~F.array_contains(F.map_keys(options), key), "key not among options"),
    )
    return questions.withColumn("reason", reason)


def gate_summary(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def fold_verdicts(verdicts: DataFrame, flags: dict[str, str]) -> DataFrame:
    """verdicts with keep and reasons: a flag that says no, by false, "no" or 0, drops the row; what is missing does not."""
    no = lambda c: F.coalesce(F.lower(F.col(c).cast("string")).isin("false", "no", "0"), F.lit(False))
    reasons = F.array_compact(F.array(*[F.when(no(c), F.lit(text)) for c, text in flags.items()]))
    return verdicts.withColumn("keep", F.size(reasons) == 0).withColumn("reasons", F.array_join(reasons, "; "))


def recheck_numbers(questions: DataFrame) -> DataFrame:
    """questions with new_answer and verdict from a computed value (computed, operator and threshold for true_false).

    A short answer within tolerance stands, else takes the computed value; an mcq
    key moves to the nearest option within tolerance, or the keyed option is to be
    overwritten; a true_false key follows the comparison. Without a value nothing changes.
    """
    v = F.col("computed")
    stated = option_value(F.col("correct_answer"))
    options = line_options(F.col("question_text"))
    near = F.filter(F.transform(F.map_entries(options), lambda e: F.struct(F.abs(option_value(e["value"]) - v).alias("d"), e["key"].alias("k"), option_value(e["value"]).alias("x"))), lambda o: within_tolerance(o["x"], v))
    best = F.array_min(near)["k"]
    op, t = F.col("operator"), F.col("threshold")
    truth = F.when(op == "lt", v < t).when(op == "le", v <= t).when(op == "gt", v > t).when(op == "ge", v >= t).when(op == "eq", within_tolerance(v, t))
    truth_key = F.when(truth, "True").otherwise("False")
    kind = F.col("question_type")
    old = F.col("correct_answer")
    new = (
        F.when(v.isNull(), old)
        .when(kind == "mcq", F.coalesce(best, old))
        .when(kind == "true_false", F.when(truth.isNotNull(), truth_key).otherwise(old))
        .otherwise(F.when(F.coalesce(within_tolerance(stated, v), F.lit(False)), old).otherwise(F.format_string("%.4g", v)))
    )
    verdict = F.when(v.isNull(), "no value").when((kind == "mcq") & best.isNull(), "overwrite option").when(new == old, "stands").otherwise("changed")
    return questions.withColumn("new_answer", new).withColumn("verdict", verdict)


def sound_assets(questions: DataFrame) -> DataFrame:
    """questions with at most one asset: a table with HTML or a figure with an image or a spec."""
    ok = lambda a: ((a["kind"] == "table") & F.contains(F.lower(text_or_empty(a["table_html"])), F.lit("<table"))) | ((a["kind"] == "figure") & (text_or_empty(a["image_id"]) != ""))
    return questions.withColumn("assets", F.slice(F.filter("assets", ok), 1, 1))


def drop_unrendered(questions: DataFrame) -> DataFrame:
    """Without questions that have a figure without an image."""
    return questions.where(~F.exists("assets", lambda a: (a["kind"] == "figure") & (text_or_empty(a["image_id"]) == "")))


def shortfall(questions: DataFrame, chapters: DataFrame, target: int) -> DataFrame:
    """chapter_num, missing: how many questions a chapter lacks."""
    n = questions.groupBy("chapter_num").agg(F.count("*").alias("n"))
    return chapters.select("chapter_num").distinct().join(n, "chapter_num", "left").select("chapter_num", (F.lit(target) - F.coalesce("n", F.lit(0))).cast("long").alias("missing")).where("missing > 0")


def merge_repairs(questions: DataFrame, repairs: DataFrame, fields: tuple[str, ...] = ("question_text", "model_answer", "correct_answer")) -> DataFrame:
    """questions with the allowed fields of repairs (_id and fields) that are not blank."""
    new = repairs.select("_id", *[F.nullif(strip(F.col(f)), F.lit("")).alias(f"new_{f}") for f in fields])
    out = questions.join(new, "_id", "left")
    return out.withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).drop(*[f"new_{f}" for f in fields])


def fallback_items(chunks: DataFrame, per_chunk: int = 3) -> DataFrame:
    """_id, place, question_text, model_answer: plain questions from a chunk's own sentences, one after the other.

    Sentences of 35 to 320 characters and six words or more are candidates; terms are dealt to them in turn.
    """
    candidates = F.filter(sentences(F.regexp_replace("text", r"\s+", " ")), lambda s: F.length(s).between(35, 320) & (F.size(F.split(s, r"\s+")) >= 6))
    rows = chunks.select("_id", "key_terms", F.posexplode(F.slice(candidates, 1, per_chunk)).alias("place", "sentence"))
    term = F.when(F.size("key_terms") > 0, F.try_element_at("key_terms", (F.col("place") % F.greatest(F.size("key_terms"), F.lit(1)) + 1).cast("int")))
    return rows.select("_id", "place", F.concat(F.lit("Explain in your own words"), F.coalesce(F.concat(F.lit(" what the text says about "), term), F.lit(" what the text says")), F.lit(".")).alias("question_text"), F.col("sentence").alias("model_answer"))


#: What a sentence must not have to be asked about, terms that are none, and terms of the subject.
FALLBACK_SKIP = ("chapter ", "figure ", " table ", "homework", "review question", "practice test", "openstax", "download for free", "table of contents", "appendix", "index")
TERM_SKIP = ("chapter", "figure", "table", "example", "solution", "introduction")
SUBJECT_TERMS = ("mean", "median", "mode", "range", "variance", "standard deviation", "probability", "distribution", "sample", "population", "random variable", "hypothesis", "confidence interval", "correlation", "regression")
#: Sentences of a text that are asked about, from its first.
FALLBACK_SENTENCES = 24


def candidate_sentences(text: Column, most: int = FALLBACK_SENTENCES) -> Column:
    """Sentences of 35 to 320 characters and six words or more that ask nothing and name no part of the book; the first `most`."""
    flat = F.replace(strip(F.regexp_replace(text_or_empty(text), r"\s+", " ")), F.lit("•"), F.lit(". "))
    parts = F.transform(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.trim(s, F.lit(" -•\t\n")))
    fit = lambda s: F.length(s).between(35, 320) & ~F.contains(s, F.lit("?")) & (F.size(F.split(s, r"\s+")) >= 6) & ~F.exists(F.array(*map(F.lit, FALLBACK_SKIP)), lambda h: F.contains(F.lower(s), h))
    return F.slice(F.filter(parts, fit), 1, most)


def fallback_terms(text: Column, key_terms: Column) -> Column:
    """Key terms, then terms of the subject in the text, trimmed, each once in any case, without such as are none."""
    subject = F.filter(F.array(*map(F.lit, SUBJECT_TERMS)), lambda t: F.contains(F.lower(text_or_empty(text)), t))
    every = F.transform(F.concat(F.coalesce(key_terms, F.array().cast("array<string>")), subject), lambda t: F.trim(F.regexp_replace(text_or_empty(t), r"\s+", " "), F.lit(" .,:;()[]{}")))
    sound = F.filter(every, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*TERM_SKIP) & ~F.lower(t).endswith(" topics"))
    return let(sound, lambda ts: F.filter(ts, lambda t, i: F.array_position(F.transform(ts, F.lower), F.lower(t)) == i + 1))


def fallback_questions(chunks: DataFrame, kind: str, count: int) -> DataFrame:
    """_id, place, question_text, question_type, model_answer, rubric, max_marks, topic_tag: `count` plain questions of one kind from a chunk's own sentences.

    chunks has _id, text, topic_tag and key_terms. Sentences take turns, from the
    first again when all were used; the term of a question is the first that
    stands in its sentence, else terms take turns. kind is mcq, true_false or
    short_answer. A chunk without a sentence to ask about gives none.
    """
    if kind not in TYPES:
        raise ValueError(f"a question is {', '.join(TYPES)}, not {kind!r}")
    topic = F.coalesce(F.col("topic_tag"), F.lit(""))
    rows = chunks.select("_id", topic.alias("topic_tag"), candidate_sentences(F.col("text")).alias("sentences"), fallback_terms(F.col("text"), F.col("key_terms")).alias("terms")).where("size(sentences) > 0")
    rows = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count > 0 else rows.withColumn("place", F.lit(0)).where("false")
    turn = lambda c: F.get(c, (F.col("place") % F.greatest(F.size(c), F.lit(1))).cast("int"))
    rows = rows.withColumn("sentence", turn("sentences"))
    word = lambda t: F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), F.regexp_replace(t, r"([^A-Za-z0-9 ])", r"\\$1"), F.lit("(?![A-Za-z0-9_])"))
    named = F.get(F.filter("terms", lambda t: F.rlike(F.col("sentence"), word(t))), 0)
    rows = rows.withColumn("term", F.coalesce(named, turn("terms"), F.lit("the concept")))
    s, term = F.col("sentence"), F.col("term")
    big = F.concat(F.upper(F.substring(term, 1, 1)), F.lower(F.substring(term, 2, 1 << 20)))
    if kind == "mcq":
        text = F.concat(
            F.lit("Which of the following best describes "), term, F.lit(" in the context of "), F.col("topic_tag"), F.lit("?\nA. "), s,
            F.lit("\nB. "), big, F.lit(" only applies when every data value is identical.\nC. "), big, F.lit(" is unrelated to probability or sampling.\nD. "), big, F.lit(" eliminates the need to interpret data in context."),
        )
        answer = F.concat(F.lit("A. The source directly states: "), s)
    elif kind == "true_false":
        text, answer = F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))), F.lit("True. The statement is supported by the source section.")
    else:
        text, answer = F.concat(F.lit("What does the source state about "), term, F.lit(" in "), F.col("topic_tag"), F.lit("?")), s
    rubric = "1 mark: identifies the relevant concept. 1 mark: explains it consistently with the source text." if kind == "short_answer" else "Full marks: selects the correct option."
    return rows.select("_id", "place", text.alias("question_text"), F.lit(kind).alias("question_type"), answer.alias("model_answer"), F.lit(rubric).alias("rubric"), F.lit(2.0).alias("max_marks"), "topic_tag")


def uniqueness_context(questions: DataFrame, most: int = 40, cap: int = 120) -> DataFrame:
    """block: the first questions' beginnings, one a line, for a prompt."""
    first = questions.orderBy("_id").limit(most).select("_id", F.concat(F.lit("- "), F.substring("question_text", 1, cap)).alias("line"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", "line"))), lambda x: x["line"]), "\n").alias("block"))


def normalise_answer(kind: Column, answer: Column) -> Column:
    """A student's answer as it is compared: a letter, True or False, or the trimmed text."""
    tf = true_false(answer)
    return F.when(kind == "mcq", answer_letter(answer)).when(kind == "true_false", F.when(tf, "True").when(~tf, "False")).otherwise(strip(answer))
