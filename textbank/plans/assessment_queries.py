"""Queries of question curation, marking and quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbank.functions import text as T
from textbank.operators import curation, marking, quizzes, retrieval, similarity
from textbank.plans import inputs
from textbank.plans.inputs import QUESTIONS, SUBMISSIONS
from textbank.plans.corpus_queries import replies
from textbank.plans.registry import query


def turns(s: SparkSession, d: str) -> DataFrame:
    """conversations as answered questions: a user's turn is the question, the next turn the answer."""
    from pyspark.sql.window import Window

    c = inputs.table(s, d, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("answer_text", after).where("role = 'user' AND answer_text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("_id"), F.col("text").alias("question_text"), "answer_text")


_TURNS = "turns AS (SELECT conv_id * 1000 + turn AS _id, text AS question_text, answer_text FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer_text FROM conversations) WHERE role = 'user' AND answer_text IS NOT NULL)"


def raw_questions(s: SparkSession, d: str) -> DataFrame:
    """part as raw questions: letters, marks and types as an author might give them."""
    p = inputs.table(s, d, "part")
    n = F.col("p_size")
    mcq = F.format_string("Which one is %s?\nA. %s\nB. %s\nC. round %d\nD. none", F.col("p_name"), F.col("p_type"), F.col("p_brand"), n)
    text = F.when(n % 4 == 0, mcq).when(n % 4 == 1, F.concat(F.lit("True or False: it is "), "p_name")).when(n % 4 == 2, F.concat(F.lit(" Explain "), F.col("p_name"), F.lit(" ____ "))).otherwise(F.concat(F.lit("Explain (in Table 1."), n.cast("string"), F.lit(" the "), "p_type"))
    return p.select(
        F.col("p_partkey").alias("_id"), text.alias("question_text"),
        F.when(n % 4 == 0, "MCQ").when(n % 4 == 1, "tf").otherwise("short_answer").alias("question_type"),
        F.when(n % 4 == 0, F.concat(F.lit("The correct answer is "), F.element_at(F.array(*map(F.lit, "ABCD")), (n % 3 + 1).cast("int")), F.lit("."))).when(n % 4 == 1, F.when(n % 8 == 1, "No, it is not true").otherwise("Yes")).when(n == 50, " ").otherwise(F.col("p_type")).alias("model_answer"),
        F.when(n % 5 == 0, "x").otherwise((n % 7).cast("string")).alias("max_marks"), F.when(n % 3 == 0, "HARD").otherwise("?").alias("difficulty"), F.when(n % 2 == 0, "l2").alias("bloom_level"), F.lit(None).cast("string").alias("correct_answer"), (F.col("p_partkey") % 13).cast("int").alias("chapter_num"), n.alias("n"),
    )


_RAW = """raw AS (SELECT p_partkey AS _id, p_size AS n, CASE WHEN p_size % 4 = 0 THEN 'mcq' WHEN p_size % 4 = 1 THEN 'true_false' ELSE 'short_answer' END AS kind,
  CASE WHEN p_size % 3 = 0 THEN 'hard' ELSE 'medium' END AS difficulty FROM part)"""


query("QB-1_validated", f"WITH {_RAW} SELECT _id, kind AS question_type, difficulty, CASE WHEN n % 2 = 0 THEN 'L2' WHEN difficulty = 'hard' THEN 'L5' ELSE 'L3' END AS bloom_level, CASE WHEN n % 5 = 0 THEN 5.0 ELSE CAST(n % 7 AS DOUBLE) END AS max_marks FROM raw WHERE n <> 50")(
    lambda s, d: curation.validate(raw_questions(s, d)).select("_id", "question_type", "difficulty", "bloom_level", "max_marks")
)
query("QB-3_mcq", "SELECT p_partkey AS _id, (['A', 'B', 'C', 'D'])[p_size % 3 + 1] AS correct_answer, p_type AS a, 'none' AS d FROM part WHERE p_size % 4 = 0")(
    lambda s, d: curation.normalise_mcq(raw_questions(s, d).where("question_type = 'MCQ'").withColumn("options", F.lit(None).cast("map<string,string>"))).select("_id", "correct_answer", F.col("options")["A"].alias("a"), F.col("options")["D"].alias("d"))
)
query("SF-5_derived_keys", "SELECT p_partkey AS _id, CASE WHEN p_size % 4 = 0 THEN (['A', 'B', 'C', 'D'])[p_size % 3 + 1] WHEN p_size % 8 = 1 THEN 'False' WHEN p_size % 4 = 1 THEN 'True' END AS correct_answer FROM part WHERE p_size <> 50")(
    lambda s, d: curation.derive_key(curation.validate(raw_questions(s, d))).select("_id", "correct_answer")
)
query("QB-4_prefix_dedup", "SELECT min(doc_id) AS _id FROM documents WHERE trim(substr(text, 1, 80), chr(10) || chr(9) || ' ') <> '' GROUP BY lower(trim(substr(text, 1, 80), chr(10) || chr(9) || ' '))")(
    lambda s, d: curation.dedup_by_prefix(inputs.table(s, d, "documents").select(F.col("doc_id").alias("_id"), F.col("text").alias("question_text"))).select("_id")
)


@query("QB-5_keep_first_of_similar")
def first_of_similar(s: SparkSession, d: str) -> DataFrame:
    """Across chapters: a row goes if an earlier one of any chapter that stays is similar."""
    v = inputs.vectors(s, d)
    return similarity.keep_first_apart(v, 0.3).select("_id")


query("QB-6_bank_duplicates", "SELECT vec_id AS _id FROM embeddings e WHERE vec_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id % 2 = 0 AND b.vec_id < e.vec_id AND b.label = e.label AND list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) >= 0.3)")(
    lambda s, d: curation.drop_bank_duplicates(inputs.vectors(s, d).where("_id % 2 = 1").select("_id"), retrieval.similar_pairs(inputs.vectors(s, d), "chapter_num", 0.3).where("a % 2 = 0 AND b % 2 = 1"))
)
query("QB-7_level_gaps", f"WITH {QUESTIONS}, n AS (SELECT bloom_level, count(*) AS n FROM questions WHERE difficulty = 'easy' GROUP BY 1), t AS (SELECT * FROM (VALUES ('L1', 300), ('L2', 400), ('L3', 600), ('L4', 400), ('L5', 300)) AS t(bloom_level, target)) SELECT bloom_level, target, coalesce(n, 0) AS n, target - coalesce(n, 0) AS needed FROM t LEFT JOIN n USING (bloom_level) WHERE coalesce(n, 0) < target / 2")(
    lambda s, d: curation.level_gaps(inputs.questions(s, d).where("difficulty = 'easy'"), 2000)
)
query("QB-8_balanced", f"WITH {QUESTIONS}, r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY chapter_num, bloom_level ORDER BY _id) <= CASE bloom_level WHEN 'L1' THEN 3 WHEN 'L2' THEN 4 WHEN 'L3' THEN 6 WHEN 'L4' THEN 4 ELSE 3 END THEN 0 ELSE 1 END AS o FROM questions), x AS (SELECT *, row_number() OVER (PARTITION BY chapter_num ORDER BY o, CASE WHEN o = 0 THEN bloom_level END, _id) AS slot FROM r) SELECT _id, chapter_num, CAST(slot AS INTEGER) AS slot FROM x WHERE slot <= 20")(
    lambda s, d: curation.balance_levels(inputs.questions(s, d), "chapter_num", 20).select("_id", "chapter_num", "slot")
)
query("QB-9_bands", f"WITH {QUESTIONS} SELECT _id, CASE WHEN difficulty = 'easy' AND bloom_level NOT IN ('L1', 'L2') THEN 'L1' WHEN difficulty = 'medium' AND bloom_level NOT IN ('L3', 'L4') THEN 'L3' WHEN difficulty = 'hard' THEN 'L5' ELSE bloom_level END AS bloom_level FROM questions")(
    lambda s, d: curation.enforce_band(inputs.questions(s, d)).select("_id", "bloom_level")
)
query("QB-10_not_trivial", f"WITH {QUESTIONS}, k AS (SELECT *, NOT (difficulty = 'hard' AND bloom_level IN ('L1', 'L2')) AS keep FROM questions), a AS (SELECT *, bool_or(keep) OVER (PARTITION BY chapter_num) AS any_keep FROM k) SELECT _id FROM a WHERE keep OR NOT any_keep")(
    lambda s, d: curation.drop_trivial(inputs.questions(s, d), "chapter_num").select("_id")
)


def gated(s: SparkSession, d: str) -> DataFrame:
    return curation.rejection(curation.derive_key(curation.validate(raw_questions(s, d))))


query("QB-11_gate", "SELECT p_partkey AS _id, CASE WHEN p_size % 4 = 2 THEN 'placeholder' WHEN p_size % 4 = 3 THEN 'unbalanced delimiters' END AS reason FROM part WHERE p_size <> 50")(lambda s, d: gated(s, d).select("_id", "reason"))
query("QB-12_gate_summary", "SELECT CASE WHEN p_size % 4 = 2 THEN 'placeholder' WHEN p_size % 4 = 3 THEN 'unbalanced delimiters' ELSE 'kept' END AS reason, count(*) AS n FROM part WHERE p_size <> 50 GROUP BY 1")(lambda s, d: curation.gate_summary(gated(s, d)))
query("QB-13_verdicts", "SELECT doc_id, NOT (quality = 0 OR toxic = 1) AS keep, concat_ws('; ', CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS reasons FROM labels")(
    lambda s, d: curation.fold_verdicts(inputs.table(s, d, "labels").withColumn("clean", 1 - F.col("toxic")), {"quality": "poor", "clean": "toxic"}).select("doc_id", "keep", "reasons")
)
query("QB-14_hard_verdicts", "SELECT doc_id FROM labels WHERE toxic <> 0")(lambda s, d: curation.fold_verdicts(inputs.table(s, d, "labels"), {"toxic": "not hard"}).where("keep").select("doc_id"))


@query("QB-15_numbers", "SELECT p_partkey AS _id, CASE WHEN abs(p_size * 1.01 - p_size * CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 1.5 END) / (p_size * 1.5) <= 1 AND p_size % 2 = 0 THEN 'stands' ELSE 'changed' END AS verdict FROM part")
def numbers(s: SparkSession, d: str) -> DataFrame:
    """Stated sizes, one percent off, against computed ones that agree for even sizes only."""
    p = inputs.table(s, d, "part")
    q = p.select(F.col("p_partkey").alias("_id"), F.lit("How large?").alias("question_text"), F.lit("short_answer").alias("question_type"), (F.col("p_size") * 1.01).cast("string").alias("correct_answer"), (F.col("p_size") * F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(1.5)).alias("computed"), F.lit(None).cast("string").alias("operator"), F.lit(None).cast("double").alias("threshold"))
    return curation.recheck_numbers(q).select("_id", "verdict")


@query("QB-16_mcq_numbers", "SELECT p_partkey AS _id, (['A', 'B', 'C'])[p_size % 3 + 1] AS new_answer FROM part WHERE p_size > 0")
def mcq_numbers(s: SparkSession, d: str) -> DataFrame:
    p = inputs.table(s, d, "part").where("p_size > 0")
    text = F.format_string("How large?\nA. %d\nB. %d\nC. %d\nD. nothing", *[F.col("p_size") * F.when(F.col("p_size") % 3 == i, 1).otherwise(i + 2) for i in range(3)])
    q = p.select(F.col("p_partkey").alias("_id"), text.alias("question_text"), F.lit("mcq").alias("question_type"), F.lit("D").alias("correct_answer"), F.col("p_size").cast("double").alias("computed"), F.lit(None).cast("string").alias("operator"), F.lit(None).cast("double").alias("threshold"))
    return curation.recheck_numbers(q).select("_id", "new_answer")


@query("QB-17_true_false_numbers", "SELECT p_partkey AS _id, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS new_answer FROM part")
def tf_numbers(s: SparkSession, d: str) -> DataFrame:
    q = inputs.table(s, d, "part").select(F.col("p_partkey").alias("_id"), F.lit("It is more than 25.").alias("question_text"), F.lit("true_false").alias("question_type"), F.lit("True").alias("correct_answer"), F.col("p_size").cast("double").alias("computed"), F.lit("gt").alias("operator"), F.lit(25.0).alias("threshold"))
    return curation.recheck_numbers(q).select("_id", "new_answer")


def with_assets(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    asset = lambda k, h, i: F.struct(k.alias("kind"), h.alias("table_html"), i.alias("image_id"))
    none = F.lit(None).cast("string")
    return inputs.table(s, d, "part").select(F.col("p_partkey").alias("_id"), F.array(asset(F.lit("table"), F.when(n % 2 == 0, "<table></table>").otherwise("<pre>"), none), asset(F.lit("figure"), none, F.when(n % 3 == 0, "img"))).alias("assets"))


query("QB-18_assets", "SELECT p_partkey AS _id, CASE WHEN p_size % 2 = 0 THEN 'table' WHEN p_size % 3 = 0 THEN 'figure' ELSE '' END AS kind FROM part")(lambda s, d: curation.sound_assets(with_assets(s, d)).select("_id", F.array_join(F.transform("assets", lambda a: a["kind"]), ",").alias("kind")))
query("QB-19_rendered", "SELECT p_partkey AS _id FROM part WHERE p_size % 3 = 0")(lambda s, d: curation.drop_unrendered(with_assets(s, d)).select("_id"))
query("QB-20_shortfall", f"WITH {QUESTIONS} SELECT chapter_num, 200 - count(*) FILTER (difficulty = 'hard') AS missing FROM questions GROUP BY 1 HAVING count(*) FILTER (difficulty = 'hard') < 200")(lambda s, d: curation.shortfall(inputs.questions(s, d).where("difficulty = 'hard'"), inputs.questions(s, d), 200))
query("QB-22_repairs", "SELECT p_partkey AS _id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS question_text FROM part")(
    lambda s, d: curation.merge_repairs(inputs.table(s, d, "part").select(F.col("p_partkey").alias("_id"), F.col("p_name").alias("question_text")), inputs.table(s, d, "part").select(F.col("p_partkey").alias("_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ").alias("question_text")), ("question_text",))
)
query("QB-23_fallback_items")(lambda s, d: curation.fallback_items(inputs.chunks(s, d).withColumn("key_terms", F.array(F.lit("words"), F.lit("sounds")))).select("_id", "place", "question_text", "model_answer"))
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_FALLBACK = rf"""WITH c AS (SELECT doc_id AS _id, lang AS topic_tag, lower(text) AS low, replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), '•', '. ') AS t FROM documents),
  s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' -•')), lambda x: length(x) BETWEEN 35 AND 320 AND NOT contains(x, '?') AND len(string_split(x, ' ')) >= 6 AND NOT regexp_matches(lower(x), '{"|".join(curation.FALLBACK_SKIP)}'))[1:24] AS ss,
    list_concat(['words', 'mean'], list_filter({_LIST(t for t in curation.SUBJECT_TERMS if t != "mean")}, lambda x: contains(low, x))) AS ts FROM c),
  p AS (SELECT _id, topic_tag, ts, CAST(place AS INTEGER) AS place, ss[place % len(ss) + 1] AS s FROM s, range(30) AS r(place) WHERE len(ss) > 0),
  q AS (SELECT *, coalesce(list_filter(ts, lambda x: regexp_matches(s, '(?i)(?:^|[^A-Za-z0-9_])' || x || '(?:$|[^A-Za-z0-9_])'))[1], ts[place % len(ts) + 1]) AS term FROM p),
  b AS (SELECT *, upper(term[1]) || lower(term[2:]) AS big FROM q)"""
for _kind, _text, _answer in (
    ("mcq", "'Which of the following best describes ' || term || ' in the context of ' || topic_tag || '?' || chr(10) || 'A. ' || s || chr(10) || 'B. ' || big || ' only applies when every data value is identical.' || chr(10) || 'C. ' || big || ' is unrelated to probability or sampling.' || chr(10) || 'D. ' || big || ' eliminates the need to interpret data in context.'", "'A. The source directly states: ' || s"),
    ("true_false", "CASE WHEN s LIKE '%.' THEN s ELSE s || '.' END", "'True. The statement is supported by the source section.'"),
    ("short_answer", "'What does the source state about ' || term || ' in ' || topic_tag || '?'", "s"),
):
    query(f"QB-23_fallback_{_kind}", f"{_FALLBACK} SELECT _id, place, {_text} AS question_text, '{_kind}' AS question_type, {_answer} AS model_answer FROM b")(
        lambda s, d, kind=_kind: curation.fallback_questions(inputs.chunks(s, d).withColumn("key_terms", F.array(F.lit("words"), F.lit(" Mean."), F.lit("figure"), F.lit("mean"))).withColumn("key_terms", F.transform("key_terms", lambda t: F.lower(t))), kind, 30).select("_id", "place", "question_text", "question_type", "model_answer")
    )
query("QB-3_distractors", "SELECT p_partkey AS _id, 'A' AS correct_answer, p_name AS a, 'It applies only when every observed value in ' || p_brand || ' is identical.' AS b, p_type AS c, 'It removes the need to check the conditions or assumptions of the method.' AS d FROM part")(
    lambda s, d: curation.normalise_mcq(inputs.table(s, d, "part").select(F.col("p_partkey").alias("_id"), F.lit("Which one is it?").alias("question_text"), F.concat(F.lit("A) "), "p_name").alias("model_answer"), F.lit(None).cast("string").alias("correct_answer"), F.col("p_brand").alias("topic_tag"), F.create_map(F.lit("C"), F.col("p_type")).alias("options"))).select("_id", "correct_answer", *[F.col("options")[x].alias(x.lower()) for x in "ABCD"])
)
query("QB-24_uniqueness", "SELECT string_agg('- ' || substr(text, 1, 120), chr(10) ORDER BY doc_id) AS block FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 40)")(
    lambda s, d: curation.uniqueness_context(inputs.table(s, d, "documents").select(F.col("doc_id").alias("_id"), F.col("text").alias("question_text")))
)
query("QB-21_uncovered", "SELECT DISTINCT p_brand AS concept FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 3)")(
    lambda s, d: inputs.table(s, d, "part").select(F.col("p_brand").alias("concept")).distinct().join(inputs.table(s, d, "part").where("p_size < 3").select(F.col("p_brand").alias("concept")).distinct(), "concept", "left_anti")
)
query("QB-2_stored_form", f"WITH {_RAW} SELECT _id, kind AS question_type, difficulty FROM raw WHERE n <> 50")(lambda s, d: curation.validate(raw_questions(s, d)).select("_id", "question_type", "difficulty"))

# Functions on answers.
query("SF-7_true_false", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'true' WHEN event_type = 'view' THEN 'false' ELSE 'neither' END AS value FROM events")(
    lambda s, d: inputs.table(s, d, "events").select("event_id", T.true_false(F.when(F.col("event_type") == "click", " Yes. ").when(F.col("event_type") == "view", "F").otherwise(F.col("event_type"))).cast("string").alias("value")).fillna("neither")
)
query("SF-8_true_false_key", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'False' ELSE 'True' END AS value FROM events")(
    lambda s, d: inputs.table(s, d, "events").select("event_id", T.true_false_key(F.when(F.col("event_type") == "click", "It is not true that").when(F.col("event_type") == "view", "False: never").otherwise("It holds")).alias("value"))
)
query("SF-4_line_options", "SELECT p_partkey, p_type AS a, p_brand AS b FROM part WHERE p_size % 4 = 0")(lambda s, d: raw_questions(s, d).where("n % 4 = 0").select(F.col("_id").alias("p_partkey"), T.line_options(F.col("question_text"))["A"].alias("a"), T.line_options(F.col("question_text"))["B"].alias("b")))
query("SF-6_answer_letter", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'B' WHEN p_size % 3 = 1 THEN 'C' ELSE 'A' END AS letter FROM part WHERE p_size % 4 = 0 AND p_type <> p_brand")(
    lambda s, d: raw_questions(s, d).where("n % 4 = 0").select(F.col("_id").alias("p_partkey"), T.answer_letter(F.when(F.col("n") % 3 == 0, "(b)").when(F.col("n") % 3 == 1, "Answer: C").otherwise(T.line_options(F.col("question_text"))["A"]), T.line_options(F.col("question_text"))).alias("letter"))
)
query("SF-12_json_arrays", "SELECT p_partkey AS batch_id, CAST(2 AS INTEGER) AS n FROM part")(lambda s, d: replies(s, d).select("batch_id", F.size(T.json_array(F.col("raw"), "struct<i:int,concept_label:string>")).alias("n")))
query("SF-13_marking_replies", "SELECT event_id, round(least(greatest(value / 10 - 3, 0), 10), 6) AS mark FROM events")(
    lambda s, d: inputs.table(s, d, "events").select("event_id", F.round(T.marking_reply(F.concat(F.lit('ok {"mark": '), F.round(F.col("value") / 10 - 3, 6).cast("decimal(20,6)").cast("string"), F.lit(', "feedback": "fine"} bye')), F.lit(10))["mark"], 6).alias("mark"))
)
query("SF-18_option_values", "SELECT o_orderkey, o_totalprice AS value FROM orders")(lambda s, d: inputs.table(s, d, "orders").select("o_orderkey", T.option_value(F.concat(F.lit("about "), F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit(" coins"))).alias("value")))
query("SF-21_arithmetic", "SELECT p_partkey, CAST(p_size * p_size + 3 * p_size AS DOUBLE) AS value FROM part")(lambda s, d: inputs.table(s, d, "part").select("p_partkey", T.arithmetic(F.format_string("%d^2 + 3*%d", "p_size", "p_size")).alias("value")))
query("SF-27_throttle", "SELECT event_id, CASE event_type WHEN 'error' THEN 'quota' WHEN 'click' THEN 'transient' ELSE 'none' END AS kind FROM events")(
    lambda s, d: inputs.table(s, d, "events").select("event_id", T.throttle_class(F.when(F.col("event_type").isin("error", "click"), 429).otherwise(200), F.when(F.col("event_type") == "error", "Insufficient quota").otherwise("slow down, per minute")).alias("kind"))
)
query("SF-9_option_keys", "SELECT p_partkey, lower(p_name) AS key FROM part")(lambda s, d: inputs.table(s, d, "part").select("p_partkey", T.option_key(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" . "))).alias("key")).withColumn("key", T.strip(F.col("key"))))
query("SF-23_stringified", "SELECT p_partkey, 'Size: ' || p_size || '.' AS text FROM part")(lambda s, d: inputs.table(s, d, "part").select("p_partkey", T.stringify_map(F.create_map(F.lit("size"), F.col("p_size").cast("string"))).alias("text")))

# Marking.
def scored(s: SparkSession, d: str) -> DataFrame:
    """Answered questions with two vectors of all those there are, dealt by number; the rubric is the question itself."""
    v = inputs.table(s, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    n = v.count()
    rows = turns(s, d).withColumns({"k": F.col("_id") % n, "m": (F.col("_id") * 7 + n // 2) % n})
    rows = rows.join(v.withColumnRenamed("embedding", "answer_embedding"), "k", "left").join(v.select(F.col("k").alias("m"), F.col("embedding").alias("model_embedding")), "m", "left")
    return marking.pre_score(rows.select("_id", "question_text", "answer_text", F.col("question_text").alias("rubric"), F.lit(10.0).alias("max_marks"), "answer_embedding", "model_embedding"))


def replied(s: SparkSession, d: str) -> DataFrame:
    """scored with a marker's reply of 0 to 11 marks; every seventh cannot be read."""
    raw = F.when(F.col("_id") % 7 == 0, "no mark").otherwise(F.format_string('{"mark": %d, "feedback": "ok"}', F.col("_id") % 12))
    return marking.mark_subjective(scored(s, d).withColumn("raw", raw))


_STOP = str(list(T.RUBRIC_STOPWORDS))
#: In SQL a word boundary is one of ASCII words: other letters and digits are made word characters first.
_WORDS = r"array_to_string(list_transform(string_split(lower({}), ''), lambda c: CASE WHEN c > chr(127) AND regexp_full_match(c, '[\p{{L}}\p{{N}}\p{{M}}]') THEN '_' ELSE c END), '')"
_KW = f"list_filter(regexp_extract_all({_WORDS.format('question_text')}, '\\b[a-z][a-z0-9\\-]{{2,}}\\b'), lambda t: NOT list_contains({_STOP}, t))"
_SCORED = f"""{_TURNS}, n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT t.*, {_KW} AS kws, regexp_extract_all({_WORDS.format('answer_text')}, '\\b[a-z][a-z0-9\\-]*\\b') AS toks, greatest(0.0, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0.0), 6)) AS sim
  FROM turns t CROSS JOIN n LEFT JOIN embeddings a ON a.vec_id = t._id % n.n LEFT JOIN embeddings b ON b.vec_id = (t._id * 7 + n.n // 2) % n.n),
  c AS (SELECT *, round(CASE WHEN len(kws) = 0 THEN 0.5 ELSE len(list_filter(kws, lambda t: list_contains(toks, t))) / len(kws) END, 6) AS cov FROM k),
  r AS (SELECT *, round(0.4 * cov + 0.6 * sim, 4) AS confidence FROM c),
  o AS (SELECT *, CASE WHEN sim >= 0.92 AND cov >= 0.6 THEN 'HIGH' WHEN confidence >= 0.55 THEN 'MID' ELSE 'LOW' END AS route FROM r),
  m AS (SELECT *, CASE WHEN route = 'HIGH' OR _id % 7 > 0 AND _id % 12 >= 10 THEN 10.0 WHEN _id % 7 = 0 THEN 0.0 ELSE CAST(_id % 12 AS DOUBLE) END AS auto_mark, route <> 'HIGH' AND (route = 'LOW' OR _id % 7 = 0) AS is_flagged FROM o)"""
query("MK-3_pre_score", f"WITH {_SCORED} SELECT _id, cov AS keyword_coverage, sim AS semantic_similarity, route FROM o")(
    lambda s, d: scored(s, d).select("_id", "keyword_coverage", "semantic_similarity", "route")
)
query("MK-1_keywords", f"WITH {_TURNS} SELECT _id, array_to_string({_KW}, ' ') AS keywords FROM turns")(
    lambda s, d: turns(s, d).select("_id", F.array_join(T.rubric_keywords(F.col("question_text")), " ").alias("keywords"))
)
query("MK-5_objective", "SELECT p_partkey AS _id, CASE WHEN p_size % 3 = 1 THEN 5.0 ELSE 0.0 END AS auto_mark, false AS is_flagged FROM part WHERE p_size % 4 = 0")(
    lambda s, d: marking.mark_objective(raw_questions(s, d).where("n % 4 = 0").withColumns({"question_type": F.lit("mcq"), "max_marks": F.lit(5.0), "answer_text": F.lit("b)")})).select("_id", "auto_mark", "is_flagged")
)
query("MK-6_subjective", f"WITH {_SCORED} SELECT _id, auto_mark, is_flagged FROM m")(lambda s, d: replied(s, d).select("_id", "auto_mark", "is_flagged"))
query("MK-7_outcome", f"WITH {_SCORED} SELECT _id, auto_mark, is_flagged, true AS is_marked, '[Route:' || route || ' Conf:' || format('{{:.2f}}', confidence) || '] ' || CASE WHEN route = 'HIGH' THEN 'Full marks.' WHEN _id % 7 = 0 THEN '' ELSE 'ok' END AS auto_feedback FROM m")(lambda s, d: marking.outcome(replied(s, d)))
query("MK-8_effective", f"WITH {SUBMISSIONS} SELECT _id, round(coalesce(override_mark, auto_mark), 6) AS mark FROM submissions")(lambda s, d: inputs.submissions(s, d).select("_id", F.round(F.coalesce("override_mark", "auto_mark"), 6).alias("mark")))


def overridden(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sub = inputs.submissions(s, d)
    feed = sub.where("_id % 5 = 0").select(F.col("_id").alias("submission_id"), F.lit(7.0).alias("override_mark"), F.lit("teacher").alias("actor_id"), F.col("submitted_at").alias("ts"))
    return marking.apply_overrides(sub, feed)


query("MK-9_overrides", f"WITH {SUBMISSIONS} SELECT _id, CASE WHEN _id % 5 = 0 THEN 7.0 ELSE round(override_mark, 6) END AS override_mark, is_flagged AND _id % 5 <> 0 AS is_flagged FROM submissions")(lambda s, d: overridden(s, d)[0].select("_id", F.round("override_mark", 6).alias("override_mark"), "is_flagged"))
query("MK-9_audit", f"WITH {SUBMISSIONS} SELECT _id AS submission_id, round(coalesce(override_mark, auto_mark), 6) AS old_mark, 7.0 AS new_mark FROM submissions WHERE _id % 5 = 0")(lambda s, d: overridden(s, d)[1].select("submission_id", F.round("old_mark", 6).alias("old_mark"), F.col("new_mark")))
query("MK-10_failures", "SELECT event_id AS _id, 0.0 AS auto_mark, 'Marking failed: ' || props AS auto_feedback FROM events WHERE event_type = 'error'")(lambda s, d: marking.failed_outcome(inputs.table(s, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("_id"), F.col("props").alias("reason"))).select("_id", "auto_mark", "auto_feedback"))

# Quizzes: an order is a timed quiz, its lines the attempts at it, that start on the order's day and end when the line ships.
def attempts(s: SparkSession, d: str) -> DataFrame:
    o = inputs.table(s, d, "orders")
    return inputs.table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(30))).alias("deadline_at"), F.when(F.col("o_orderstatus") == "F", "strict").otherwise("easy").alias("timing_mode"), F.col("l_shipdate").alias("now")
    )


query("QZ-1_expired", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus = 'F' AND l_shipdate > o_orderdate + INTERVAL 30 DAY + INTERVAL 30 SECOND AS expired FROM lineitem JOIN orders ON o_orderkey = l_orderkey")(
    lambda s, d: attempts(s, d).select("l_orderkey", "l_linenumber", "l_partkey", quizzes.expired(F.col("timing_mode"), F.col("deadline_at"), F.col("now")).alias("expired"))
)
query(
    "QZ-2_finalised",
    """WITH a AS (SELECT *, o_orderdate + INTERVAL 30 DAY AS dl, o_orderstatus = 'F' AND l_shipdate > o_orderdate + INTERVAL 30 DAY + INTERVAL 30 SECOND AS ex FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
      SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ex THEN 'expired' ELSE 'completed' END AS status, CAST(date_diff('second', o_orderdate, CASE WHEN ex THEN dl ELSE l_shipdate END) AS BIGINT) AS duration_seconds,
      CAST(greatest(0, date_diff('second', dl, CASE WHEN ex THEN dl ELSE l_shipdate END)) AS BIGINT) AS late_by_seconds FROM a""",
)(lambda s, d: quizzes.finalise(attempts(s, d), F.col("now")).select("l_orderkey", "l_linenumber", "l_partkey", "status", "duration_seconds", "late_by_seconds"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return inputs.quizzes(s, d).withColumns({"student_id": F.col("student_id") % 150, "question_ids": F.transform("question_ids", lambda x: x % 100)})


query("QZ-3_flushed_drafts", f"WITH {SUBMISSIONS}, l AS (SELECT DISTINCT o_orderkey, o_custkey % 150 AS student_id, l_partkey % 100 AS question_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT o_orderkey AS attempt_id, student_id, question_id, 'answer' AS answer_text FROM l WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.student_id = l.student_id AND s.question_id = l.question_id) AND question_id % 3 > 0")(
    lambda s, d: quizzes.flush_drafts(_lines(s, d).select("_id", F.col("_id").alias("quiz_id"), "student_id", F.map_from_entries(F.transform(F.array_distinct("question_ids"), lambda x: F.struct(x, F.when(x % 3 > 0, " answer ").otherwise(" ")))).alias("draft_answers")), _lines(s, d), inputs.submissions(s, d))
)
query(
    "QZ-4_timing",
    f"""WITH {SUBMISSIONS}, l AS (SELECT DISTINCT o_orderkey AS quiz_id, o_orderpriority = '5-LOW' AS untimed, o_orderstatus = 'F' AS strict, o_custkey % 150 AS student_id, l_partkey % 100 AS question_id, o_orderdate AS started_at, o_orderkey % 3 > 0 AS under_way FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
      j AS (SELECT s._id, l.*, greatest(0, date_diff('second', started_at + INTERVAL 1 DAY, submitted_at)) AS late FROM submissions s LEFT JOIN l ON l.student_id = s.student_id AND l.question_id = s.question_id)
    SELECT _id, quiz_id, CASE WHEN quiz_id IS NULL OR untimed THEN 'accepted' WHEN under_way THEN CASE WHEN strict AND late > 30 THEN 'time is over' ELSE 'accepted' END ELSE 'finished' END AS verdict, CAST(CASE WHEN quiz_id IS NULL OR untimed THEN 0 ELSE late END AS BIGINT) AS late_by_seconds
    FROM j QUALIFY row_number() OVER (PARTITION BY _id ORDER BY CASE WHEN quiz_id IS NULL OR untimed THEN 0 WHEN under_way THEN 1 ELSE 2 END, started_at NULLS FIRST, quiz_id) = 1""",
)(
    lambda s, d: quizzes.timing_verdict(inputs.submissions(s, d), _lines(s, d), _lines(s, d).select(F.col("_id").alias("quiz_id"), "student_id", F.when(F.col("_id") % 3 == 0, "completed").otherwise("in_progress").alias("status"), F.col("created_at").alias("started_at"), (F.col("created_at") + F.make_dt_interval(days=F.lit(1))).alias("deadline_at")))
)
query("QZ-5_access", f"WITH {SUBMISSIONS}, a AS (SELECT DISTINCT o_custkey % 150 AS student_id, l_partkey % 100 AS question_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT s._id, a.student_id IS NOT NULL AS allowed FROM submissions s LEFT JOIN a ON a.student_id = s.student_id AND a.question_id = s.question_id")(
    lambda s, d: quizzes.access_verdict(inputs.submissions(s, d), inputs.submissions(s, d).where("false").select("student_id", "question_id"), _lines(s, d).select("student_id", F.explode("question_ids").alias("question_id"))).select("_id", "allowed")
)
query("QZ-6_merged_drafts", "SELECT o_orderkey, o_orderstatus AS a, 'old ' || o_orderpriority AS b FROM orders")(
    lambda s, d: inputs.table(s, d, "orders").select("o_orderkey", quizzes.merge_drafts(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.concat(F.lit("old "), "o_orderpriority")), F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("z"), F.lit("new")), F.array(F.lit("a"), F.lit("b"))).alias("m")).select("o_orderkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))
)
query("QZ-7_hidden", "SELECT o_orderkey AS _id, CASE WHEN any_value(o_orderpriority) = '5-LOW' OR o_orderkey % 4 = 0 THEN count(*) ELSE 0 END AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")(
    lambda s, d: quizzes.hide_timed(inputs.quizzes(s, d), inputs.quizzes(s, d).where("_id % 4 = 0").select(F.col("_id").alias("quiz_id"), "student_id")).select("_id", F.size("question_ids").cast("long").alias("n"))
)
query("MK-2_coverage", f"WITH {_SCORED} SELECT _id, cov AS keyword_coverage FROM r")(lambda s, d: scored(s, d).select("_id", "keyword_coverage"))
query("MK-4_routes", f"WITH {_SCORED} SELECT route, count(*) AS n FROM o GROUP BY 1")(
    lambda s, d: scored(s, d).groupBy("route").agg(F.count("*").alias("n"))
)
