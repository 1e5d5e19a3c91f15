"""One quiz of many decides on a submission."""

from textbank.operators import quizzes


def test_one_quiz_decides_before_submissions_meet_it(spark):
    ts = "timestamp'2024-01-01 00:00:00'"
    lines = spark.range(40).selectExpr("id AS _id", "1L AS student_id", "array(7L, 7L) AS question_ids", "IF(id = 39, NULL, 30) AS time_limit_minutes", "'strict' AS timing_mode")
    own = spark.range(40).selectExpr("id AS quiz_id", "1L AS student_id", "IF(id % 2 = 0, 'completed', 'in_progress') AS status", f"{ts} - make_dt_interval(CAST(id AS INT)) AS started_at", f"{ts} AS deadline_at")
    sent = spark.range(30).selectExpr("id AS _id", "1L AS student_id", "IF(id = 29, 8L, 7L) AS question_id", f"{ts} + make_dt_interval(0, 0, 1) AS submitted_at")
    timed = quizzes.timing_verdict(sent, lines.where("_id < 39"), own)
    got = {tuple(r)[1:] for r in timed.where("_id < 29").collect()}
    assert got == {(37, "time is over", 60)} and timed.count() == 30
    assert [tuple(r) for r in timed.where("_id = 29").collect()] == [(29, None, "accepted", 0)]
    assert {tuple(r)[1:] for r in quizzes.timing_verdict(sent, lines, own).where("_id < 29").collect()} == {(39, "accepted", 0)}
    plan = timed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") > plan.index("Join LeftOuter")  # below the join with submissions
