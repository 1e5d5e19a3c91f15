"""What cleaning does at size: short Arrow batches, and lines that no step concerns left alone."""

import re

from pyspark.sql import functions as F

from textbank.operators import cleaning


def test_texts_go_to_python_in_short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for step in (cleaning.clean, cleaning.compose, cleaning.limit_repeated_lines, lambda c: cleaning.clean_each(F.array(c))):
            spark.conf.set(key, 10_000)
            step(F.lit("a text"))
            assert int(spark.conf.get(key)) <= 512
        spark.conf.set(key, 100)
        cleaning.clean(F.lit("a text"))
        assert int(spark.conf.get(key)) == 100
    finally:
        spark.conf.set(key, before)


def test_boilerplate_by_lines_is_that_of_the_whole_text(spark):
    lines = ["CC BY 4.0", "x cc by 4.0 y", "© 2020 Rice University", "©", "  2021", "Rice University x", "Attribution 4.0 International ©", "plain", "access for free at CNX.org", "Access for free at openstax.org", "This OpenStax book", "", "Creative Commons", "© 2020 ©"]
    texts = ["\n".join(lines[(i * k + j * j) % len(lines)] for j in range(6)) for i in range(len(lines)) for k in (1, 3, 5)] + ["©\n2020\nRice University", "CC BY 4.0 ©\n\n2020 Rice University\nrest", ""]
    whole = re.compile(r"^[^\n]*(?:" + "|".join(cleaning.BOILERPLATE) + r")[^\n]*", re.I | re.M | re.A)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(cleaning.drop_boilerplate(F.col("t"))).collect()
    assert [r[0] for r in got] == [whole.sub("", t) for t in texts]


def test_every_character_looked_for_opens_the_gate(spark):
    wanted = [wrong for wrong, _ in cleaning.MOJIBAKE] + [*cleaning.LIGATURES, *cleaning.QUOTES, *cleaning.DASHES, *cleaning.LONG_DASHES, *cleaning.ZERO_WIDTH[1:-1], *map(chr, (0, 8, 11, 12, 14, 31, 127))]
    rows = [(i, f"word {x} word.\nplain line ü") for i, x in enumerate(wanted)]
    frame = spark.createDataFrame(rows, "i int, t string")
    stepwise = cleaning.drop_invisible(cleaning.straighten(cleaning.fix_ligatures(cleaning.fix_mojibake(F.col("t")))))
    assert frame.where(cleaning._plain_steps(F.col("t")) != stepwise).count() == 0 and frame.where(stepwise == F.col("t")).count() == 0
    assert not re.search(cleaning._LOOKED_FOR, "plain line ü\t\r ß © ×")
