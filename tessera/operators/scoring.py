"""The weighted score of a range: 14 factors and 7 penalties of its sums, its first and last line and its likeness to others.

Each is a number of doubles between 0 and 1, kept as whole ten-thousandths; the
weighted sum is then exact, in millionths.  Expressions are SQL on the columns
of ``range_rows``: the sums by name, f_x and l_x of the first and the last line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.operators import transcript as R

TOTAL = "greatest(tokens, 1)"
WPM = "(tokens * 6000e0 / span_cs)"
PACE = f"(CASE WHEN {WPM} <= 0e0 THEN 0e0 WHEN {WPM} < 120e0 THEN greatest(1e0 - (120e0 - {WPM}) / 110e0, 0e0) WHEN {WPM} <= 190e0 THEN 1e0 ELSE greatest(1e0 - ({WPM} - 190e0) / 160e0, 0e0) END)"
#: Without confidences of words a transcript counts as 0.7 sure.
SURE = "7e-1"
#: A range that opens with a reference is thin if its first and last line have fewer words of content.
THIN = 5


def when(condition: str, value: str, other: str = "0e0") -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE {other} END"


FACTORS = {
    "hook": f"30e-2 + {when('f_questions > 0 OR f_asks', '22e-2')} + {when('f_m_curiosity > 0', 'least(20e-2 + 4e-2 * f_m_curiosity, 30e-2)')} + {when('f_m_intensity > 0', '8e-2')} + {when('f_second_person > 0', '7e-2')}"
    f" + {when('f_numbers > 0', '6e-2')} + CASE WHEN f_tokens BETWEEN 4 AND 16 THEN 8e-2 WHEN f_tokens > 26 THEN -12e-2 ELSE 0e0 END - {when('f_m_continuation > 0', '15e-2')}",
    "emotion": f"18e-2 + 15e-2 * m_emotion + 4e-2 * least(exclamations, 4) + 4e-2 * m_intensity + 5e-2 * m_profanity + 55e-2 * first_person / {TOTAL} + 25e-2 * least(swing / 3e0, 1e0)",
    "curiosity": f"25e-2 + 18e-2 * m_curiosity + {when('questions > 0', '15e-2')} + 6e-2 * m_contrast",
    "standalone": f"65e-2 - {when('f_deictic', '12e-2')} - {when('f_conjunction', '8e-2')} - {when('thin', '8e-2')} + {when('l_terminal', '18e-2', '-10e-2')} - {when('m_continuation > 0', '22e-2')} - CASE WHEN span_cs < 2000 THEN 25e-2 WHEN span_cs > 11000 THEN 10e-2 ELSE 0e0 END",
    "story": f"16e-2 + 55e-3 * m_story + least(past_tense * 32e-1 / {TOTAL}, 42e-2) + {when(f'first_person * 10 > {TOTAL}', '12e-2')}",
    "payoff": f"20e-2 + 10e-2 * m_payoff + {when('l_tokens BETWEEN 3 AND 18', '16e-2')} + {when('l_terminal', '10e-2')} + {when('l_second_person > 0', '8e-2')}",
    "novelty": "CASE WHEN s < 6 THEN 62e-2 WHEN before IS NULL THEN 5e-1 WHEN before < 0 THEN 6e-1 ELSE 1e0 - before * 145e-8 END",
    "shareability": f"15e-2 + 13e-2 * least(quotable, 3) + least(second_person * 16e-1 / {TOTAL}, 25e-2) + {when('numbers > 0', '8e-2')}",
    "controversy": "8e-2 + 17e-2 * m_controversy + 5e-2 * m_absolutes",
    "practical": "12e-2 + 11e-2 * m_advice + 5e-2 * least(numbers, 4)",
    "humour": "5e-2 + 24e-2 * m_humour + 5e-2 * exclamations",
    "insight": f"10e-2 + 9e-2 * m_insight + {when('m_payoff > 0', '8e-2')}",
    "unexpectedness": f"13e-2 * m_contrast + {when('turns > 0', '18e-2')}",
    "engagement": f"20e-2 + 30e-2 * {PACE} + least(second_person * 18e-1 / {TOTAL}, 25e-2) + least(questions * 5e-2, 12e-2) + least(imperatives * 4e-2, 14e-2)",
}
PENALTIES = {
    "context_dependency": f"8e-2 + {when('start_cs > 60000', '4e-2')} + {when('start_cs > 240000', '5e-2')} + {when('same_block AND gap_before < 60', '12e-2')} + {when('f_m_continuation > 0', '20e-2')} + {when('gap_before < 10', '10e-2')}",
    "abrupt_start": f"greatest({when('f_deictic', '35e-2')}, {when('f_conjunction', '40e-2')}, {when('gap_before < 12', '25e-2')})",
    "abrupt_end": f"greatest({when('l_terminal', '0e0', '30e-2')}, {when('gap_after < 12', '20e-2')})",
    "filler": f"fillers * 45e-1 / {TOTAL}",
    "low_confidence": f"1e0 - {SURE}",
    "repetition": "(earlier * 1e-6 - 52e-2) / 48e-2",
    "weak_delivery": f"(1e0 - {PACE}) * 55e-2 + {when(f'span_cs < {{low}} * 8e-1', '35e-2')}",
}


def whole(expression: str) -> str:
    """Between 0 and 1, in whole ten-thousandths."""
    return f"CAST(floor(least(greatest({expression}, 0e0), 1e0) * 10000e0 + 5e-1) AS BIGINT)"


def columns(low: int) -> dict[str, str]:
    """All factors and penalties by name, for ranges that should last ``low`` at least."""
    return {k: whole(x.replace("{low}", str(low))) for k, x in (FACTORS | PENALTIES).items()}


#: The weighted sum in millionths; it orders ranges as the score does, and finer.
RAW = "least(greatest(" + " + ".join(f"{w} * {k}" for k, w in L.WEIGHTS.items()) + "".join(f" - {w} * {k}" for k, w in L.PENALTIES.items()) + ", 0), 1000000)"
#: The score from 0 to 100, in tenths.
SCORE = f"CAST(floor(power(raw / 1000000e0, {int(L.CURVE * 100)}e-2) * 1000e0 + 5e-1) AS BIGINT)"


def scored(rows: DataFrame, low: int) -> DataFrame:
    """Adds all factors and penalties, raw and score.

    The swing of feelings is a fold, and Spark does not fuse an operator that has one into a single method; the factors beside it would
    make that too long for the JIT, and ten times slower.
    """
    highest = F.aggregate("feelings", F.lit(-1_000).cast("long"), lambda a, x: F.greatest(a, x))
    lowest = F.aggregate("feelings", F.lit(1_000).cast("long"), lambda a, x: F.least(a, x))
    rows = rows.withColumn("swing", highest - lowest)
    rows = rows.withColumns({k: F.expr(x) for k, x in columns(low).items()})
    return rows.withColumn("raw", F.expr(RAW).cast("long")).withColumn("score", F.expr(SCORE))


def opened(docs: DataFrame, most: int) -> DataFrame:
    """Documents with ``alike`` and ``opens``: for each line, whether it begins a topic block other than the first."""
    rows = R.topic_bounds(R.compared_lines(R.spoken(docs), most))
    # bounds are read twice, so that the fold that makes them is not put into the lambda
    return rows.withColumn("opens", F.transform("sizes", lambda n, i: F.array_contains("bounds", i) & (F.size("bounds") > 0)))


def lines(docs: DataFrame, most: int) -> DataFrame:
    """All lines with counts, times, running sums, likeness and topic blocks."""
    rows = opened(docs, most)
    rows = R.counted(R.lines_of(rows, "alike", "opens"), "alike", "opens")
    # only lines of few words of content are ever counted together
    rows = rows.withColumn("content", F.when(F.size("content") < THIN, F.col("content")))
    rows = R.clocked(rows, R.SUMS)
    gap = lambda a, b: (a - b).cast("long")
    return rows.withColumns({
        "feeling": F.col("emotion_pos") - F.col("emotion_neg"), "same_block": ~F.col("opens") & (F.col("idx") > 0),
        "gap_before": gap(F.col("start_cs"), F.lag("end_cs").over(R.by_line())), "gap_after": gap(F.lead("start_cs").over(R.by_line()), F.col("end_cs")),
    })


FIRST = ["tokens", "questions", "m_curiosity", "m_intensity", "m_continuation", "second_person", "numbers", "asks", "deictic", "conjunction"]
LAST = ["tokens", "second_person", "terminal"]


def range_rows(rows: DataFrame, low: int, high: int) -> DataFrame:
    """One row a sampled range of ``lines``: doc_id, s, e, times, sums, f_x, l_x, and what the scores read besides."""
    rows = R.ranges_ahead(rows, low, high, ["upto", "content", "feeling", "gap_after", *LAST])
    felt = F.exists("ahead", lambda z: z["feeling"] != 0)

    def last(y):
        own = F.transform(F.filter("ahead", lambda z: z["idx"] <= y["idx"]), lambda z: z["feeling"])
        return F.struct(y["idx"].alias("e"), *[y[c].alias(c) for c in ("end_cs", "upto", "content", "gap_after", *LAST)], F.when(felt, own).otherwise(F.array(F.lit(0).cast("long"))).alias("feelings"))

    rows = rows.withColumn("lasts", F.transform("picks", last))
    # an outer explode, then a filter: the inner one would have its array worked out twice
    firsts = [F.col(c).alias(f"f_{c}") for c in FIRST]
    rows = rows.select("doc_id", F.col("idx").alias("s"), "start_cs", "p", "alike", "content", "same_block", "gap_before", *firsts, F.explode_outer("lasts").alias("last")).where("last IS NOT NULL")
    at = (F.col("last.e") - F.col("s") - 1).cast("int")
    thin = F.col("f_deictic") & F.coalesce(F.size(F.array_union("content", "last.content")) < THIN, F.lit(False))
    return rows.select(
        "doc_id", "s", "last.e", "start_cs", "last.end_cs", (F.col("last.end_cs") - F.col("start_cs")).alias("span_cs"), *[R.range_sum(x) for x in R.SUMS], *[f"f_{c}" for c in FIRST], *[F.col(f"last.{c}").alias(f"l_{c}") for c in LAST],
        # as in ``scored``, a lambda keeps these many columns out of one fused method
        F.filter("last.feelings", lambda x: x.isNotNull()).alias("feelings"), thin.alias("thin"), "same_block", "gap_before", "last.gap_after", F.get("alike.before", at).alias("before"), F.get("alike.earlier", at).alias("earlier"),
    )


def rows_of(rows: DataFrame, ranges: DataFrame, high: int) -> DataFrame:
    """As ``range_rows`` for given ``ranges`` (doc_id, s, e), up to ``high`` long, over ``lines``: their first and last lines are joined.

    A range of one line is like nothing: it has no range ahead to be compared.
    """
    frame = Window.partitionBy("doc_id").orderBy("start_cs").rangeBetween(0, high)
    firsts = rows.select("doc_id", F.col("idx").alias("s"), "start_cs", "p", "alike", "content", "same_block", "gap_before", *[F.col(c).alias(f"f_{c}") for c in FIRST], F.collect_list(F.struct("idx", "feeling")).over(frame).alias("felt"))
    lasts = rows.select("doc_id", F.col("idx").alias("e"), F.struct("end_cs", "upto", "content", "gap_after", *LAST).alias("last"))
    rows = ranges.select("doc_id", "s", "e").join(firsts, ["doc_id", "s"]).join(lasts, ["doc_id", "e"])
    at = (F.col("e") - F.col("s") - 1).cast("int")
    feelings = F.transform(F.filter("felt", lambda z: z["idx"] <= F.col("e")), lambda z: z["feeling"])
    thin = F.col("f_deictic") & F.coalesce(F.size(F.array_union("content", "last.content")) < THIN, F.lit(False))
    return rows.select(
        "doc_id", "s", "e", "start_cs", "last.end_cs", (F.col("last.end_cs") - F.col("start_cs")).alias("span_cs"), *[R.range_sum(x) for x in R.SUMS], *[f"f_{c}" for c in FIRST], *[F.col(f"last.{c}").alias(f"l_{c}") for c in LAST],
        feelings.alias("feelings"), thin.alias("thin"), "same_block", "gap_before", "last.gap_after", F.get("alike.before", at).alias("before"), F.coalesce(F.get("alike.earlier", at), F.lit(0)).alias("earlier"),
    )
