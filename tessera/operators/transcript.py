"""Documents as lines of numbers, and the ranges over them.

What a line counts, how alike it is to others and where topics change is worked
out on its document's row; only then are lines put together by document, so the
one exchange carries numbers, never texts.  Running sums and the ends ahead of a
start are windows on that one partitioning; a range's sums are subtractions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.functions.phrases import phrase_counts
from tessera.operators.similarity import UNIT, likeness

#: The synthetic clock in hundredths of a second: a word lasts 34, the last one of a line 4 less, and 51 pass between lines.
WORD, PAUSE, TAIL = 34, 51, 4
#: A block of one topic lasts 12 to 240 seconds and breaks at a pause of 1.6; without enough lines cohesion under 0.08 breaks it.
LEAST_BLOCK, MOST_BLOCK, LONG_PAUSE = 1_200, 24_000, 160
#: Sums over a line; a marker group counts its different phrases.
GROUPS = [f"m_{g}" for g in L.MARKERS]
SUMS = ["tokens", *GROUPS, "numbers", "questions", "exclamations", "first_person", "second_person", "imperatives", "fillers", "emotion_pos", "emotion_neg", "past_tense", "quotable", "articles", "finals", "turns"]
#: Runs of letters and digits, a decimal point or comma between digits included.
NUMBER_RUNS = r"[\p{L}\p{N}_]+(?:[.,]\p{N}+[\p{L}\p{N}_]*)?"
PLAIN_WORDS = r"[\p{L}\p{N}_]+(?:'t)?"
ARTICLES = ["the", "la", "le", "der", "die", "das", "el", "les"]


def by_line():
    return Window.partitionBy("doc_id").orderBy("idx")


def dealt(docs: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores is dealt out, so that all of them read lines; a large one stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def spoken(docs: DataFrame) -> DataFrame:
    """doc_id, found (lines of text), words (an array a line), sizes (words a line)."""
    rows = dealt(docs.select("doc_id", "text")).select("doc_id", T.sentences(F.col("text")).alias("found"))
    rows = rows.withColumn("words", F.transform("found", T.tokens))
    return rows.withColumn("sizes", F.transform("words", lambda w: F.size(w).cast("long")))


def content_terms(words: Column) -> Column:
    """The words that count in TF-IDF."""
    return F.filter(F.transform(words, T.normalize_word), lambda w: (w != "") & ~w.isin(L.STOPWORDS))


def compared_lines(rows: DataFrame, most: int) -> DataFrame:
    """Adds ``alike`` (see ``likeness``) for ranges up to ``most`` long."""
    return rows.withColumn("alike", likeness(F.transform("words", content_terms), F.col("sizes"), WORD, PAUSE, TAIL, most))


def topic_bounds(rows: DataFrame) -> DataFrame:
    """Adds ``bounds``, the lines at which a new topic block begins (the first line's block begins without one).

    A block ends after a line whose cohesion with the next ones lies under the document's mean less 0.55 standard deviations (0.02 at
    least), or that has filled it, once it is long enough.  Cohesions are whole millionths, so mean and deviation are exact.
    """
    lines = F.zip_with("sizes", "alike", lambda n, x: F.struct(n.alias("n"), x["cohesion"].cast("long").alias("c")))
    moments = F.aggregate("alike", F.struct(*[F.lit(0).cast("long").alias(x) for x in ("n", "s", "q")]), lambda a, x: F.when(x["cohesion"].isNull(), a).otherwise(F.struct(
        (a["n"] + 1).alias("n"), (a["s"] + x["cohesion"]).alias("s"), (a["q"] + x["cohesion"].cast("long") * x["cohesion"]).alias("q"))))
    rows = rows.withColumns({"moments": moments, "lines": lines})
    n, s, q = (F.col(f"moments.{x}").cast("double") for x in ("n", "s", "q"))
    spread = F.greatest(F.lit(0.02 * UNIT), s / n - 0.55 * F.sqrt((n * q - s * s) / (n * n)))
    rows = rows.withColumn("threshold", F.when(F.col("moments.n") >= 4, spread).otherwise(0.08 * UNIT))
    # each line is told the threshold beforehand: a fold reads nothing but its own arguments
    told = F.transform("lines", lambda x, i: F.struct(x["n"].alias("n"), i.alias("i"), ((x["c"] < F.col("threshold")) & F.col("threshold").isNotNull()).alias("drops"), x["c"].isNull().alias("last")))
    zero = F.lit(0).cast("long")

    def step(a: Column, x: Column) -> Column:
        span = a["at"] + WORD * x["n"] - TAIL - a["begin"]
        then = a["at"] + WORD * x["n"] + PAUSE
        breaks = ~x["last"] & (x["drops"] | F.lit(PAUSE + TAIL >= LONG_PAUSE) | (span >= MOST_BLOCK)) & (span >= LEAST_BLOCK)
        return F.struct(then.alias("at"), F.when(breaks, then).otherwise(a["begin"]).alias("begin"), F.when(breaks, F.array_append(a["bounds"], x["i"] + 1)).otherwise(a["bounds"]).alias("bounds"))

    start = F.struct(zero.alias("at"), zero.alias("begin"), F.array().cast("array<int>").alias("bounds"))
    return rows.withColumn("bounds", F.aggregate(told, start, step, lambda a: a["bounds"])).drop("moments", "lines", "threshold")


def lines_of(rows: DataFrame, *more: str) -> DataFrame:
    """One row a line: doc_id, idx, sentence, words, n and the elements of the arrays ``more``."""
    found = rows.select("doc_id", F.posexplode(F.arrays_zip("found", "words", "sizes", *more)).alias("idx", "x"))
    return found.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("x.found").alias("sentence"), "x.words", F.col("x.sizes").alias("n"), *[f"x.{m}" for m in more])


def counted(rows: DataFrame, *keep: str) -> DataFrame:
    """doc_id, idx, n, ``keep``, the counts of ``SUMS``, how the line starts and ends, and ``content`` (its different longer words)."""
    rows = rows.withColumns({"low": F.lower(F.trim("sentence")), "clean": F.filter(F.transform("words", T.normalize_word), lambda w: w != "")})
    rows = rows.withColumns({"found": phrase_counts(F.col("low"), L.MARKERS), "distinct": F.array_distinct("clean")})
    char = lambda c: F.length("low") - F.length(F.replace("low", F.lit(c), F.lit("")))
    number = lambda w: w.rlike(r"^[0-9]+([.,].*)?$") | w.isin(L.NUMBER_WORDS)
    some = lambda lexicon: F.exists("distinct", lambda w: w.isin(lexicon))
    first = F.coalesce(F.get("clean", F.lit(0)), F.lit(""))
    terminal = F.col("low").rlike(r"[.!?…।]$")
    tokens = F.size("clean")
    counts = {g: F.get("found", F.lit(i)) for i, g in enumerate(GROUPS)} | {
        "tokens": tokens, "numbers": F.size(F.filter(F.regexp_extract_all("low", F.lit(NUMBER_RUNS), F.lit(0)), number)), "questions": char("?"), "exclamations": char("!"),
        "first_person": T.hits(F.col("clean"), L.FIRST_PERSON), "second_person": T.hits(F.col("clean"), L.DIRECT_ADDRESS), "imperatives": T.hits(F.regexp_extract_all("low", F.lit(PLAIN_WORDS), F.lit(0)), L.IMPERATIVES),
        "fillers": T.hits(F.col("clean"), L.FILLERS), "emotion_pos": T.hits(F.col("distinct"), L.POSITIVE), "emotion_neg": T.hits(F.col("distinct"), L.NEGATIVE), "past_tense": T.hits(F.col("clean"), L.PAST_TENSE),
        "quotable": tokens.between(5, 22) & ~some(L.FILLERS) & some(L.QUOTABLE), "articles": T.hits(F.col("words"), ARTICLES), "finals": terminal, "turns": F.contains("low", F.lit("turns out")),
    }
    kinds = {"terminal": terminal, "asks": first.isin(L.QUESTION_STARTS), "deictic": first.isin(L.DEICTIC_STARTS), "conjunction": first.isin(L.CONJUNCTIONS)}
    content = F.filter("distinct", lambda w: ~w.isin(L.STOPWORDS) & (F.length(w) > 3)).alias("content")
    return rows.select("doc_id", "idx", "n", *keep, *[counts[k].cast("long").alias(k) for k in SUMS], *[c.alias(k) for k, c in kinds.items()], content)


def clocked(rows: DataFrame, sums: list[str]) -> DataFrame:
    """Adds start_cs and end_cs, and ``p`` and ``upto``, the running sums of ``sums`` before and with each line."""
    before = by_line().rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("long"))
    rows = rows.withColumns({"start_cs": total(WORD * F.col("n") + PAUSE), **{f"p_{c}": total(c) for c in sums}})
    rows = rows.withColumns({"end_cs": F.col("start_cs") + WORD * F.col("n") - TAIL, "p": F.array(*[F.col(f"p_{c}") for c in sums]), "upto": F.array(*[F.col(f"p_{c}") + F.col(c) for c in sums])})
    return rows.drop(*[f"p_{c}" for c in sums])


def ranges_ahead(rows: DataFrame, low: int, high: int, carry: list[str], most: int = 14) -> DataFrame:
    """Adds ``ahead``, the lines from this one on that start at most ``high`` after it (idx, end_cs, ``carry``), and ``picks``.

    ``picks`` has at most ``most`` of the later ones whose end is ``low`` to ``high`` after this start: the extremes and evenly
    spaced ones.  A frame is a stretch of time, so its length does not grow with the document.
    """
    frame = Window.partitionBy("doc_id").orderBy("start_cs").rangeBetween(0, high)
    rows = rows.withColumn("ahead", F.collect_list(F.struct("idx", "end_cs", *carry)).over(frame))
    rows = rows.withColumn("fits", F.filter("ahead", lambda y: (y["idx"] > F.col("idx")) & (y["end_cs"] - F.col("start_cs")).between(low, high)))
    m = F.size("fits")
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (m - 1) / (most - 1) + 0.5).cast("int")))
    return rows.withColumn("picks", F.when(m <= most, F.col("fits")).otherwise(F.transform(spaced, lambda k: F.get("fits", k)))).drop("fits")


def range_sum(name: str) -> Column:
    """The sum of ``name`` over the lines of a range, from the running sums before its first (``p``) and with its last (``last.upto``)."""
    k = F.lit(SUMS.index(name))
    return (F.get("last.upto", k) - F.get("p", k)).alias(name)
