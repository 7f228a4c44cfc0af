"""Queries on text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.timed import timed_sentences
from tessera.plans.base import query, table

WORD_SQL = r"[\p{L}\p{N}_''’\-]+"
#: The sentences of documents with their words and synthetic times, as in operators.timed.
TIMED_SQL = rf"""
WITH pieces AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?…।॥])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}_''’\-]')) AS l FROM documents),
s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS idx FROM pieces),
t AS (SELECT doc_id, idx, sentence, regexp_extract_all(lower(sentence), '{WORD_SQL}') AS tokens FROM s),
timed AS (SELECT *, len(tokens) AS n, coalesce(sum(34 * len(tokens) + 51) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_cs FROM t),
sent AS (SELECT doc_id, idx::BIGINT AS idx, sentence, tokens, n::BIGINT AS n, start_cs, (start_cs + 34 * n - 4)::BIGINT AS end_cs FROM timed)
"""
DOC_WORDS_SQL = f"WITH w AS (SELECT doc_id, lang, text, regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}') AS words FROM documents)"


def doc_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("words", T.tokens(F.col("text")))


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


PUNCTUATION_SQL = quoted([T.PUNCTUATION])


@query(f"{DOC_WORDS_SQL} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY word")
def tokenize_words(spark, sf_dir):
    """Term and document frequency: counted by document first, so a hot word is summed from few rows."""
    each = doc_words(spark, sf_dir).select("doc_id", F.explode("words").alias("word")).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy("word").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(f"{TIMED_SQL} SELECT doc_id, idx, sentence, n, start_cs, end_cs FROM sent")
def sentence_split(spark, sf_dir):
    return timed_sentences(table(spark, sf_dir, "documents")).select("doc_id", "idx", "sentence", "n", "start_cs", "end_cs")


LEXICON = {"questions": ["what", "why", "how", "que", "was", "qui"], "first_person": ["i", "we", "ich", "wir", "je", "nous", "yo"], "articles": ["the", "la", "le", "der", "die", "das", "el", "les"]}


@query(f"{TIMED_SQL} SELECT doc_id, idx, " + ", ".join(f"floor(list_sum(list_transform(tokens, lambda x: CASE WHEN x IN ({quoted(v)}) THEN 1 ELSE 0 END)) * 10000.0 / n + 0.5)::BIGINT AS {k}" for k, v in LEXICON.items()) + ", floor(len(list_distinct(tokens)) * 10000.0 / n + 0.5)::BIGINT AS unique_ratio, floor(len(list_filter(tokens, lambda x: length(x) > 7)) * 10000.0 / n + 0.5)::BIGINT AS long_words FROM sent")
def lexical_features(spark, sf_dir):
    s = timed_sentences(table(spark, sf_dir, "documents"))
    ratio = lambda c: F.floor(c * 10000.0 / F.col("n") + 0.5).cast("long")
    return s.select(
        "doc_id", "idx", *[ratio(T.hits(F.col("tokens"), v)).alias(k) for k, v in LEXICON.items()],
        ratio(F.size(F.array_distinct("tokens"))).alias("unique_ratio"), ratio(F.size(F.filter("tokens", lambda x: F.length(x) > 7))).alias("long_words"),
    )


@query(f"{TIMED_SQL} SELECT doc_id, idx, length(regexp_replace(sentence, '[^?]', '', 'g'))::BIGINT AS questions, length(regexp_replace(sentence, '[^!]', '', 'g'))::BIGINT AS exclamations, regexp_matches(sentence, '[.!?…।]\\s*$') AS ends_terminal, tokens[1] AS first_word, n BETWEEN 5 AND 22 AS quotable FROM sent")
def sentence_stats(spark, sf_dir):
    s = timed_sentences(table(spark, sf_dir, "documents"))
    return s.select(
        "doc_id", "idx", F.length(F.regexp_replace("sentence", "[^?]", "")).cast("long").alias("questions"), F.length(F.regexp_replace("sentence", "[^!]", "")).cast("long").alias("exclamations"),
        F.col("sentence").rlike(r"[.!?…।]\s*$").alias("ends_terminal"), F.element_at("tokens", 1).alias("first_word"), F.col("n").between(5, 22).alias("quotable"),
    )


STOP = sorted({w for v in T.FINGERPRINTS.values() for w in v})


@query(f"""{DOC_WORDS_SQL}, p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM p WHERE length(word) > 2 AND word NOT IN ({quoted(STOP)}) GROUP BY ALL)
SELECT doc_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM c) WHERE rank <= 5""")
def keywords_topk(spark, sf_dir):
    """The five most frequent words of each document; the first met wins a tie."""
    p = doc_words(spark, sf_dir).select("doc_id", F.posexplode("words").alias("pos", "word")).where((F.length("word") > 2) & ~F.col("word").isin(STOP))
    c = p.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos")).cast("long")
    return c.withColumn("rank", rank).where("rank <= 5").select("doc_id", "word", "n", "rank")


@query("SELECT doc_id, " + ", ".join(f"length(regexp_replace(coalesce(text, ''), '[^{v}]', '', 'g'))::BIGINT AS {k}" for k, v in T.SCRIPTS.items()) + " FROM documents")
def script_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.length(F.regexp_replace(T.filled(F.col("text")), f"[^{v.replace('Latin', 'IsLatin').replace('Devanagari', 'IsDevanagari').replace('Cyrillic', 'IsCyrillic').replace('Arabic', 'IsArabic').replace('Han', 'IsHan')}]", "")).cast("long").alias(k) for k, v in T.SCRIPTS.items()])


def _hits_sql(words) -> str:
    return f"coalesce(list_sum(list_transform(words, lambda x: CASE WHEN x IN ({quoted(words)}) THEN 1 ELSE 0 END)), 0)::BIGINT"


FINGERPRINT_SQL = f"""{DOC_WORDS_SQL}, h AS (SELECT doc_id, lang, len(words) AS n, {", ".join(f"{_hits_sql(v)} AS h_{k}" for k, v in T.FINGERPRINTS.items())} FROM w),
g AS (SELECT *, greatest({", ".join(f"h_{k}" for k in T.FINGERPRINTS)}) AS top FROM h),
guess AS (SELECT doc_id, lang, top, CASE WHEN n < 25 OR top < 0.02 * n THEN 'und' {" ".join(f"WHEN h_{k} = top THEN '{k}'" for k in T.FINGERPRINTS)} END AS guess FROM g)"""


def guessed_language(spark, sf_dir):
    found = doc_words(spark, sf_dir).select("doc_id", "lang", F.size("words").alias("n"), *[T.hits(F.col("words"), v).alias(f"h_{k}") for k, v in T.FINGERPRINTS.items()])
    found = found.withColumn("top", F.greatest(*[f"h_{k}" for k in T.FINGERPRINTS]))
    guess = F.when((F.col("n") < 25) | (F.col("top") < 0.02 * F.col("n")), "und")
    for k in T.FINGERPRINTS:
        guess = guess.when(F.col(f"h_{k}") == F.col("top"), k)
    return found.select("doc_id", "lang", "top", guess.alias("guess"))


@query(f"{FINGERPRINT_SQL} SELECT doc_id, guess, top FROM guess")
def language_fingerprint(spark, sf_dir):
    return guessed_language(spark, sf_dir).select("doc_id", "guess", "top")


@query(f"{FINGERPRINT_SQL} SELECT lang, guess, count(*) AS n FROM guess GROUP BY ALL")
def language_accuracy(spark, sf_dir):
    return guessed_language(spark, sf_dir).groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("n"))


@query(f"{TIMED_SQL} SELECT doc_id, sum(n)::BIGINT AS tokens, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars, floor(sum(n) * 10000.0 / count(*) + 0.5)::BIGINT AS mean_length FROM sent GROUP BY doc_id")
def text_stats(spark, sf_dir):
    s = timed_sentences(table(spark, sf_dir, "documents"))
    return s.groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).cast("long").alias("chars"), F.floor(F.sum("n") * 10000.0 / F.count(F.lit(1)) + 0.5).cast("long").alias("mean_length"))


@query(f"{DOC_WORDS_SQL}, k AS (SELECT doc_id, array_to_string(words, ' ') AS key FROM w) SELECT md5(key) AS key, count(*) AS copies, min(doc_id) AS first_id FROM k GROUP BY key HAVING count(*) > 1")
def dedupe_key_groups(spark, sf_dir):
    """Documents of the same words in the same order, case and punctuation aside; whole texts count."""
    k = doc_words(spark, sf_dir).select("doc_id", F.md5(F.concat_ws(" ", "words")).alias("key"))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(65279), ''), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS body FROM pages""")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_markup(F.col("html")).alias("body"))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) AS path FROM pages)
SELECT page_id, host, CASE WHEN host = '' THEN 'invalid' WHEN regexp_matches(host, '(^|\\.)(youtube\\.com|youtu\\.be)$') THEN 'video' WHEN regexp_matches(path, '\\.(mp4|mkv|mov|webm|mp3|wav|m4a)$') THEN 'direct' ELSE 'web' END AS kind FROM p""")
def classify_url(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)).alias("host"), T.url_kind(url).alias("kind"))


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug, upper(left(p_name, 1)) || substr(p_name, 2) AS title FROM (SELECT *, regexp_replace(regexp_replace(lower(coalesce(p_name, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.sentence_case(F.col("p_name")).alias("title"))


@query(f"{TIMED_SQL} SELECT doc_id, idx, printf('%02d:%02d:%02d,%03d', start_cs // 360000, (start_cs // 6000) % 60, (start_cs // 100) % 60, start_cs % 100 * 10) AS opens, printf('%02d:%02d:%02d,%03d', end_cs // 360000, (end_cs // 6000) % 60, (end_cs // 100) % 60, end_cs % 100 * 10) AS closes FROM sent")
def clock_format(spark, sf_dir):
    s = timed_sentences(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "idx", T.clock(F.col("start_cs")).alias("opens"), T.clock(F.col("end_cs")).alias("closes"))


@query(f"""{TIMED_SQL}, x AS (SELECT doc_id, idx, unnest(tokens) AS term FROM sent), tf AS (SELECT doc_id, idx, term, count(*) AS k FROM x GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS d FROM tf GROUP BY ALL), tot AS (SELECT doc_id, count(*) AS s FROM sent GROUP BY ALL)
SELECT tf.doc_id, tf.idx, tf.term, floor(k * (ln((1.0 + s) / (1.0 + d)) + 1) / n * 10000 + 0.5)::BIGINT AS weight
FROM tf JOIN df USING (doc_id, term) JOIN tot USING (doc_id) JOIN sent USING (doc_id, idx)""")
def tfidf_terms(spark, sf_dir):
    """Weights before normalisation, a sentence being the unit of a document's term statistics."""
    s = timed_sentences(table(spark, sf_dir, "documents"))
    s = s.withColumn("s", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    tf = s.select("doc_id", "idx", "n", "s", F.explode("tokens").alias("term")).groupBy("doc_id", "idx", "term", "n", "s").agg(F.count(F.lit(1)).alias("k"))
    tf = tf.withColumn("d", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "term")))
    weight = F.col("k") * (F.log((1.0 + F.col("s")) / (1.0 + F.col("d"))) + 1) / F.col("n")
    return tf.select("doc_id", "idx", "term", T.per_myriad(weight).alias("weight"))


@query(f"""{TIMED_SQL}, p AS (SELECT doc_id, idx, list_distinct(tokens) AS a, lead(list_distinct(tokens)) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM sent)
SELECT doc_id, idx, floor(len(list_intersect(a, b)) * 10000.0 / (len(a) + len(b) - len(list_intersect(a, b))) + 0.5)::BIGINT AS similarity FROM p WHERE b IS NOT NULL""")
def jaccard_adjacent(spark, sf_dir):
    s = timed_sentences(table(spark, sf_dir, "documents")).select("doc_id", "idx", F.array_distinct("tokens").alias("a"))
    s = s.withColumn("b", F.lead("a").over(Window.partitionBy("doc_id").orderBy("idx"))).where("b IS NOT NULL")
    return s.select("doc_id", "idx", T.per_myriad(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("similarity"))


@query(f"""{TIMED_SQL}, o AS (SELECT doc_id, idx, printf('%02d:%02d:%02d,%03d', start_cs // 360000, (start_cs // 6000) % 60, (start_cs // 100) % 60, start_cs % 100 * 10) AS c FROM sent),
f AS (SELECT doc_id, idx, unnest([0, 1, 2, 3, 4]) AS form, unnest([c, replace(c, ',', '.'), substr(c, 4), left(c, 8), substr(c, 8)]) AS c FROM o), v AS (SELECT *, '^(?:(\\d+):)?(\\d{{1,2}}):(\\d{{2}})(?:[,.](\\d{{1,3}}))?$' AS p FROM f)
SELECT doc_id, idx, form, coalesce((CASE WHEN regexp_matches(c, p) THEN ((coalesce(nullif(regexp_extract(c, p, 1), ''), '0')::BIGINT * 60 + regexp_extract(c, p, 2)::BIGINT) * 60 + regexp_extract(c, p, 3)::BIGINT) * 1000
 + CASE WHEN regexp_extract(c, p, 4) = '' THEN 0 ELSE rpad(regexp_extract(c, p, 4), 3, '0')::BIGINT END ELSE 0 END), 0)::BIGINT AS ms FROM v""")
def clock_parse(spark, sf_dir):
    """Every sentence's start as a clock in five spellings (the last is none), read back."""
    opens = T.clock(F.col("start_cs"))
    forms = F.array(opens, F.replace(opens, F.lit(","), F.lit(".")), F.substr(opens, F.lit(4)), F.substring(opens, 1, 8), F.substr(opens, F.lit(8)))
    s = timed_sentences(table(spark, sf_dir, "documents")).select("doc_id", "idx", F.posexplode(forms).alias("form", "c"))
    return s.select("doc_id", "idx", "form", T.clock_to_ms(F.col("c")).alias("ms"))
