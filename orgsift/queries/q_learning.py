"""Queries about learning: vocabulary from `part`, answers from `events`, lessons from both."""

from pyspark.sql import functions as F

from .. import rules
from ..operators import learning as L
from ..operators.ordering import spread_row_number
from ..plans import jobs as J
from .derived import AS_OF, REVIEWS_SQL, SEED, STATE_SQL, UNIT, VOCAB_SQL, reviews, vocabulary
from .registry import lit, query, table

LATER = "2024-02-03 00:00:00"


def progress(spark, sf):
    return L.review_state(reviews(spark, sf), SEED)


@query("f18_list_vocabulary", f"WITH {VOCAB_SQL} SELECT id, term FROM vocab WHERE category = 'SMALL' AND difficulty_level = 2")
def _(spark, sf):
    return L.list_vocabulary(vocabulary(spark, sf), "SMALL", 2).select("id", "term")


@query("f18_search_vocabulary", f"WITH {VOCAB_SQL} SELECT id FROM vocab WHERE contains(lower(term), 'ing') OR contains(lower(category), 'ing') OR contains(lower(brand), 'ing') OR contains(lower(term), 'ing')")
def _(spark, sf):
    return L.search_vocabulary(vocabulary(spark, sf), "ING", ["term", "category", "brand"]).select("id")


@query("f19_categories", f"WITH {VOCAB_SQL} SELECT DISTINCT category FROM vocab")
def _(spark, sf):
    return L.categories(vocabulary(spark, sf))


@query("l5_page", f"WITH {VOCAB_SQL} SELECT id, term FROM vocab ORDER BY id LIMIT 100 OFFSET 40")
def _(spark, sf):
    return L.page_of(vocabulary(spark, sf), "id", 40, 100).select("id", "term")


_LEVELS = ("beginner", "intermediate", "advanced")
# every document is a topic: its level comes from the length of its text, its language is its own
_LEVEL_SQL = f"({list(_LEVELS)})[coalesce(length(text), 0) % 3 + 1]"
_CURR = f"curriculum AS (SELECT lang AS language, {_LEVEL_SQL} AS level, 'Topic ' || doc_id AS topic, '1 week' AS duration, 'https://example.com/' || doc_id AS resource_url FROM documents)"


def _level():
    return F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.coalesce(F.length("text"), F.lit(0)) % 3 + 1).cast("int"))


def curriculum(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("lang").alias("language"), _level().alias("level"), F.concat(F.lit("Topic "), F.col("doc_id").cast("string")).alias("topic"),
        F.lit("1 week").alias("duration"), F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("resource_url"))


# a request asks for one topic of its language and level: topics and requests are dealt to places by their numbers
@query("f20_curriculum", f"""WITH {_CURR}, place AS (SELECT *, row_number() OVER (PARTITION BY language, level ORDER BY topic) AS place_no FROM curriculum),
 c AS (SELECT language || '-' || place_no AS language, level, topic, duration, resource_url FROM place),
 r AS (SELECT conv_id, turn, (['en', 'fr', 'it'])[conv_id % 3 + 1] || '-' || (conv_id // 3 + 1) AS language, (['beginner', 'intermediate', 'advanced', 'native'])[turn % 4 + 1] AS level FROM conversations),
 q(level, vocabulary_range, required_score) AS (VALUES {', '.join(f"({lit(a)}, {lit(b)}, {d}::DOUBLE)" for a, b, _, d in rules.LEVEL_REQUIREMENTS)})
 SELECT conv_id, turn, language, level, coalesce(topic, 'Getting Started') AS topic, coalesce(resource_url, 'https://example.com/' || language || '/' || level || '/intro') AS resource_url, vocabulary_range, required_score
 FROM r LEFT JOIN c USING (language, level) LEFT JOIN q USING (level)""")
def _(spark, sf):
    pick = lambda c, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (c % len(v) + 1).cast("int"))
    numbered = spread_row_number(curriculum(spark, sf), ["language", "level"], F.substring("topic", 1, 8), ["topic"], "at")
    topics = numbered.withColumn("language", F.concat_ws("-", "language", "at")).drop("at")
    req = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat_ws("-", pick(F.col("conv_id"), "en", "fr", "it"), F.expr("conv_id div 3 + 1")).alias("language"),
        pick(F.col("turn"), "beginner", "intermediate", "advanced", "native").alias("level"))
    levels = spark.createDataFrame([(a, b, d) for a, b, _, d in rules.LEVEL_REQUIREMENTS], "level string, vocabulary_range string, required_score double")
    return L.curriculum_or_default(req, topics, levels).select("conv_id", "turn", "language", "level", "topic", "resource_url", "vocabulary_range", "required_score")


_STYLE = "(['visual', 'auditory', 'reading'])[(c_custkey % 3 + 1)::INT]"


@query("f21_recommend", f"""SELECT c_custkey, CASE {_STYLE} WHEN 'visual' THEN 'Incorporate visual aids and videos.' WHEN 'auditory' THEN 'Include podcasts and audio resources.' END AS advice,
  'Basic ' || CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE lower(c_mktsegment) END || ' lessons for ' || CASE WHEN c_custkey % 4 = 0 THEN 'beginner' ELSE 'advanced' END || ' level' AS resource FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    profiles = table(spark, sf, "customer").select(k, F.when(k % 3 == 0, "visual").when(k % 3 == 1, "auditory").otherwise("reading").alias("learning_style"),
                                                   F.when(k % 5 != 0, F.lower("c_mktsegment")).alias("language"), F.when(k % 4 != 0, F.lit("advanced")).alias("proficiency_level"))
    return L.recommend(profiles).select("c_custkey", "advice", "resource")


@query("s9_append_assessment", """WITH a AS (SELECT lang AS language, source AS level, 'old' AS title, doc_id FROM documents WHERE doc_id % 2 = 0), n AS (SELECT lang AS language, source AS level, 'new' AS title, doc_id FROM documents WHERE doc_id % 2 = 1)
  SELECT * FROM a UNION ALL SELECT * FROM n WHERE EXISTS (SELECT 1 FROM a WHERE a.language = n.language AND a.level = n.level)""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    shape = lambda r, t: d.filter(F.col("doc_id") % 2 == r).select(F.col("lang").alias("language"), F.col("source").alias("level"), F.lit(t).alias("title"), "doc_id")
    return L.append_assessment(shape(0, "old"), shape(1, "new"))


@query("s9_upsert_topics", f"WITH {_CURR} SELECT language, level, topic FROM curriculum UNION ALL SELECT lang, source, 'Talk ' || doc_id FROM documents")
def _(spark, sf):
    new = table(spark, sf, "documents").select(F.col("lang").alias("language"), F.col("source").alias("level"), F.concat(F.lit("Talk "), F.col("doc_id").cast("string")).alias("topic"))
    return L.upsert_topics(curriculum(spark, sf), new).select("language", "level", "topic")


# ------------------------------------------------------------- state and statistics


@query("t1_review_state", f"WITH {STATE_SQL} SELECT * FROM progress")
def _(spark, sf):
    return progress(spark, sf)


@query("a2_user_levels", f"WITH {STATE_SQL} SELECT * FROM levels")
def _(spark, sf):
    return L.user_levels(progress(spark, sf))


_STATS = """SELECT user_id, count(*)::BIGINT AS reviewed_items, count(*) FILTER (proficiency_level >= 4)::BIGINT AS mastered_items, least(5, floor(avg(proficiency_level)) + 1)::BIGINT AS current_level,
  (SELECT count(*) FROM vocab)::BIGINT AS total_items, count(*) / (SELECT count(*) FROM vocab) * 100 AS completion_rate FROM progress GROUP BY 1"""


@query("a1_study_stats", f"WITH {STATE_SQL}, {VOCAB_SQL} {_STATS}")
def _(spark, sf):
    return L.study_stats(vocabulary(spark, sf), progress(spark, sf))


def _streak_sql(day):
    return f"""SELECT user_id, count(*) FILTER (d = DATE '{day}' - (r - 1)::INT)::BIGINT AS streak FROM (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) AS r
  FROM (SELECT DISTINCT user_id, ts::DATE AS d FROM reviews)) GROUP BY 1"""


@query("w1_streaks", f"WITH {REVIEWS_SQL} {_streak_sql('2024-01-30')}")
def _(spark, sf):
    return L.streaks(reviews(spark, sf), "2024-01-30")


@query("study_report", f"WITH {STATE_SQL}, {VOCAB_SQL}, st AS ({_STATS}), sk AS ({_streak_sql('2024-01-30')}) SELECT st.*, streak FROM st LEFT JOIN sk USING (user_id)")
def _(spark, sf):
    return J.study_report(vocabulary(spark, sf), reviews(spark, sf), "2024-01-30")


# ------------------------------------------------------------------------- sessions


@query("j3_new_items", f"WITH {STATE_SQL}, {VOCAB_SQL} SELECT id FROM vocab WHERE id NOT IN (SELECT vocabulary_id FROM progress)")
def _(spark, sf):
    return L.new_items(vocabulary(spark, sf), progress(spark, sf)).select("id")


_DUE = f"""due AS (SELECT user_id, vocabulary_id, next_review, difficulty_level FROM progress JOIN vocab ON id = vocabulary_id JOIN levels USING (user_id)
  WHERE next_review <= epoch_us(TIMESTAMP '{LATER}') AND difficulty_level <= user_level)"""


@query("j4_due_items", f"WITH {STATE_SQL}, {VOCAB_SQL}, {_DUE} SELECT * FROM due")
def _(spark, sf):
    return L.due_items(vocabulary(spark, sf), progress(spark, sf), LATER).select("user_id", "vocabulary_id", "next_review", "difficulty_level")


# every learner sees the items of its level as a ring in hash order and reads it from its own start
def _ring(seed):
    return f"""lv AS (SELECT unnest(range(1, 6)) AS level), ring AS (SELECT level, id, row_number() OVER (PARTITION BY level ORDER BY md5('{seed}|' || id), id) AS place, count(*) OVER (PARTITION BY level) AS size
   FROM vocab JOIN lv ON greatest(difficulty_level, 1) <= level),
 walk AS (SELECT user_id, id AS vocabulary_id, ((place - 1 - floor({UNIT.format("'" + seed + "|' || user_id")} * size)::BIGINT) % size + size) % size AS off FROM levels JOIN ring ON level = user_level)"""


def _sample(seed, n, unseen):
    gate = "WHERE NOT EXISTS (SELECT 1 FROM progress p WHERE p.user_id = walk.user_id AND p.vocabulary_id = walk.vocabulary_id)" if unseen else ""
    return f"SELECT user_id, vocabulary_id, place FROM (SELECT user_id, vocabulary_id, row_number() OVER (PARTITION BY user_id ORDER BY off) AS place FROM walk {gate}) WHERE place <= {n}"


@query("l7_standard_session", f"WITH {STATE_SQL}, {VOCAB_SQL}, {_ring('s1')} {_sample('s1', 5, False)}")
def _(spark, sf):
    return L.sample_per_user(vocabulary(spark, sf), L.user_levels(progress(spark, sf)), 5, "s1")


_SESSION = f"""fresh AS ({_sample('s2', 3, True)}), waiting AS (SELECT user_id, vocabulary_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY next_review, vocabulary_id) AS place FROM due) WHERE place <= 2)
 SELECT user_id, vocabulary_id, place, 'new' AS part, 1::BIGINT AS part_no FROM fresh UNION ALL SELECT user_id, vocabulary_id, place, 'due', 2 FROM waiting"""


@query("u2_study_session", f"WITH {STATE_SQL}, {VOCAB_SQL}, {_DUE}, {_ring('s2')}, {_SESSION}")
def _(spark, sf):
    return J.study_session(vocabulary(spark, sf), progress(spark, sf), LATER, "s2")


# -------------------------------------------------------------------------- lessons


def lessons(spark, sf):
    """One lesson per order: the items its lines name."""
    li = table(spark, sf, "lineitem")
    ids = li.groupBy(F.col("l_orderkey").alias("lesson_id")).agg(F.sort_array(F.collect_set("l_partkey")).alias("vocabulary_ids"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("lesson_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("completed"))
    return ids.join(o, "lesson_id")


@query("j5_lesson_items", f"WITH {VOCAB_SQL} SELECT DISTINCT l_orderkey AS lesson_id, id, term FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN vocab ON id = l_partkey")
def _(spark, sf):
    return L.lesson_items(lessons(spark, sf), vocabulary(spark, sf)).select("lesson_id", "id", "term")


@query("l8_latest_open_lesson", """SELECT o_custkey AS user_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS lesson_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    return L.latest_open_lesson(lessons(spark, sf)).select("user_id", "lesson_id")


_GOALS = "goals AS (SELECT c_custkey AS goal_id, unnest([CASE c_custkey % 3 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'PROMO' ELSE 'LARGE' END, CASE WHEN c_custkey % 2 = 0 THEN 'ECONOMY' ELSE 'MEDIUM' END]) AS category FROM customer)"


@query("j6_category_items", f"WITH {VOCAB_SQL}, {_GOALS} SELECT goal_id, id, place FROM (SELECT goal_id, id, row_number() OVER (PARTITION BY goal_id ORDER BY id) AS place FROM goals JOIN vocab USING (category)) WHERE place <= 10")
def _(spark, sf):
    k = F.col("c_custkey")
    focus = F.array(F.when(k % 3 == 0, "SMALL").when(k % 3 == 1, "PROMO").otherwise("LARGE"), F.when(k % 2 == 0, "ECONOMY").otherwise("MEDIUM"))
    goals = table(spark, sf, "customer").select(k.alias("goal_id"), focus.alias("focus_categories"))
    return L.category_items(goals, vocabulary(spark, sf), 10).select("goal_id", "id", "place")


@query("s8_new_vocabulary_ids", f"WITH {VOCAB_SQL} SELECT event_id, (SELECT max(id) FROM vocab) + row_number() OVER (ORDER BY event_id) AS id FROM events WHERE event_type = 'signup'")
def _(spark, sf):
    from ..sources.tables import with_new_ids
    new = table(spark, sf, "events").filter("event_type = 'signup'").select("event_id")
    return with_new_ids(vocabulary(spark, sf), new, "event_id")
