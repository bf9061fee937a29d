"""Inputs that Spark derives from the given tables, each with the SQL that gives the same columns.

The given pages hold invented words and no tables, structured data or outward links, so
institution pages are built from `part` (20 parts a page), offers and search results from
`orders`, and search queries from `customer` and `nation`.  All of them grow with their table.
"""

from pyspark.sql import DataFrame, functions as F

from ..session import spread
from .registry import s_cap_words, table

PARTS_PER_PAGE = 20
AS_OF = "2024-01-31"

# ---------------------------------------------------------------- catalog pages


def catalog_rows(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("k"), F.initcap("p_name").alias("name"), F.col("p_size").alias("size"),
                    F.col("p_brand").alias("brand"), F.lower("p_type").alias("type"), F.col("p_retailprice").alias("price"),
                    F.floor(F.col("p_partkey") / PARTS_PER_PAGE).alias("page_id"))


CATALOG_SQL = f"""parts AS (SELECT p_partkey AS k, {s_cap_words('p_name')} AS name, p_size AS size, p_brand AS brand,
  lower(p_type) AS type, p_retailprice AS price, (p_partkey // {PARTS_PER_PAGE})::BIGINT AS page_id,
  'https://catalog' || (p_partkey // {PARTS_PER_PAGE}) || '.example.com/list/index.html' AS url FROM part)"""


def catalog_pages(spark, sf) -> DataFrame:
    """HTML pages with a table, a list, cards, microdata, script links and JSON-LD for 20 parts each."""
    k = F.col("k").cast("string")
    piece = {
        "row": F.concat(F.lit('<tr><td><a href="/part/'), k, F.lit('">'), "name", F.lit(" University</a></td><td>"), "brand", F.lit(".</td></tr>")),
        "item": F.when(F.col("size") % 5 == 0, F.concat(F.lit('<li><a href="https://c'), k, F.lit('.example.com/"></a>'), "name", F.lit(" College</li>.")))
        .otherwise(F.concat(F.lit('<li><a href="https://u'), k, F.lit('.example.edu/university/">'), "name", F.lit(" University</a> in town</li>."))),
        "card": F.concat(F.lit('<div class="university-card"><strong>'), "name", F.lit(' Institute of Technology</strong><a href="../inst/'), k, F.lit('">go</a></div>.')),
        "micro": F.concat(F.lit('<div itemscope itemtype="https://schema.org/CollegeOrUniversity"><span itemprop="name">'), "name",
                          F.lit(' Academy</span><a itemprop="url" href="https://a'), k, F.lit('.example.org/">site</a></div>.')),
        "js": F.concat(F.lit('<p><a href="javascript:void(0)" data-url="/js/'), k, F.lit('">'), "name", F.lit(" School</a></p>.")),
        "head": F.concat(F.lit("<h3>"), "name", F.lit(' College</h3><p>see <a href="?col='), k, F.lit('">more research</a></p>.')),
        "ld": F.concat(F.lit('{"@type":"CollegeOrUniversity","name":"'), "name", F.lit(' Polytechnic University",'),
                       F.when(F.col("size") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"url":"https://p'), k, F.lit('.example.edu",'))),
                       F.lit('"description":"d'), k, F.lit('"}')),
    }
    rows = spread(catalog_rows(spark, sf), "page_id").select("page_id", "k", *[c.alias(n) for n, c in piece.items()])
    packed = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", *piece))).alias("_r"))
    part = lambda n, sep="": F.array_join(F.transform("_r", lambda r: r[n]), sep)
    no = F.col("page_id").cast("string")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Best Universities Catalog "), no,
        F.lit('</title><meta name="Description" content="Institutions  of block '), no, F.lit('"><script type="application/ld+json">['),
        part("ld", ","), F.lit("]</script></head><body><table><tr><th>University</th><th>Brand</th></tr>"), part("row"),
        F.lit("</table><ul>"), part("item"), F.lit("</ul>"), part("card"), part("micro"), part("js"), part("head"), F.lit("</body></html>"))
    return packed.select("page_id", F.concat(F.lit("https://catalog"), no, F.lit(".example.com/list/index.html")).alias("url"), html.alias("html"))


def odd_pages(spark, sf) -> DataFrame:
    """One page per part with links as browsers accept them: unquoted, with references, with tags inside, never closed."""
    k = F.col("k").cast("string")
    html = F.concat(F.lit("<p><a href=/unq"), k, F.lit('>Unquoted</a> <a href="https://e'), k, F.lit('.example.edu/?a=1&amp;b=2">Universit&eacute; &#233; '), "name",
                    F.lit("</a><a HREF='https://n"), k, F.lit(".example.org/x'>\n Foo <b>Bar</b> <!-- no --></a><a name=here>Anchor</a><a href>Empty</a><a href=\"https://o"), k,
                    F.lit('.example.com/">open'))
    return spread(catalog_rows(spark, sf)).select(F.col("k").alias("page_id"), F.concat(F.lit("https://odd"), k, F.lit(".example.com/dir/page")).alias("url"), html.alias("html"))


_AT = "'https://odd' || k || '.example.com/"
ODD_SQL = CATALOG_SQL + f""", odd AS (SELECT k AS page_id, {_AT}dir/page' AS url, x.no::BIGINT AS no, x.href AS href, x.text AS text, x.target AS target
  FROM (SELECT k, unnest([
    {{'no': 0, 'href': '/unq' || k, 'text': 'Unquoted', 'target': {_AT}unq' || k}},
    {{'no': 1, 'href': 'https://e' || k || '.example.edu/?a=1&b=2', 'text': 'Université é ' || name, 'target': 'https://e' || k || '.example.edu/?a=1&b=2'}},
    {{'no': 2, 'href': 'https://n' || k || '.example.org/x', 'text': 'FooBar', 'target': 'https://n' || k || '.example.org/x'}},
    {{'no': 3, 'href': '', 'text': 'Empty', 'target': {_AT}dir/page'}},
    {{'no': 4, 'href': 'https://o' || k || '.example.com/', 'text': 'open', 'target': 'https://o' || k || '.example.com/'}}]) AS x FROM parts))"""

# ----------------------------------------------------------------------- offers

_WORD = {"1": "Urgent", "2": "High", "3": "Medium", "4": "Plain", "5": "Low"}
_COUNTRY = ("Germany", "Canada", "Japan", "Norway", "Brazil")
_KIND = ("University", "College", "Institute")
_FORM = {"F": "public", "O": "private", "P": "technical"}


def _pick(column, values):
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(column == i, F.lit(v)).otherwise(out)
    return out


def offers(spark, sf) -> DataFrame:
    """One offer text per order, with an institution, an amount and a deadline."""
    o = spread(table(spark, sf, "orders"))
    word = F.lit("Plain")
    for digit, w in _WORD.items():
        word = F.when(F.left("o_orderpriority", F.lit(1)) == digit, F.lit(w)).otherwise(word)
    form = F.lit("technical")
    for status, w in _FORM.items():
        form = F.when(F.col("o_orderstatus") == status, F.lit(w)).otherwise(form)
    df = o.select(F.col("o_orderkey").alias("offer_id"), F.col("o_custkey").alias("query_id"), word.alias("word"), form.alias("form"),
                  _pick(F.col("o_custkey") % 5, _COUNTRY).alias("country"), _pick(F.col("o_orderkey") % 3, _KIND).alias("inst"),
                  F.floor("o_totalprice").cast("string").alias("amount"), F.col("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"))
    text = F.concat(F.col("word"), F.lit(" "), "inst", F.lit(" of "), "country", F.lit(" is a "), "form",
                    F.lit(" school in Springfield, MA. The Merit Scholarship is worth $"), "amount",
                    F.lit(". Application deadline: "), F.date_format("day", "MMMM d, yyyy"),
                    F.lit(". Bachelor of Arts program; see "), F.date_format("day", "yyyy-MM-dd"), F.lit("."))
    return df.withColumn("text", text)


def _case(x, values):
    return "(CASE " + " ".join(f"WHEN {x} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


OFFERS_SQL = f"""offers0 AS (SELECT o_orderkey AS offer_id, o_custkey AS query_id,
  (CASE left(o_orderpriority, 1) {' '.join(f"WHEN '{d}' THEN '{w}'" for d, w in _WORD.items())} END) AS word,
  (CASE o_orderstatus {' '.join(f"WHEN '{d}' THEN '{w}'" for d, w in _FORM.items())} ELSE 'technical' END) AS form,
  {_case('o_custkey % 5', _COUNTRY)} AS country, {_case('o_orderkey % 3', _KIND)} AS inst,
  floor(o_totalprice)::BIGINT::VARCHAR AS amount, o_orderdate AS day, o_orderstatus AS status FROM orders),
offers AS (SELECT *, word || ' ' || inst || ' of ' || country || ' is a ' || form ||
  ' school in Springfield, MA. The Merit Scholarship is worth $' || amount || '. Application deadline: ' ||
  strftime(day, '%B %-d, %Y') || '. Bachelor of Arts program; see ' || strftime(day, '%Y-%m-%d') || '.' AS text FROM offers0)"""

_TLD = ("edu", "de", "ac.uk", "com", "org")
_PATH = {"F": "admissions", "O": "ranking/top10", "P": "scholarship-2024"}


def search_results(spark, sf) -> DataFrame:
    """One search result per order, for the query of its customer."""
    path = F.lit("home")
    for status, p in _PATH.items():
        path = F.when(F.col("status") == status, F.lit(p)).otherwise(path)
    return offers(spark, sf).select(
        "query_id", F.col("offer_id").alias("pos"),
        F.concat(F.lit("https://www."), F.lower("word"), (F.col("offer_id") % 7).cast("string"), F.lit(".example."),
                 _pick(F.col("offer_id") % 5, _TLD), F.lit("/"), path, F.lit("/"), F.col("offer_id").cast("string")).alias("url"),
        F.concat("word", F.lit(" "), "inst", F.lit(" official ranking "), (F.lit(2020) + F.col("offer_id") % 8).cast("string")).alias("title"),
        F.col("text").alias("abstract"))


RESULTS_SQL = OFFERS_SQL + f""", results AS (SELECT query_id, offer_id AS pos,
  'https://www.' || lower(word) || (offer_id % 7) || '.example.' || {_case('offer_id % 5', _TLD)} || '/' ||
  (CASE status {' '.join(f"WHEN '{d}' THEN '{w}'" for d, w in _PATH.items())} ELSE 'home' END) || '/' || offer_id AS url,
  word || ' ' || inst || ' official ranking ' || (2020 + offer_id % 8) AS title, text AS abstract FROM offers)"""

# ---------------------------------------------------------------- search queries

_TEMPLATES = (
    ("best PhD programs in ", " for computer science"),
    ("Scholarship for masters in ", " apply deadline soon"),
    ("the university rankings of ", " 2025 online and campus"),
    ("how to apply to a college in ", " requirements detailed process"),
    ("study medicine degree in ", " german-taught fall 2024 part-time university rankings"),
    ("research startup company business accelerator ", " scholarships for engineering admission"),
    ("my son  wants a school program in ", ""),
)


_NATIONS = ("germany", "united states", "canada", "japan", "norway", "france", "south korea", "netherlands", "brazil", "australia")


def countries(spark, sf) -> DataFrame:
    """A country for every given nation."""
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", _pick(F.col("n_nationkey") % len(_NATIONS), _NATIONS).alias("country"))


def search_queries(spark, sf) -> DataFrame:
    """One search query per customer, about the country of its nation."""
    c = spread(table(spark, sf, "customer")).join(countries(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    n = len(_TEMPLATES)
    head = _pick(F.col("c_custkey") % n, [a for a, _ in _TEMPLATES])
    tail = _pick(F.col("c_custkey") % n, [b for _, b in _TEMPLATES])
    return c.select(F.col("c_custkey").alias("query_id"), F.concat(head, "country", tail).alias("query"), F.col("country").alias("nation"))


QUERIES_SQL = f"""countries AS (SELECT n_nationkey, {_case(f'n_nationkey % {len(_NATIONS)}', _NATIONS)} AS country FROM nation),
search_queries AS (SELECT c_custkey AS query_id,
  {_case(f'c_custkey % {len(_TEMPLATES)}', [a for a, _ in _TEMPLATES])} || country ||
  {_case(f'c_custkey % {len(_TEMPLATES)}', [b for _, b in _TEMPLATES])} AS query, country AS nation
  FROM customer JOIN countries ON c_nationkey = n_nationkey)"""

# ------------------------------------------------------------- names and records


def institution_names(spark, sf) -> DataFrame:
    """One institution name per part, with many repeats, spellings, sources and scores."""
    r = catalog_rows(spark, sf)
    k = F.col("k")
    name = F.concat(F.when(k % 4 == 0, F.lit("The ")).otherwise(F.lit("")), "name", _pick(k % 3, (" University", " College", " Institute")),
                    F.when(k % 5 == 0, F.lit("!")).otherwise(F.lit("")))
    name = F.when(k % 11 == 0, F.upper(name)).otherwise(name)
    return r.select(
        k.alias("pos"), name.alias("name"), F.concat(F.lit("https://src"), (k % 9).cast("string"), F.lit(".example.org/x")).alias("source_url"),
        (F.col("size") % 11 / 10.0).alias("confidence"), (F.floor("price") % 9 / 10.0).alias("quality"),
        _pick(k % 4, ("structured_data", "list_extraction", "link_pattern", "pattern_standard")).alias("method"),
        F.when(k % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("https://"), F.lower(F.substring_index("name", " ", 1)),
                                                        F.when(k % 8 == 2, F.lit(".edu")).otherwise(F.lit(".com")), F.lit("/h"), (k % 6).cast("string"))).alias("official_url"),
        (k % 2 == 0).alias("is_verified"))


NAMES_SQL = CATALOG_SQL + f""", names AS (SELECT k AS pos,
  (CASE WHEN k % 11 = 0 THEN upper(n) ELSE n END) AS name, 'https://src' || (k % 9) || '.example.org/x' AS source_url,
  (size % 11) / 10.0::DOUBLE AS confidence, (floor(price)::BIGINT % 9) / 10.0::DOUBLE AS quality,
  {_case('k % 4', ("structured_data", "list_extraction", "link_pattern", "pattern_standard"))} AS method,
  (CASE WHEN k % 3 = 1 THEN '' ELSE 'https://' || lower(split_part(name0, ' ', 1)) || (CASE WHEN k % 8 = 2 THEN '.edu' ELSE '.com' END) || '/h' || (k % 6) END) AS official_url,
  (k % 2 = 0) AS is_verified
  FROM (SELECT *, name AS name0, (CASE WHEN k % 4 = 0 THEN 'The ' ELSE '' END) || name || {_case('k % 3', (" University", " College", " Institute"))}
    || (CASE WHEN k % 5 = 0 THEN '!' ELSE '' END) AS n FROM parts))"""

# --------------------------------------------------------------------- learning


def vocabulary(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"), F.col("p_type").alias("category"),
                                           (F.col("p_size") % 5 + 1).alias("difficulty_level"), F.col("p_brand").alias("brand"))


VOCAB_SQL = "vocab AS (SELECT p_partkey AS id, p_name AS term, p_type AS category, (p_size % 5 + 1) AS difficulty_level, p_brand AS brand FROM part)"


def reviews(spark, sf) -> DataFrame:
    """Events read as answers of learners to 40 items each."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("review_id"), "user_id", (F.col("event_id") % 40).alias("vocabulary_id"),
                    (F.get_json_object("props", "$.k").cast("int") % 6).alias("submitted_level"),
                    (F.col("event_type") != "error").alias("is_correct"), "ts")


REVIEWS_SQL = """reviews AS (SELECT event_id AS review_id, user_id, event_id % 40 AS vocabulary_id,
  (json_extract_string(props, '$.k')::INT % 6) AS submitted_level, event_type <> 'error' AS is_correct, ts FROM events)"""
SEED = "review"
UNIT = "(('0x' || substr(md5({}), 1, 8))::UBIGINT)::DOUBLE / 4294967296.0"
STATE_SQL = REVIEWS_SQL + f""", folded AS (SELECT user_id, vocabulary_id, count(*) AS n,
   list_reduce(list_prepend(0, list(CASE WHEN is_correct THEN 1 ELSE -1 END ORDER BY ts, review_id)), lambda x, s: greatest(0, least(5, x + s))) AS level,
   arg_max(ts, (ts, review_id)) AS last_ts, arg_max(review_id, (ts, review_id)) AS last_id,
   arg_max(submitted_level, (ts, review_id)) AS last_level, arg_max(is_correct, (ts, review_id)) AS last_correct
  FROM reviews GROUP BY user_id, vocabulary_id),
timed AS (SELECT *, (CASE WHEN last_correct THEN pow(2.0, last_level) ELSE 1.0 END) AS base,
   {UNIT.format("'" + SEED + "|' || user_id || '|' || vocabulary_id || '|' || last_id")} AS u FROM folded),
progress AS (SELECT user_id, vocabulary_id, level::BIGINT AS proficiency_level, n::BIGINT AS reviews, epoch_us(last_ts) AS last_reviewed,
   epoch_us(last_ts) + floor(greatest(1.0, base + base * 0.2 * (u - 0.5)) * 86400)::BIGINT * 1000000 AS next_review FROM timed),
levels AS (SELECT user_id, least(5, floor(avg(proficiency_level)) + 1)::BIGINT AS user_level FROM progress GROUP BY user_id)"""
