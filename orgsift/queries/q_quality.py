"""Queries about record quality: records built from the given tables, with mistakes of every kind."""

from pyspark.sql import functions as F

from .. import rules
from ..operators import quality as V
from .derived import CATALOG_SQL, NAMES_SQL, OFFERS_SQL, _case, _pick, catalog_rows, institution_names, offers
from .registry import lit, query, s_any, s_collapse, s_pattern, table

_ISSUES = "array_to_string(list_filter([{}], lambda z: z IS NOT NULL), '; ')"


def _issue_sql(checks):
    return _ISSUES.format(", ".join(f"CASE WHEN {c} THEN {t} END" for c, t, _ in checks))


def _score_sql(checks):
    return "round(greatest(0.0, 1.0 - (" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0.0 END" for c, _, p in checks) + "))::DOUBLE, 6)"


def _report(df, *keys):
    return df.select(*keys, F.array_join("issues", "; ").alias("issues"), "confidence_score", "is_valid")


def _validated(source, keys, checks):
    return f"SELECT {keys}, {_issue_sql(checks)} AS issues, {_score_sql(checks)} AS confidence_score, {_issue_sql(checks)} = '' AS is_valid FROM {source}"


def _missing(fields, penalty):
    return [(f"coalesce({f}::VARCHAR, '') = ''", lit(f"Missing required field: {f}"), penalty) for f in fields]


def _domain(column, name, penalty):
    return [(f"{column} <> '' AND lower({column}) NOT IN ({', '.join(map(lit, rules.DOMAIN_VALUES[name]))})", f"{lit('Invalid ' + name + ': ')} || {column}", penalty)]


_URLS = ("https://www.example.edu/x", "http://localhost:80", "ftp://example.org", "https://10.0.0.1/a", "example.com", "")
_TYPES = ("Public", "private", "castle", "university", "")
_NAMES = ("{}", "abc", "{} guaranteed prize", "{} University of learning and of very long names that goes on and on and on until nobody reads it any more", "")
_UNI_SQL = f"""uni AS (SELECT k, replace({_case('k % 5', _NAMES)}, '{{}}', name) AS name, CASE WHEN k % 4 = 0 THEN '' ELSE 'Norway' END AS country, '' AS city, {_case('k % 6', _URLS)} AS official_url, {_case('k % 5', _TYPES)} AS type FROM parts)"""


def universities(spark, sf):
    k = F.col("k")
    return catalog_rows(spark, sf).select(k, F.replace(_pick(k % 5, _NAMES), F.lit("{}"), F.col("name")).alias("name"), F.when(k % 4 == 0, "").otherwise("Norway").alias("country"), F.lit("").alias("city"),
                                          _pick(k % 6, _URLS).alias("official_url"), _pick(k % 5, _TYPES).alias("type"))


_URL_OK = f"regexp_matches(official_url, {lit('(?i)' + rules.VALID_URL)})"
_UNI = (_missing(rules.REQUIRED_FIELDS["universities"], 0.2) + [
    ("name <> '' AND length(name) < 5", lit("University name too short"), 0.1), ("name <> '' AND length(name) > 100", lit("University name too long"), 0.1),
    (s_pattern("name", rules.RECORD_SPAM), lit("University name contains spam indicators"), 0.3), (f"official_url <> '' AND NOT {_URL_OK}", lit("Invalid URL format"), 0.2)]
    + _domain("type", "university type", 0.1))


@query("v1_universities", f"WITH {CATALOG_SQL}, {_UNI_SQL} {_validated('uni', 'k', _UNI)}")
def _(spark, sf):
    return _report(V.validate_universities(universities(spark, sf)), "k")


@query("v8_urls", f"WITH {CATALOG_SQL}, {_UNI_SQL} SELECT k, {_URL_OK} AS valid, coalesce(regexp_matches(official_url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]'), false) AS absolute FROM uni")
def _(spark, sf):
    from ..functions.url import is_absolute
    return universities(spark, sf).select("k", V.url_ok("official_url").alias("valid"), is_absolute("official_url").alias("absolute"))


_CUR = ("$", "EUR", "JPY", "")
_DATES = ("%B %-d, %Y", "%m/%d/%Y", "%Y-%m-%d", "%d/%m/%Y")
_JAVA = ("MMMM d, yyyy", "MM/dd/yyyy", "yyyy-MM-dd", "dd/MM/yyyy")
_DAY = "(CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_DATES)) + " ELSE 'soon' END)"
_SCH_SQL = f"""sch AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'ab' WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE 'Fund ' || o_orderstatus END AS provider,
  {_case('o_orderkey % 4', _CUR)} AS currency, CASE o_orderkey % 6 WHEN 0 THEN '1,200' WHEN 1 THEN '12k' WHEN 2 THEN '5,000,000' WHEN 3 THEN '' WHEN 4 THEN '99999999999999999999999999999999999999999' ELSE floor(o_totalprice)::BIGINT::VARCHAR END AS amount,
  {_DAY} AS application_deadline, o_orderkey % 3 AS lv FROM orders),
 dated AS (SELECT *, coalesce(try_strptime(application_deadline, '%B %d, %Y'), try_strptime(application_deadline, '%m/%d/%Y'), try_strptime(application_deadline, '%Y-%m-%d'), try_strptime(application_deadline, '%d/%m/%Y')) AS dt FROM sch)"""


def scholarships(spark, sf):
    k = F.col("o_orderkey")
    day = F.lit("soon")
    for i, f in enumerate(_JAVA):
        day = F.when(k % 5 == i, F.date_format("o_orderdate", f)).otherwise(day)
    amount = F.when(k % 6 == 0, "1,200").when(k % 6 == 1, "12k").when(k % 6 == 2, "5,000,000").when(k % 6 == 3, "").when(k % 6 == 4, "9" * 41).otherwise(F.floor("o_totalprice").cast("string"))
    levels = F.when(k % 3 == 0, F.array(F.lit("PhD"), F.lit("kindergarten"))).when(k % 3 == 1, F.array(F.lit("graduate")))
    return table(spark, sf, "orders").select(
        k.alias("k"), F.when(k % 13 == 0, "ab").when(k % 17 == 0, "").otherwise(F.col("o_orderpriority")).alias("name"),
        F.when(k % 11 == 0, "x").otherwise(F.concat(F.lit("Fund "), "o_orderstatus")).alias("provider"), _pick(k % 4, _CUR).alias("currency"), amount.alias("amount"),
        day.alias("application_deadline"), levels.alias("academic_level"))


_MONEY = [(f"currency <> '' AND currency NOT IN ({', '.join(map(lit, rules.CURRENCIES))})", "'Invalid currency: ' || currency", 0.15),
          ("NOT regexp_matches(replace(amount, ',', ''), '^[0-9]+$')", lit("Invalid amount format"), 0.15),
          ("regexp_matches(replace(amount, ',', ''), '^[0-9]+$') AND coalesce(try_cast(replace(amount, ',', '') AS DECIMAL(38, 0)) > 1000000, true)", lit("Amount seems unreasonably high"), 0.15)]
_DEADLINE = [("application_deadline <> '' AND dt IS NULL", lit("Invalid deadline date format"), 0.1), ("dt < TIMESTAMP '1998-01-01'", lit("Deadline is in the past"), 0.1)]
_SCH = (_missing(rules.REQUIRED_FIELDS["scholarships"], 0.25) + [("name <> '' AND length(name) < 3", lit("Scholarship name too short"), 0.1),
        ("provider <> '' AND length(provider) < 3", lit("Scholarship provider name too short"), 0.1)] + _MONEY + _DEADLINE + [("lv = 0", lit("Invalid academic level: kindergarten"), 0.05)])


@query("v2_scholarships", f"WITH {_SCH_SQL} {_validated('dated', 'k', _SCH)}")
def _(spark, sf):
    return _report(V.validate_scholarships(scholarships(spark, sf), "1998-01-01"), "k")


@query("v6_money", f"WITH {_SCH_SQL} {_validated('dated', 'k', _MONEY)}")
def _(spark, sf):
    return _report(V.with_issues(scholarships(spark, sf), V.money_issues("currency", "amount", 0.15)), "k")


@query("v7_dates", f"WITH {_SCH_SQL} SELECT k, epoch_us(dt) AS parsed FROM dated")
def _(spark, sf):
    return scholarships(spark, sf).select("k", V.parse_date("application_deadline").alias("parsed"))


_DEG = ("bachelor", "Master", "phd", "wizard")
_DUR = ("3 years", "9 years", "some", "1 year", "")
_PRG_SQL = f"""prg AS (SELECT k, name AS program_name, CASE WHEN k % 7 = 0 THEN '' ELSE 'U' END AS university, 'u' AS university_url, 'p' AS program_url, {_case('k % 4', _DEG)} AS degree_type, type AS field_of_study, {_case('k % 5', _DUR)} AS duration FROM parts)"""
_YEARS = "regexp_extract(duration, '(\\d+)', 1)::INT"
_ODD = " OR ".join(f"(lower(degree_type) = '{d}' AND {_YEARS} NOT BETWEEN {a} AND {b})" for d, (a, b) in rules.DEGREE_YEARS.items())
_PRG = (_missing(rules.REQUIRED_FIELDS["programs"], 0.25) + _domain("degree_type", "degree type", 0.15)
        + [("duration <> '' AND NOT regexp_matches(duration, '\\d')", lit("Cannot parse program duration"), 0.1),
           (f"CASE WHEN regexp_matches(duration, '\\d') THEN ({_ODD}) ELSE false END", "'Unusual duration for ' || degree_type || ': ' || duration", 0.1)])


@query("v3_programs", f"WITH {CATALOG_SQL}, {_PRG_SQL} {_validated('prg', 'k', _PRG)}")
def _(spark, sf):
    k = F.col("k")
    df = catalog_rows(spark, sf).select(k, F.col("name").alias("program_name"), F.when(k % 7 == 0, "").otherwise("U").alias("university"), F.lit("u").alias("university_url"), F.lit("p").alias("program_url"),
                                        _pick(k % 4, _DEG).alias("degree_type"), F.col("type").alias("field_of_study"), _pick(k % 5, _DUR).alias("duration"))
    return _report(V.validate_programs(df), "k")


_EVT = ("conference", "Fair", "party")
_EVT_SQL = f"""evt AS (SELECT k, CASE WHEN k % 5 = 0 THEN '' ELSE name END AS event_name, {_case('k % 3', _EVT)} AS event_type, provider AS organizer, 'u' AS official_url, application_deadline AS date, dt FROM dated)"""
_EVENT = (_missing(rules.REQUIRED_FIELDS["events"], 0.25) + _domain("event_type", "event type", 0.15) + [("date <> '' AND dt IS NULL", lit("Invalid event date format"), 0.2)])


@query("v4_events", f"WITH {_SCH_SQL}, {_EVT_SQL} {_validated('evt', 'k', _EVENT)}")
def _(spark, sf):
    k = F.col("k")
    df = scholarships(spark, sf).select(k, F.when(k % 5 == 0, "").otherwise(F.col("name")).alias("event_name"), _pick(k % 3, _EVT).alias("event_type"), F.col("provider").alias("organizer"), F.lit("u").alias("official_url"),
                                        F.col("application_deadline").alias("date"))
    return _report(V.validate_events(df), "k")


_FND = ("research_grant", "loan", "")
_FND_SQL = f"fnd AS (SELECT k, name AS program_name, provider AS funding_body, 'u' AS official_url, {_case('k % 3', _FND)} AS funding_type, currency, amount FROM dated)"
_FUND = _missing(rules.REQUIRED_FIELDS["funding"], 0.25) + _MONEY + _domain("funding_type", "funding type", 0.1)


@query("v5_funding", f"WITH {_SCH_SQL}, {_FND_SQL} {_validated('fnd', 'k', _FUND)}")
def _(spark, sf):
    df = scholarships(spark, sf).select("k", F.col("name").alias("program_name"), F.col("provider").alias("funding_body"), F.lit("u").alias("official_url"), _pick(F.col("k") % 3, _FND).alias("funding_type"), "currency", "amount")
    return _report(V.validate_funding(df), "k")


# one table of checked records of three kinds
_ALL_SQL = f"""{CATALOG_SQL}, {_UNI_SQL}, {_SCH_SQL}, {_PRG_SQL}, r AS (SELECT 'universities' AS kind, * FROM ({_validated('uni', 'k', _UNI)}) UNION ALL SELECT 'scholarships', * FROM ({_validated('dated', 'k', _SCH)})
  UNION ALL SELECT 'programs', * FROM ({_validated('prg', 'k', _PRG)}))"""


def checked(spark, sf):
    k = F.col("k")
    prg = catalog_rows(spark, sf).select(k, F.col("name").alias("program_name"), F.when(k % 7 == 0, "").otherwise("U").alias("university"), F.lit("u").alias("university_url"), F.lit("p").alias("program_url"),
                                         _pick(k % 4, _DEG).alias("degree_type"), F.col("type").alias("field_of_study"), _pick(k % 5, _DUR).alias("duration"))
    shape = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k", "issues", "confidence_score", "is_valid")
    return (shape(V.validate_universities(universities(spark, sf)), "universities")
            .unionByName(shape(V.validate_scholarships(scholarships(spark, sf), "1998-01-01"), "scholarships")).unionByName(shape(V.validate_programs(prg), "programs")))


@query("v9_accept", f"WITH {_ALL_SQL} SELECT kind, k FROM r WHERE kind = 'programs' OR is_valid OR confidence_score >= 0.7")
def _(spark, sf):
    return V.accept(checked(spark, sf)).select("kind", "k")


@query("a7_validation_report", f"WITH {_ALL_SQL} SELECT kind, count(*)::BIGINT AS total, count(*) FILTER (is_valid)::BIGINT AS valid, count(*) FILTER (NOT is_valid)::BIGINT AS invalid, round(count(*) FILTER (is_valid) / count(*), 6) AS quality FROM r GROUP BY 1")
def _(spark, sf):
    return V.validation_report(checked(spark, sf))


@query("a11_issue_frequency", f"WITH {_ALL_SQL} SELECT issue, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(issues, '; ')) AS issue FROM r WHERE issues <> '') GROUP BY 1")
def _(spark, sf):
    return V.issue_frequency(checked(spark, sf))


@query("a11_purity", f"WITH {_ALL_SQL} SELECT count(*)::BIGINT AS rows, count(*) FILTER (is_valid)::BIGINT AS kept, round(count(*) FILTER (is_valid) / count(*) * 100, 6) AS purity_pct FROM r")
def _(spark, sf):
    return V.purity(checked(spark, sf))


_CON = [("coalesce(length(topic), 0) < 1 OR length(topic) > 100", "'topic: length'", 0), (f"duration IS NOT NULL AND NOT regexp_matches(duration, {lit(rules.DURATION_PATTERN)})", "'duration: pattern'", 0),
        ("coalesce(length(language), 0) < 1 OR length(language) > 50", "'language: length'", 0), ("level IS NOT NULL AND level NOT IN ('beginner', 'intermediate', 'advanced')", "'level: enum'", 0),
        (f"learning_style IS NOT NULL AND NOT regexp_matches(learning_style, {lit(rules.LEARNING_STYLE_PATTERN)})", "'learning_style: pattern'", 0), ("resources = 0", "'resources: non_empty'", 0)]


@query("v10_topic_constraints", f"""WITH t AS (SELECT doc_id, text AS topic, CASE doc_id % 4 WHEN 0 THEN '2 weeks' WHEN 1 THEN 'a while' WHEN 2 THEN '1 day' END AS duration, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS language,
  CASE doc_id % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'native' END AS level, CASE doc_id % 2 WHEN 0 THEN 'visual' ELSE 'olfactory' END AS learning_style, doc_id % 2 AS resources FROM documents) SELECT doc_id, {_issue_sql(_CON)} AS issues, {_issue_sql(_CON)} = '' AS is_valid FROM t""")
def _(spark, sf):
    k = F.col("doc_id")
    t = table(spark, sf, "documents").select(
        k, F.col("text").alias("topic"), F.when(k % 4 == 0, "2 weeks").when(k % 4 == 1, "a while").when(k % 4 == 2, "1 day").alias("duration"), F.when(k % 5 == 0, "").otherwise(F.col("lang")).alias("language"),
        F.when(k % 3 == 0, "beginner").when(k % 3 == 1, "native").alias("level"), F.when(k % 2 == 0, "visual").otherwise("olfactory").alias("learning_style"), F.when(k % 2 == 1, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("resources"))
    return V.check_constraints(t, V.TOPIC_CONSTRAINTS).select("doc_id", F.array_join("issues", "; ").alias("issues"), "is_valid")


@query("v11_completeness", f"WITH {CATALOG_SQL}, {_UNI_SQL} SELECT k, round((({' + '.join(f'({f} <> {lit(str())})::INT' for f in rules.COMPLETENESS_FIELDS['universities'])}) / 4.0)::DOUBLE, 6) AS completeness FROM uni")
def _(spark, sf):
    return V.completeness(universities(spark, sf), rules.COMPLETENESS_FIELDS["universities"]).select("k", "completeness")


_CT = s_collapse("text")


@query("v12_clean_records", f"""SELECT doc_id, md5({_CT}) AS name_digest, CASE doc_id % 4 WHEN 0 THEN 'https://example.com/' || doc_id WHEN 1 THEN 'http://x.org' WHEN 2 THEN '' ELSE 'https://mailto' END AS url,
  {_CT} AS description FROM documents""")
def _(spark, sf):
    k = F.col("doc_id")
    url = F.when(k % 4 == 0, F.concat(F.lit(" example.com/"), k.cast("string"))).when(k % 4 == 1, "http://x.org ").when(k % 4 == 2, " ").otherwise("mailto")
    d = table(spark, sf, "documents").select(k, F.col("text").alias("name"), url.alias("url"), F.col("text").alias("description"))
    return V.clean_records(d).select("doc_id", F.md5("name").alias("name_digest"), "url", "description")


@query("v13_domains", f"WITH {CATALOG_SQL}, {_UNI_SQL}, x AS (SELECT k, type, {_case('k % 4', _DEG)} AS degree_type FROM uni) {_validated('x', 'k', _domain('type', 'university type', 0.1) + _domain('degree_type', 'degree type', 0.1))}")
def _(spark, sf):
    df = universities(spark, sf).withColumn("degree_type", _pick(F.col("k") % 4, _DEG))
    return _report(V.check_domains(df, {"type": "university type", "degree_type": "degree type"}), "k")


@query("a6_field_validity", f"""WITH {NAMES_SQL}, n AS (SELECT CASE WHEN pos % 9 = 0 THEN '' ELSE name END AS name, CASE WHEN pos % 7 = 0 THEN 'broken' ELSE official_url END AS url, confidence * 1.5 AS confidence FROM names)
 SELECT count(*)::BIGINT AS total_checked, count(*) FILTER (name <> '')::BIGINT AS valid_names, count(*) FILTER (contains(url, '://'))::BIGINT AS valid_urls, count(*) FILTER (confidence BETWEEN 0 AND 1)::BIGINT AS valid_confidence,
 (count(*) FILTER (name = '') + count(*) FILTER (url = 'broken') + count(*) FILTER (confidence > 1))::BIGINT AS validation_errors FROM n""")
def _(spark, sf):
    k = F.col("pos")
    n = institution_names(spark, sf).select(F.when(k % 9 == 0, "").otherwise(F.col("name")).alias("name"), F.when(k % 7 == 0, "broken").otherwise(F.col("official_url")).alias("url"), (F.col("confidence") * 1.5).alias("confidence"))
    return V.field_validity(n)


@query("s5_failed_rows", "SELECT event_id, event_type FROM events WHERE event_id % 3 = 1")
def _(spark, sf):
    from ..sources.tables import split_failures
    e = table(spark, sf, "events").withColumn("k", F.when(F.col("event_id") % 3 != 1, F.get_json_object("props", "$.k")))
    _, failed = split_failures(e, F.col("k").isNotNull())
    return failed.select("event_id", "event_type")


# ------------------------------------------------------------- records around hits

_TALK = ("Summer Workshop on Data Systems", "Physics Conference", "Career Fair", "Science")
_ANNOUNCED_SQL = f"""{OFFERS_SQL}, announced AS (SELECT offer_id, 'https://www.example.org/' || offer_id AS url,
  text || ' The ' || country || ' ' || {_case('offer_id % 4', _TALK)} || ' opens soon. A Travel Fellowship of $' || (offer_id % 90) || ',500 is offered; computer science applicants first.' AS text FROM offers)"""


def announced(spark, sf):
    o = offers(spark, sf)
    k = F.col("offer_id")
    more = F.concat(F.col("text"), F.lit(" The "), F.col("country"), F.lit(" "), _pick(k % 4, _TALK), F.lit(" opens soon. A Travel Fellowship of $"),
                    (k % 90).cast("string"), F.lit(",500 is offered; computer science applicants first."))
    return o.select("offer_id", F.concat(F.lit("https://www.example.org/"), k.cast("string")).alias("url"), more.alias("text"))


def _nearest_sql(record):
    """Every anchor against all hits of its text: the plain way to the nearest ones."""
    from ..operators.records import RECORDS
    from .q_text import _entity_sql
    anchor, fields = RECORDS[record]
    picks = ", ".join(f"""coalesce((SELECT x.entity FROM o x WHERE x.offer_id = a.offer_id AND x.kind = {lit(kind)}
        ORDER BY abs(x.start_pos - a.start_pos), x.no > a.no, abs(x.no - a.no) LIMIT 1), NULL) AS {name}""" for name, kind in fields.items())
    return f"""WITH {_ANNOUNCED_SQL}, e AS (SELECT offer_id, kind, pattern_no, hit_no, part AS entity, start_pos, end_pos FROM ({_entity_sql('announced', 'offer_id', 'text')})),
  o AS (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY start_pos, end_pos, kind, pattern_no, hit_no) AS no FROM e),
  n AS (SELECT a.offer_id, a.no, {s_collapse('a.entity')} AS name, {picks} FROM o a WHERE a.kind = {lit(anchor)}),
  f AS (SELECT *, 'https://www.example.org/' || offer_id AS url, row_number() OVER (PARTITION BY offer_id, lower(name) ORDER BY no) AS first FROM n)"""


def _word_sql(text, values):
    return f"coalesce(regexp_extract(lower({text}), '({'|'.join(values)})', 1), '')"


def _offer_sql(record, fields, checks, shown):
    return f"""{_nearest_sql(record)}, r AS (SELECT offer_id, url AS official_url, url AS university_url, url AS program_url, {fields} FROM f WHERE first = 1),
  c AS (SELECT *, {_issue_sql(checks)} AS issues, {_score_sql(checks)} AS confidence_score FROM r) SELECT {shown}, issues, confidence_score FROM c WHERE issues = '' OR confidence_score >= 0.7"""


@query("job_education_programs", _offer_sql(
    "programs", f"name AS program_name, {s_collapse('university')} AS university, {s_collapse('field_of_study')} AS field_of_study, {_word_sql('degree', rules.DOMAIN_VALUES['degree type'])} AS degree_type",
    _missing(rules.REQUIRED_FIELDS["programs"], 0.25) + _domain("degree_type", "degree type", 0.15), "offer_id, program_name, university, field_of_study, degree_type"))
def _(spark, sf):
    return _offers(spark, sf, "programs", "program_name", "university", "field_of_study", "degree_type")


@query("job_education_events", _offer_sql(
    "events", f"name AS event_name, {s_collapse('organizer')} AS organizer, {s_collapse('date')} AS date, {_word_sql('name', rules.DOMAIN_VALUES['event type'])} AS event_type",
    _missing(rules.REQUIRED_FIELDS["events"], 0.25) + _domain("event_type", "event type", 0.15), "offer_id, event_name, organizer, date, event_type"))
def _(spark, sf):
    return _offers(spark, sf, "events", "event_name", "organizer", "date", "event_type")


@query("job_education_funding", _offer_sql(
    "funding", f"""{s_collapse('program_name')} AS program_name, {s_collapse('funding_body')} AS funding_body, regexp_extract(name, '([$€£])', 1) AS currency, regexp_extract(name, '([0-9,]*[0-9])', 1) AS amount,
      replace({_word_sql('program_name', ('scholarship', 'fellowship', 'grant'))}, 'grant', 'research_grant') AS funding_type""",
    _missing(rules.REQUIRED_FIELDS["funding"], 0.25) + _MONEY + _domain("funding_type", "funding type", 0.1), "offer_id, program_name, funding_body, currency, amount, funding_type"))
def _(spark, sf):
    return _offers(spark, sf, "funding", "program_name", "funding_body", "currency", "amount", "funding_type")


def _offers(spark, sf, record, *columns):
    from ..plans.jobs import education_offers
    rows = education_offers(announced(spark, sf), "offer_id", "text", "url")[record]
    return rows.select("offer_id", *columns, F.array_join("issues", "; ").alias("issues"), "confidence_score")
