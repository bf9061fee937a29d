"""Record validation, cleaning and quality reports.

A check is a list of (condition, issue text, penalty).  Each table gets issues, is_valid and
confidence_score = 1 minus the penalties, not below 0.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.text import any_pattern, as_col, collapse, cut_words, printable
from ..functions.url import is_absolute, with_scheme


def _empty(c) -> Column:
    c = as_col(c)
    return F.coalesce(c.cast("string") == "", F.lit(True))


def _filled(c) -> Column:
    return ~_empty(c)


def with_issues(df: DataFrame, checks) -> DataFrame:
    """Add the issues of all checks that hold, in order, with score and verdict."""
    held = [(F.coalesce(cond, F.lit(False)), as_col(text) if isinstance(text, Column) else F.lit(text), penalty) for cond, text, penalty in checks]
    issues = F.array_compact(F.array(*[F.when(c, t) for c, t, _ in held]))
    lost = reduce(lambda x, y: x + y, [F.when(c, F.lit(float(p))).otherwise(0.0) for c, _, p in held], F.lit(0.0))
    return df.withColumns({"issues": issues, "confidence_score": F.round(F.greatest(F.lit(0.0), 1.0 - lost), 6)}).withColumn(
        "is_valid", F.size("issues") == 0)


def required(kind: str, penalty: float, fields: dict = rules.REQUIRED_FIELDS):
    return [(_empty(f), f"Missing required field: {f}", penalty) for f in fields[kind]]


def url_ok(c) -> Column:
    return as_col(c).rlike("(?i)" + rules.VALID_URL)


def url_issues(column: str, penalty: float = 0.2):
    return [(_filled(column) & ~url_ok(column), "Invalid URL format", penalty)]


def domain_issues(column: str, domain: str, penalty: float, values: dict = rules.DOMAIN_VALUES):
    bad = _filled(column) & ~F.lower(F.col(column)).isin(*values[domain])
    return [(bad, F.concat(F.lit(f"Invalid {domain}: "), F.col(column)), penalty)]


def money_issues(currency: str, amount: str, penalty: float, currencies=rules.CURRENCIES, limit: int = rules.AMOUNT_LIMIT):
    """Known currency, digits only once commas are gone, and not above the limit."""
    digits = F.replace(F.col(amount), F.lit(","), F.lit(""))
    numeric = digits.rlike("^[0-9]+$")
    size = digits.try_cast("decimal(38,0)")
    return [(_filled(currency) & ~F.col(currency).isin(*currencies), F.concat(F.lit("Invalid currency: "), F.col(currency)), penalty),
            (F.col(amount).isNotNull() & ~numeric, "Invalid amount format", penalty),
            (numeric & F.coalesce(size > limit, F.lit(True)), "Amount seems unreasonably high", penalty)]


def parse_date(c, formats=rules.DATE_FORMATS) -> Column:
    """First of the formats that reads the whole text; month before day unless the month is too large."""
    return F.coalesce(*[F.try_to_timestamp(as_col(c), F.lit(f)) for f in formats])


def date_issues(column: str, penalty: float, label: str = "deadline", as_of: str = None):
    when = parse_date(column)
    checks = [(_filled(column) & when.isNull(), f"Invalid {label} date format", penalty)]
    if as_of is not None:
        checks.append((_filled(column) & (when < F.lit(as_of).cast("timestamp")), "Deadline is in the past", penalty))
    return checks


def length_issues(column: str, what: str, least: int, most: int, penalty: float):
    n = F.length(column)
    checks = [(_filled(column) & (n < least), f"{what} too short", penalty)]
    if most:
        checks.append((_filled(column) & (n > most), f"{what} too long", penalty))
    return checks


def duration_issues(duration: str, degree: str, penalty: float, ranges: dict = rules.DEGREE_YEARS):
    years = F.regexp_extract(F.col(duration), r"(\d+)", 1).try_cast("long")
    odd = F.lit(False)
    for d, (low, high) in ranges.items():
        odd = odd | ((F.lower(F.col(degree)) == d) & ~years.between(low, high))
    return [(_filled(duration) & ~F.col(duration).rlike(r"\d"), "Cannot parse program duration", penalty),
            (_filled(duration) & odd, F.concat(F.lit("Unusual duration for "), F.col(degree), F.lit(": "), F.col(duration)), penalty)]


# ------------------------------------------------------------------- record kinds


def validate_universities(df: DataFrame, spam=rules.RECORD_SPAM) -> DataFrame:
    return with_issues(df, required("universities", 0.2)
                       + length_issues("name", "University name", 5, 100, 0.1)
                       + [(any_pattern("name", spam), "University name contains spam indicators", 0.3)]
                       + url_issues("official_url")
                       + domain_issues("type", "university type", 0.1))


def validate_scholarships(df: DataFrame, as_of: str) -> DataFrame:
    levels = rules.DOMAIN_VALUES["academic level"]
    base = with_issues(df, required("scholarships", 0.25)
                       + length_issues("name", "Scholarship name", 3, 0, 0.1)
                       + length_issues("provider", "Scholarship provider name", 3, 0, 0.1)
                       + money_issues("currency", "amount", 0.15)
                       + date_issues("application_deadline", 0.1, as_of=as_of))
    bad = F.filter(F.coalesce("academic_level", F.array().cast("array<string>")), lambda x: ~F.lower(x).isin(*levels))
    return base.withColumns({
        "issues": F.concat("issues", F.transform(bad, lambda x: F.concat(F.lit("Invalid academic level: "), x))),
        "confidence_score": F.round(F.greatest(F.lit(0.0), F.col("confidence_score") - F.size(bad) * 0.05), 6)}).withColumn(
        "is_valid", F.size("issues") == 0)


def validate_programs(df: DataFrame) -> DataFrame:
    return with_issues(df, required("programs", 0.25) + domain_issues("degree_type", "degree type", 0.15)
                       + duration_issues("duration", "degree_type", 0.1))


def validate_events(df: DataFrame) -> DataFrame:
    return with_issues(df, required("events", 0.25) + domain_issues("event_type", "event type", 0.15)
                       + date_issues("date", 0.2, label="event"))


def validate_funding(df: DataFrame) -> DataFrame:
    return with_issues(df, required("funding", 0.25) + money_issues("currency", "amount", 0.15)
                       + domain_issues("funding_type", "funding type", 0.1))


def accept(results: DataFrame, least: float = 0.7, checked=("universities", "scholarships")) -> DataFrame:
    """Valid or well scored rows; kinds that are not checked pass."""
    return results.filter(~F.col("kind").isin(*checked) | F.col("is_valid") | (F.col("confidence_score") >= least))


def check_domains(df: DataFrame, domains: dict, values: dict = rules.DOMAIN_VALUES) -> DataFrame:
    """domains maps a column to the name of its value list; one issue per bad value."""
    checks = [c for column, domain in domains.items() for c in domain_issues(column, domain, 0.1, values)]
    return with_issues(df, checks)


def check_constraints(df: DataFrame, constraints) -> DataFrame:
    """Constraints are (column, kind, argument): enum, length, pattern, list_enum or non_empty.

    A missing value only breaks non_empty and the lower length bound.
    """
    checks = []
    for column, kind, arg in constraints:
        c = F.col(column)
        if kind == "enum":
            bad = c.isNotNull() & ~c.isin(*arg)
        elif kind == "length":
            low, high = arg
            bad = (F.coalesce(F.length(c), F.lit(0)) < low) | (F.length(c) > high)
        elif kind == "pattern":
            bad = c.isNotNull() & ~c.rlike(arg)
        elif kind == "list_enum":
            bad = F.exists(c, lambda x: ~x.isin(*arg))
        else:
            bad = F.coalesce(F.size(c) <= 0, F.lit(True))
        checks.append((bad, f"{column}: {kind}", 0.0))
    return with_issues(df, checks)


TOPIC_CONSTRAINTS = (
    ("topic", "length", (1, 100)), ("duration", "pattern", rules.DURATION_PATTERN),
    ("language", "length", (1, 50)), ("level", "enum", rules.LANGUAGE_LEVELS),
    ("learning_style", "pattern", rules.LEARNING_STYLE_PATTERN), ("resources", "non_empty", None),
)
RESOURCE_CONSTRAINTS = (
    ("title", "length", (1, 100)), ("type", "enum", rules.RESOURCE_TYPES),
    ("url", "pattern", rules.RESOURCE_URL_PATTERN), ("description", "length", (0, 500)),
)
PROFILE_CONSTRAINTS = (
    ("learning_goal", "enum", rules.LEARNING_GOALS), ("struggles", "list_enum", rules.STRUGGLES),
    ("learning_style", "list_enum", rules.PROFILE_STYLES), ("industry", "enum", rules.INDUSTRIES),
    ("language", "length", (1, 50)), ("custom_goal", "length", (0, 500)),
    ("custom_struggle", "length", (0, 500)), ("custom_industry", "length", (0, 100)),
)


def completeness(df: DataFrame, fields) -> DataFrame:
    """Share of the fields that are filled."""
    filled = reduce(lambda x, y: x + y, [_filled(f).cast("int") for f in fields])
    return df.withColumn("completeness", F.round(filled / float(len(fields)), 6))


def clean_records(df: DataFrame, name: str = "name", url: str = "url", description: str = "description", description_chars: int = None) -> DataFrame:
    """Collapsed printable text, URLs with a scheme; descriptions stay whole unless a length is given, then they are cut at a word."""
    text = printable(collapse(description))
    return df.withColumns({name: printable(collapse(name)), url: with_scheme(url),
                           description: cut_words(text, description_chars) if description_chars else text})


# ------------------------------------------------------------------------ reports


def with_validity(orgs: DataFrame) -> DataFrame:
    """valid_name, valid_url, valid_confidence and the error texts of organisations."""
    errors = F.array_compact(F.array(
        F.when(_empty("name"), F.lit("Empty name for organization")),
        F.when(_filled("url") & ~is_absolute("url"), F.concat(F.lit("Invalid URL: "), F.col("url"))),
        F.when(F.coalesce(~F.col("confidence").between(0, 1), F.lit(True)),
               F.concat(F.lit("Invalid confidence score: "), F.coalesce(F.col("confidence").cast("string"), F.lit("null"))))))
    return orgs.withColumns({"valid_name": _filled("name"), "valid_url": _filled("url") & is_absolute("url"),
                             "valid_confidence": F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "errors": errors})


def field_validity(orgs: DataFrame) -> DataFrame:
    return with_validity(orgs).agg(
        F.count(F.lit(1)).alias("total_checked"), F.count_if("valid_name").alias("valid_names"),
        F.count_if("valid_url").alias("valid_urls"), F.count_if("valid_confidence").alias("valid_confidence"),
        F.sum(F.size("errors")).cast("long").alias("validation_errors"))


def validation_report(results: DataFrame) -> DataFrame:
    return results.groupBy("kind").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.round(F.count_if("is_valid") / F.count(F.lit(1)), 6).alias("quality"))


def validation_summary(joined: DataFrame, least: float = 0.3) -> DataFrame:
    """Original, valid and reclassified organisations, and the share that stayed."""
    ok = F.col("is_organization") & (F.col("validation_score") >= least)
    return joined.agg(F.count(F.lit(1)).alias("original"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("reclassified")).withColumn(
        "success_pct", F.when(F.col("original") > 0, F.round(F.col("valid") / F.col("original") * 100, 6)).otherwise(0.0))


def processing_summary(status: DataFrame) -> DataFrame:
    """Counts of rows by their status: duplicate, invalid, filtered or kept."""
    return status.agg(
        F.count(F.lit(1)).alias("input"), F.count_if(F.col("status") == "duplicate").alias("duplicates_removed"),
        F.count_if(F.col("status") == "invalid").alias("invalid"),
        F.count_if(F.col("status") == "filtered").alias("filtered"), F.count_if(F.col("status") == "kept").alias("output"))


def issue_frequency(results: DataFrame) -> DataFrame:
    return results.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def purity(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_valid").alias("kept")).withColumn(
        "purity_pct", F.round(F.col("kept") / F.col("rows") * 100, 6))


def confidence_bands(orgs: DataFrame, edges=(0.3, 1.0, 2.0), kind: str = "org_type") -> DataFrame:
    """Rows and share per (score band, type)."""
    band = F.lit(f"<{edges[0]}")
    for low, high in zip(edges, (*edges[1:], None)):
        band = F.when(F.col("confidence") >= low, F.lit(f"{low}-{high}" if high else f"{low}+")).otherwise(band)
    counts = orgs.groupBy(band.alias("band"), F.col(kind).alias("org_type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / counts.agg(F.sum("n")).scalar(), 6))


def kind_distribution(entities: DataFrame, kind: str = "kind") -> DataFrame:
    counts = entities.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / counts.agg(F.sum("n")).scalar(), 6))


def extraction_stats(entities: DataFrame, source: str = "source") -> DataFrame:
    return entities.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def discovery_counts(names: DataFrame) -> DataFrame:
    return names.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("high_confidence"),
        F.count_if("is_verified").alias("verified"))


def roll_up_sources(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Entities of all sources with duplicates counted once per (kind, name, link), next to source totals."""
    once = entities.groupBy("kind", F.lower(F.trim("name")).alias("_n"), F.lower(F.trim("link")).alias("_l")).agg(F.count(F.lit(1)).alias("_c"))
    kinds = once.groupBy("kind").agg(F.count(F.lit(1)).alias("unique_entities"), F.sum("_c").alias("entities"))
    return kinds.withColumns({"sources": sources.agg(F.count(F.lit(1))).scalar(),
                              "mean_quality": sources.agg(F.round(F.avg("quality"), 6)).scalar()})
