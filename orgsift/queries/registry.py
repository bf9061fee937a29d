"""Registered queries: a Spark callable and, where SQL can say it, the same result for DuckDB."""

from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from ..session import dealt

QUERIES, SQL = {}, {}
TEXTS = ("documents", "pages", "conversations")  # tables whose rows are costly to scan


def query(name: str, sql: str = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(spark, sf))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its wall-clock times are read as UTC instants."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    times = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    df = dealt(df) if name in TEXTS else df
    return df.withColumns(times) if times else df


def plain(df: DataFrame) -> DataFrame:
    """Scalar columns of a few types only, so results compare the same everywhere."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, (T.DateType,)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        out.append(c.alias(f.name))
    return df.select(*out)


# ------------------------------------------------------------------ SQL building


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_any(x: str, wanted) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in wanted) + ")"


def s_count(x: str, wanted) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(w)})::INT" for w in wanted) + ")"


def s_ladder(x: str, ladder, default=None) -> str:
    rungs = " ".join(f"WHEN {s_any(x, w)} THEN {lit(label)}" for label, w in ladder)
    return f"(CASE {rungs} ELSE {'NULL' if default is None else lit(default)} END)"


def s_tags(x: str, lexicon: dict) -> str:
    parts = ", ".join(f"CASE WHEN {s_any(x, w)} THEN {lit(label)} END" for label, w in lexicon.items())
    return f"list_sort(list_filter([{parts}], lambda z: z IS NOT NULL))"


def s_join(x: str) -> str:
    return f"coalesce(array_to_string({x}, ','), '')"


def s_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def s_caps(x: str, n: int = 1) -> str:
    return f"len(list_filter({s_words(x)}, lambda w: regexp_matches(w, '^\\p{{Lu}}') AND length(w) >= {n}))"


def s_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def s_unescape(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def s_untag(x: str) -> str:
    bare = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    return s_unescape(f"regexp_replace({bare}, '(?s)<[^>]*>', '', 'g')")


def s_strip_blocks(x: str, tags) -> str:
    for t in tags:
        x = f"regexp_replace({x}, '(?is)<{t}\\b[^>]*>.*?</{t}>', '', 'g')"
    return x


def s_pattern(x: str, patterns, flags: str = "i") -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({x}, {lit((f'(?{flags})' if flags else '') + joined)})"


def s_host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1))"


def s_home(x: str) -> str:
    return f"(regexp_extract({x}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+)', 1) || '/')"


def s_cap_words(x: str) -> str:
    """Every word of a lower-case phrase with a capital."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def s_key(x: str, dropped=()) -> str:
    """Comparison key of ASCII names: lower case, without marks and dropped words, single spaces."""
    out = f"regexp_replace(lower({x}), '[^a-z0-9_\\s]', '', 'g')"
    if dropped:
        out = f"regexp_replace({out}, '\\b(?:{'|'.join(dropped)})\\b', '', 'g')"
    return s_collapse(out)


CORE_WORDS = ("the", "university", "college", "institute")
