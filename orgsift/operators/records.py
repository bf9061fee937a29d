"""Records of programs, events and funding from the typed hits of a text.

A record is made around one hit (a program, an event, an amount); its other fields are the nearest
hits of other kinds in the same text.  One sweep over the hits in order, from both sides, finds them:
nothing is joined, and no hit meets all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rules
from ..functions.text import collapse

#: Kinds of records: the hit they are made around, and the kinds whose nearest hit gives a field.
RECORDS = {
    "programs": ("program", {"university": "university", "degree": "degree", "field_of_study": "subject"}),
    "events": ("event", {"organizer": "university", "date": "deadline"}),
    "funding": ("amount", {"program_name": "scholarship", "funding_body": "university"}),
}
_ORDER = ("start_pos", "end_pos", "kind", "pattern_no", "hit_no")


def nearest_hits(hits: DataFrame, keys, anchor: str, fields: dict, within: int = None) -> DataFrame:
    """Every hit of kind `anchor` with the text of the nearest hit of other kinds, as columns named by `fields`.

    hits(keys, kind, entity, start_pos, end_pos, pattern_no, hit_no).  Nearest is by where hits begin;
    of equally near ones the earlier stands first.  With `within`, hits further away do not count.  A
    field without a hit is null.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = hits.where(F.col("kind").isin(anchor, *fields.values()))
    before = W.partitionBy(*keys).orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in _ORDER]).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = {kind: F.when(F.col("kind") == kind, F.struct("start_pos", "entity")) for kind in set(fields.values())}
    rows = rows.select("*", *[F.last(x, ignorenulls=True).over(w).alias(f"_{side}_{kind}")
                              for kind, x in seen.items() for side, w in (("left", before), ("right", after))]).where(F.col("kind") == anchor)

    def nearest(kind) -> Column:
        left, right = F.col(f"_left_{kind}"), F.col(f"_right_{kind}")
        gap = lambda x: F.abs(x["start_pos"] - F.col("start_pos"))
        one = F.when(right.isNull() | (gap(left) <= gap(right)), left).otherwise(right)
        return F.when(gap(one) <= within, one["entity"]) if within is not None else one["entity"]

    return rows.select(*keys, *_ORDER, "entity", *[nearest(kind).alias(name) for name, kind in fields.items()])


def _named(text, values) -> Column:
    """The first of the values that stands in a text, in lower case; empty without one."""
    return F.coalesce(F.regexp_extract(F.lower(text), "(" + "|".join(values) + ")", 1), F.lit(""))


def records_of(hits: DataFrame, keys, record: str, url: str, within: int = None, domains: dict = rules.DOMAIN_VALUES) -> DataFrame:
    """Records of one kind with the columns that its validation reads; one per key and name, the first of its text.

    hits as for nearest_hits, with the address of the page in `url`.  Names are collapsed to single
    spaces; an amount gives its currency sign and its digits.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    anchor, fields = RECORDS[record]
    # hits meet once by the keys alone: that serves the sweeps and the choice per name, and the sweeps' columns are made behind it
    rows = nearest_hits(hits.repartition(*keys), [*keys, url], anchor, fields, within)
    rows = rows.withColumns({c: collapse(c) for c in ["entity", *fields]})
    link = F.col(url)
    if record == "programs":
        rows = rows.withColumns({"program_name": F.col("entity"), "university_url": link, "program_url": link, "duration": F.lit(None).cast("string"),
                                 "degree_type": _named("degree", domains["degree type"])})
        name = "program_name"
    elif record == "events":
        rows = rows.withColumns({"event_name": F.col("entity"), "official_url": link, "event_type": _named("entity", domains["event type"])})
        name = "event_name"
    else:
        kind = _named("program_name", ("scholarship", "fellowship", "grant"))
        rows = rows.withColumns({
            "official_url": link, "funding_type": F.when(kind == "grant", F.lit("research_grant")).otherwise(kind),
            "currency": F.regexp_extract("entity", "([$€£])", 1), "amount": F.regexp_extract("entity", r"([\d,]*\d)", 1)})
        name = "entity"
    order = F.struct(*_ORDER)
    shown = [c for c in rows.columns if c not in (*_ORDER, "entity", "degree", *keys)]
    first = rows.groupBy(*keys, F.lower(name).alias("_name")).agg(F.min_by(F.struct(*shown), order).alias("_r"))
    return first.select(*keys, "_r.*")
