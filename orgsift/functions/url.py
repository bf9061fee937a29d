"""Column functions over URLs, with the results of RFC 3986 resolution."""

from pyspark.sql import Column, functions as F

from .text import any_word, as_col

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"


def scheme(c) -> Column:
    return F.lower(F.regexp_extract(as_col(c), _SCHEME, 1))


def host(c) -> Column:
    """Host with port and user part, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(as_col(c), _HOST, 1))


def path(c) -> Column:
    return F.regexp_extract(as_col(c), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_absolute(c) -> Column:
    return (scheme(c) != "") & (host(c) != "")


def is_http(c) -> Column:
    return scheme(c).isin("http", "https") & (host(c) != "")


def homepage(c) -> Column:
    c = as_col(c)
    root = F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)
    return F.when(root != "", F.concat(root, F.lit("/"))).otherwise(c)


def _fold_dots(p: Column) -> Column:
    """Remove . and .. segments of an absolute path."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)

    def step(done, part):
        return (F.when(part == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
                .when(part == ".", done)
                .otherwise(F.concat(done, F.array(part))))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folded = F.array_join(kept, "/")
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(F.contains(p, F.lit("/.")), folded).otherwise(p)


def resolve(base, href) -> Column:
    """The URL a link stands for on the page at base."""
    base, href = as_col(base), F.trim(as_col(href))
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    base_path = path(base)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    no_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    return (F.when(href == "", base)
            .when(href.rlike(_SCHEME), href)
            .when(F.startswith(href, F.lit("//")),
                  F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1), href))
            .when(F.startswith(href, F.lit("#")), F.concat(no_fragment, href))
            .when(F.startswith(href, F.lit("?")), F.concat(no_query, href))
            .when(F.startswith(href, F.lit("/")), F.concat(root, _fold_dots(href_path), href_rest))
            .otherwise(F.concat(root, _fold_dots(F.concat(folder, href_path)), href_rest)))


def with_scheme(c) -> Column:
    """A cleaned URL: https:// is added when no scheme is given; empty without a host."""
    c = F.trim(as_col(c))
    full = F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.when((c != "") & (host(full) != ""), full).otherwise(F.lit(""))


def host_label_name(c) -> Column:
    """Institution name from the first label of the host; empty when it is no word."""
    label = F.regexp_extract(F.regexp_replace(F.regexp_replace(host(c), r"^www\.", ""), r"^m\.", ""),
                             r"^([^.]*)\.", 1)
    return F.when(label.rlike(r"^\p{L}{3,}$"), F.concat(F.initcap(label), F.lit(" University"))).otherwise(F.lit(""))


def is_crawlable(c, skipped, social) -> Column:
    c = as_col(c)
    low = F.lower(c)
    bad_end = F.lit(False)
    for ext in skipped:
        bad_end = bad_end | F.endswith(low, F.lit(ext))
    return is_absolute(c) & ~bad_end & ~any_word(host(c), social)
