"""Column functions over text.  All of them stay in the JVM."""

import re
from functools import lru_cache, reduce
from re import _constants as _re_codes, _parser as _re_parser  # the parsed form of a pattern

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"\p{L}\p{N}_"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, **columns) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter moves below a projection by copying the expressions it reads, so a text that many
    conditions look at would be built again for each of them.  It does not move below an explode.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], made).select(*[F.col(f"`{c}`") for c in kept], "_once.*")


_BITS = 1 << 18  # one bit for each value of a hash, in 4096 numbers


def hash_bits(df: DataFrame, value) -> Column:
    """The bits of the hashes of a column as 4096 numbers, however long the table is."""
    bit = df.select(F.pmod(F.hash(value), F.lit(_BITS)).alias("_b"))
    parts = bit.groupBy(F.expr("_b DIV 64").alias("_k")).agg(F.expr("bit_or(shiftleft(1L, CAST(_b % 64 AS INT)))").alias("_v"))
    return parts.agg(F.expr(f"transform(sequence(0, {_BITS // 64 - 1}), k -> coalesce(try_element_at(map_from_entries(collect_list(struct(CAST(_k AS INT) AS k, _v AS v))), k), 0L))").alias("_first")).scalar()


def has_bit(bits, value) -> Column:
    """Whether a value may be among those of hash_bits; false only if it is not."""
    bit = F.pmod(F.hash(value), F.lit(_BITS))
    return F.getbit(F.get(bits, F.shiftright(bit, 6)), bit % 64) == 1


def collapse(c) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(as_col(c), r"(?U)\s+", " "))


def words(c) -> Column:
    return F.filter(F.split(as_col(c), r"(?U)\s+"), lambda w: w != "")


def cut_words(c, n: int) -> Column:
    """At most n characters, cut back to the last space, with an ellipsis."""
    c = as_col(c)
    head = F.left(c, F.lit(n))
    kept = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(c) > n, F.concat(kept, F.lit("..."))).otherwise(c)


def printable(c) -> Column:
    return F.regexp_replace(as_col(c), r"[\p{C}\p{Z}&&[^ ]]", "")


def has(c, word: str) -> Column:
    return F.contains(as_col(c), F.lit(word))


def count_words(c, wanted) -> Column:
    """How many of the wanted words occur in the text, as substrings."""
    total = F.lit(0)
    for w in wanted:
        total = total + has(c, w).cast("int")
    return total


def any_word(c, wanted) -> Column:
    hit = F.lit(False)
    for w in wanted:
        hit = hit | has(c, w)
    return hit


def first_label(c, ladder, default=None) -> Column:
    """Label of the first rung that has one of its words in the text."""
    out = F.lit(default)
    for label, wanted in reversed(list(ladder)):
        out = F.when(any_word(c, wanted), F.lit(label)).otherwise(out)
    return out


def any_pattern(c, patterns, flags: str = "iu") -> Column:
    """One scan with all the patterns joined into an alternation."""
    if not patterns:
        return F.lit(False)
    joined = "|".join(f"(?:{p})" for p in patterns)
    return as_col(c).rlike((f"(?{flags})" if flags else "") + joined)


def literal(word: str) -> str:
    return re.escape(word)


def capitalised(c, min_len: int = 1) -> Column:
    """Number of words of at least min_len characters that start with a capital."""
    return F.size(F.filter(words(c), lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) >= min_len)))


def capital_ratio(c) -> Column:
    n = F.size(words(c))
    return F.when(n > 0, capitalised(c) / n).otherwise(F.lit(0.0))


def _drop_words(c, dropped) -> Column:
    return F.regexp_replace(c, rf"(?<![{WORD}])(?:{'|'.join(dropped)})(?![{WORD}])", "")


def _drop_marks(c) -> Column:
    return F.regexp_replace(c, rf"(?U)[^{WORD}\s]", "")


def key_plain(c) -> Column:
    """Comparison key: lower case, no punctuation, single spaces."""
    return collapse(_drop_marks(F.lower(as_col(c))))


def key_without_articles(c) -> Column:
    return collapse(_drop_marks(_drop_words(F.lower(as_col(c)), ("the", "a", "an"))))


def key_core(c) -> Column:
    """Comparison key without the words that name the kind of institution."""
    return collapse(_drop_words(_drop_marks(F.lower(as_col(c))), ("the", "university", "college", "institute")))


def jaccard(a, b) -> Column:
    """Word-set similarity of two arrays; null when one is empty."""
    a, b = as_col(a), as_col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b)))


def sorted_set(c) -> Column:
    return F.sort_array(F.array_distinct(as_col(c)))


def as_like(c, needle: str) -> Column:
    """Case-insensitive substring test that takes % and _ literally."""
    return F.contains(F.lower(as_col(c)), F.lit(needle.lower()))


def before_first_separator(c, separators) -> Column:
    """Text before the first separator of the list that occurs at all."""
    c = as_col(c)
    out = c
    for sep in reversed(separators):
        out = F.when(has(c, sep), F.substring_index(c, sep, 1)).otherwise(out)
    return out


def stripped(c) -> Column:
    return F.regexp_replace(as_col(c), r"(?U)^\s+|\s+$", "")


def salvage_block(c) -> Column:
    """From the first opening brace to the last closing one; null when there is none."""
    c = as_col(c)
    start = F.instr(c, "{")
    end = F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when((start > 0) & (F.instr(c, "}") > 0) & (end >= start),
                  F.substring(c, start, end - start + 1))


def unit_hash(*parts) -> Column:
    """A repeatable number in [0, 1) from the given values."""
    digest = F.md5(F.concat_ws("|", *[as_col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# ------------------------------------------------------------- what a pattern cannot hit without

#: Characters that match an ASCII letter regardless of case although their lower case is another one.
_FOLDED_AWAY = "\u017f\u0131\u0130"


def _needs(parsed) -> tuple:
    """The texts of which one stands in every match of a parsed pattern; none means unknown."""
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is _re_codes.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append((run.lower(),))
            run = ""
        if op is _re_codes.SUBPATTERN:
            found.append(_needs(arg[-1]))
        elif op is _re_codes.BRANCH:
            each = [_needs(b) for b in arg[1]]
            found.append(tuple(x for e in each for x in e) if all(each) else ())
        elif op in (_re_codes.MAX_REPEAT, _re_codes.MIN_REPEAT, _re_codes.POSSESSIVE_REPEAT) and arg[0] > 0:
            found.append(_needs(arg[2]))
    return max(found, key=lambda f: min(map(len, f), default=0), default=())


@lru_cache(1000)
def needed_literals(pattern: str) -> tuple:
    """Lower-case texts of which at least one stands in the lower case of every text that the pattern hits.

    The longest run of plain characters that no match can leave out, or one run for each branch of
    an alternative.  Empty where there is none, or where the pattern is not in Python's dialect.
    """
    try:
        return tuple(dict.fromkeys(_needs(_re_parser.parse(re.sub(r"^\(\?[a-z]+\)", "", pattern)))))
    except (re.error, OverflowError):
        return ()


def folded_away(text) -> Column:
    """Whether a text has letters that match others than their own lower case."""
    return any_word(text, _FOLDED_AWAY)


def may_hit(text, low, pattern: str, odd: Column = None) -> Column:
    """Whether the pattern, taken without regard to case, can hit a text whose lower case is `low`: a cheap test that never errs on the side of no.

    `odd` is folded_away of the text, for callers that test many patterns.
    """
    words_ = needed_literals(pattern)
    if not words_:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(as_col(low), F.lit(w)) for w in words_] + [folded_away(text) if odd is None else odd])
