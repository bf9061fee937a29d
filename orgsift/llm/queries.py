"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunk_prints import fingerprints_with_next
from .exact_dups import deduplicated
from .language import languages, train as train_language
from .licenses import build_index, scan_licenses
from .mixing import mixed
from .near_dups import near_duplicates
from .neighbours import nearest
from .packing import pack, with_digests
from .prefix_trie import conversation_trie
from .quality import quality_scores, train as train_quality
from .resampling import resample
from .toxicity import severity, train as train_toxicity
from .url_filter import judge, rule_table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


#: SQL pieces: A-Z in lower case, and the five-word shingles of a text.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


@query("op1_near_duplicates", sql=f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                 WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) sh FROM w),
d AS (SELECT DISTINCT doc_id, sh FROM s),
n AS (SELECT doc_id, count(*) n FROM d GROUP BY 1),
met AS (SELECT x.doc_id a, y.doc_id b, count(*) i FROM d x JOIN d y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT n_shingles, least(doc_id, coalesce(r.m, doc_id)) component_id,
       doc_id = least(doc_id, coalesce(r.m, doc_id)) kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a doc_id, min(b) m FROM reach GROUP BY 1) r USING (doc_id)""")
def op1_near_duplicates(spark, sf):
    return near_duplicates(read(spark, sf, "documents"))


@query("op8_exact_duplicates", sql=f"""
WITH t AS (SELECT doc_id, sha256({_LOW}) text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) keep_id, count(*) group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id kept, text_sha256 FROM t JOIN g USING (text_sha256)""")
def op8_exact_duplicates(spark, sf):
    return deduplicated(read(spark, sf, "documents"))


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


# the given pages carry no canonical links and no refreshes; if one had them, this SQL would not know
@query("op2_url_filter", sql=f"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {_fits(h, x)} THEN '{h}{x}'" for _, h, x in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} END rule FROM p)
SELECT *, CASE WHEN rule IN ({", ".join(f"'{h}{x}'" for v, h, x in RULES if v == "block")}) THEN 'block' ELSE 'allow' END verdict,
       CAST(NULL AS VARCHAR) alias_of FROM r""")
def op2_url_filter(spark, sf):
    return judge(read(spark, sf, "pages"), rule_table(spark, RULES))


@query("op4_toxicity")
def op4_toxicity(spark, sf):
    docs = read(spark, sf, "documents")
    return severity(docs.select("doc_id", "text"), train_toxicity(docs, read(spark, sf, "labels"))).select(
        "doc_id", "severity", "p_toxic", "grade")


@query("op5_mixing")
def op5_mixing(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "source", "mix_pass", "mix_block", "mix_weight", "mix_order")


@query("op3_packing")
def op3_packing(spark, sf):
    return with_digests(pack(read(spark, sf, "documents")))


@query("op7_fingerprints")
def op7_fingerprints(spark, sf):
    return fingerprints_with_next(read(spark, sf, "documents"))


@query("op10_licenses")
def op10_licenses(spark, sf):
    docs = read(spark, sf, "documents")
    found = scan_licenses(docs, build_index(docs))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).drop("spans")


@query("op6_quality")
def op6_quality(spark, sf):
    docs = read(spark, sf, "documents")
    return quality_scores(docs, train_quality(docs, read(spark, sf, "labels")))


#: CRC-32 in SQL: the table of the 256 remainders is made by its rule, eight halvings of each byte.
_CRC_TABLE = """crc_steps(b, k, v) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i) UNION ALL
    SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) tab FROM crc_steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    """The SQL of the unsigned CRC-32 of the UTF-8 bytes of a text, given crc_table."""
    raw = f"hex(encode({text}))"
    bytes_of = f"list_transform(range(1, len({raw}), 2), lambda p: ('0x' || substr({raw}, p, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_of}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_ALNUM_SQL = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@query("op11_prefix_trie", sql=f"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, list(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || '/'
                           || len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) ORDER BY turn NULLS FIRST) own
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, own, {_crc32("conv_id::VARCHAR")} % 4 h FROM o, crc_table),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h], h.own[h + 1:]) s FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, len(s) n, unnest(range(0, len(s) + 1)) d, s FROM r),
k AS (SELECT conv_id, n, d, array_to_string(s[1:d], ' ') p, array_to_string(s[1:d - 1], ' ') up,
             CASE WHEN d = 0 THEN 0 ELSE split_part(s[d], '/', 2)::BIGINT END w FROM m),
v AS (SELECT d, p, min(up) up, min(conv_id) conv_id, count(*) n_convs, min(w) w,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) ends_sha256 FROM k GROUP BY 1, 2),
c AS (SELECT v.d, v.p, count(x.p) n_children FROM v LEFT JOIN v x ON x.d = v.d + 1 AND x.up = v.p GROUP BY 1, 2),
under AS (SELECT DISTINCT a.d, array_to_string(a.s[1:a.d], ' ') p, b.d bd, array_to_string(a.s[1:b.d], ' ') bp FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
t AS (SELECT u.d, u.p, sum((x.n_convs - 1) * x.w) saved_tokens, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) n_leaves
      FROM under u JOIN v x ON x.d = u.bd AND x.p = u.bp JOIN c ON c.d = u.bd AND c.p = u.bp GROUP BY 1, 2)
SELECT v.conv_id, v.d::BIGINT AS "depth", y.conv_id parent_conv_id, v.n_convs, n_children, n_leaves::BIGINT n_leaves, saved_tokens::BIGINT saved_tokens, v.ends_sha256
FROM v JOIN c USING (d, p) JOIN t USING (d, p) LEFT JOIN v y ON y.d = v.d - 1 AND y.p = v.up""")
def op11_prefix_trie(spark, sf):
    return conversation_trie(read(spark, sf, "conversations"))


@query("op12_resampling", sql=f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '{_ALNUM_SQL}')) w FROM documents),
a AS (SELECT unnest(regexp_extract_all({_LOW}, '{_ALNUM_SQL}')) w FROM benchmark),
ws AS (SELECT w, {_crc32("w")} % 10000 b FROM (SELECT w FROM d UNION SELECT w FROM a), crc_table),
s AS (SELECT b, count(*) n FROM d JOIN ws USING (w) GROUP BY 1),
t AS (SELECT b, count(*) n FROM a JOIN ws USING (w) GROUP BY 1),
g AS (SELECT i b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
          / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT gain
      FROM range(10000) r(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i),
f AS (SELECT doc_id, count(*) n_features, floor(sum(gain) / count(*))::BIGINT weight FROM d JOIN ws USING (w) JOIN g USING (b) GROUP BY 1),
p AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT n_features, coalesce(weight, 0)::BIGINT weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT score
    FROM documents LEFT JOIN f USING (doc_id)),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r, count(*) OVER () n FROM p WHERE n_features >= 20)
SELECT p.*, r::BIGINT AS rank FROM p LEFT JOIN (SELECT doc_id, r FROM e WHERE r <= floor(10 * n / 100)) USING (doc_id)""")
def op12_resampling(spark, sf):
    return resample(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


# a table of less than two leaves, as the small ones are, is searched whole, so its answers are the exact ones of this SQL
@query("op13_neighbours", sql="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, n::INTEGER AS "rank", vec_id, score FROM r WHERE n <= 20""")
def op13_neighbours(spark, sf):
    return nearest(read(spark, sf, "embeddings"))


@query("op9_language")
def op9_language(spark, sf):
    docs = read(spark, sf, "documents")
    return languages(docs, train_language(docs))
