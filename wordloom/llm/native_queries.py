"""Queries and DuckDB SQL of the DataFrame-only operators: 1, 7 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import weighted_mix
from .quality_rules import quality_rules
from .secrets import scan_secrets, written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_secrets(documents(spark, sf_dir))
    n = lambda k, name: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(name)
    return rows.select(
        "doc_id", n(0, "n_assign"), n(1, "n_access"), n(2, "n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


QUERIES = {"op1_source_mixing": op1_source_mixing, "op7_secret_scan": op7_secret_scan, "op10_quality_rules": op10_quality_rules}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, source_size::DOUBLE * 2.0::DOUBLE AS most, (source_size::DOUBLE * 2.0::DOUBLE) / w AS full_at,
        (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
c AS (SELECT level AS cut FROM l WHERE level <= full_at ORDER BY full_at, level LIMIT 1),
t AS (SELECT source, source_size, w, coalesce(least(most, (SELECT cut FROM c) * w), most) AS target FROM l),
q AS (SELECT row_number() OVER () AS row_id, d.doc_id, d.source, size, source_size, target, w,
        (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT row_id, size, source, turn, (source_size * turn + upto)::DOUBLE / w AS finish FROM q JOIN (VALUES (0), (1)) AS x(turn) ON size > 0),
o AS (SELECT row_id, size, (sum(size) OVER (ORDER BY finish, source NULLS LAST, turn ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS ahead FROM e),
g AS (SELECT row_id, sum(greatest(0, least(size, (SELECT floor(sum(size) * 1.5)::BIGINT FROM q) - ahead)))::BIGINT AS taken FROM o GROUP BY row_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN g USING (row_id)
"""


def _spans_sql(kind: int, pattern: str, group: int, keep: str) -> str:
    return f"""SELECT row_id, {kind} AS k, s, e, m FROM (
      SELECT row_id, m, v, (sum(gap + length(m)) OVER (PARTITION BY row_id ORDER BY i) - length(m))::BIGINT AS s,
             (sum(gap + length(m)) OVER (PARTITION BY row_id ORDER BY i))::BIGINT AS e
      FROM (SELECT row_id, unnest(m) AS m, unnest(v) AS v, unnest(g) AS gap, unnest(range(len(m))) AS i FROM (
        SELECT row_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,
               list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x))[1:len(regexp_extract_all(t, '{pattern}'))] AS g FROM d)))
    WHERE {keep}"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_NAMES = "['assign', 'access', 'hex', 'weak', 'endpoint'][(k + 1)::INT]"

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans_sql(0, _ASSIGN, 2, "length(v) >= 6")} UNION ALL {_spans_sql(1, "AKIA[A-Z0-9]+", 0, "length(m) >= 20")} UNION ALL {_spans_sql(2, "[0-9a-f]+", 0, "length(m) >= 24")}),
runs AS ({_spans_sql(3, "[A-Za-z0-9+/_-]{32,}", 0, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}),
weak AS (SELECT * FROM runs w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_id = w.row_id AND b.s < w.e AND w.s < b.e)),
ends AS ({_spans_sql(4, '''https?://[^\\x20\\x09-\\x0D"''<>]+''', 0, "true")}),
c AS (SELECT * FROM weak UNION ALL SELECT * FROM ends),
q AS (SELECT * FROM base UNION ALL SELECT * FROM ends),
more AS (SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM q WHERE q.row_id = c.row_id AND q.s - c.e <= 200 AND c.s - q.e <= 200
   AND ((c.k = 3 AND (q.k = 1 OR (q.k = 4 AND NOT EXISTS (SELECT 1 FROM ends a WHERE a.row_id = c.row_id AND a.s < c.e AND c.s < a.e)))) OR (c.k = 4 AND q.k IN (0, 1, 2))))),
b AS (SELECT row_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg({_NAMES} || ':' || s || ':' || e, ',' ORDER BY s, k) AS base FROM base GROUP BY row_id),
a AS (SELECT row_id, string_agg({_NAMES} || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (row_id) LEFT JOIN a USING (row_id)
"""

_BIN = "(({rate}) >> greatest(length(bin({rate})) - 7, 0)) << greatest(length(bin({rate})) - 7, 0)"


def _bin_sql(top: str, size: str) -> str:
    return f"CASE WHEN {size} > 0 THEN {_BIN.format(rate=f'({top} * 1000000 // greatest({size}, 1))::BIGINT')} ELSE 0 END"


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT row_id, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS gram FROM d WHERE len(w) >= 6),
r AS (SELECT row_id, p, lead(p) OVER (PARTITION BY row_id ORDER BY p) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY row_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT row_id, sum(least(5, coalesce(nxt - p, 5)))::BIGINT AS n FROM r GROUP BY row_id),
m AS (SELECT doc_id, lang, source, d.row_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
   len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
   len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS u_lines,
   coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (row_id)),
c0 AS (SELECT *, n_lines - u_lines AS n_dup_lines, coalesce('=' || lang, '') AS gl, coalesce('=' || source, '') AS gs FROM m),
long AS (SELECT row_id, gl, gs, 'b_symbols' AS measure, n_symbols AS top, word_chars AS size, {_bin_sql("n_symbols", "word_chars")} AS bin FROM c0
  UNION ALL SELECT row_id, gl, gs, 'b_lines', n_dup_lines, n_lines, {_bin_sql("n_dup_lines", "n_lines")} FROM c0
  UNION ALL SELECT row_id, gl, gs, 'b_length', word_chars, n_words, {_bin_sql("word_chars", "n_words")} FROM c0),
own AS (SELECT gl, gs, measure, bin, count(*)::HUGEINT AS c FROM long GROUP BY ALL),
al AS (SELECT measure, bin, sum(c)::HUGEINT AS c FROM own GROUP BY ALL),
na AS (SELECT measure, sum(c)::HUGEINT AS n_all FROM al GROUP BY measure),
ol AS (SELECT gl, measure, bin, sum(c)::HUGEINT AS c FROM own GROUP BY ALL),
nl AS (SELECT gl, measure, sum(c)::HUGEINT AS n_lang FROM ol GROUP BY ALL),
lw AS (SELECT gl, measure, bin, sum(w)::HUGEINT AS w FROM (SELECT gl, measure, bin, c * n_all AS w FROM ol JOIN na USING (measure)
  UNION ALL SELECT gl, measure, bin, 20 * c FROM nl JOIN al USING (measure)) GROUP BY ALL),
gr AS (SELECT DISTINCT gl, gs, measure FROM own),
gw AS (SELECT gl, gs, measure, bin, sum(w)::HUGEINT AS w FROM (
  SELECT gl, gs, measure, bin, c * n_all * (n_lang + 20) AS w FROM own JOIN nl USING (gl, measure) JOIN na USING (measure)
  UNION ALL SELECT gl, gs, measure, bin, 20 * w FROM gr JOIN lw USING (gl, measure)) GROUP BY ALL),
rk AS (SELECT *, sum(w) OVER (PARTITION BY gl, gs, measure) AS total, sum(w) OVER (PARTITION BY gl, gs, measure ORDER BY bin) AS upto FROM gw),
q AS (SELECT gl, gs, measure, min(bin) FILTER (upto * 100 >= total * 25) AS q25, min(bin) FILTER (upto * 100 >= total * 75) AS q75 FROM rk GROUP BY ALL),
f AS (SELECT row_id, measure, top, greatest(q25 - 3 * (q75 - q25), 0) * size / 1000000.0::DOUBLE AS low, (q75 + 3 * (q75 - q25)) * size / 1000000.0::DOUBLE AS high
  FROM long JOIN q USING (gl, gs, measure)),
v AS (SELECT row_id, bool_or(top > high + 3 * sqrt(high + 1) OR (measure = 'b_length' AND top < low - 3 * sqrt(low + 1))) AS bad FROM f GROUP BY row_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT bad) AS kept FROM c0 JOIN v USING (row_id)
"""

ORACLE_SQL = {"op1_source_mixing": OP1_SQL, "op7_secret_scan": OP7_SQL, "op10_quality_rules": OP10_SQL}
