"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variq.llm import _store, fingerprints, jaccard_join, langid, license_scan, line_dedup, media, mixing, pieces, secret_scan, substrings


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are counted once and written, as the mix needs them for the totals and for the rows."""
    docs = _store.documents(spark, sf_dir)
    sized = _store.Tables(spark, "op8").save(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words")))
    out = mixing.mix_sources(sized, size=F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _store.arrow_rows(spark)
    return jaccard_join.similar_documents(_store.documents(spark, sf_dir), k=4, percent=85)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _store.arrow_rows(spark)
    return substrings.remove_repeats(_store.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled documents outside the held-out fold, then labels every text."""
    _store.arrow_rows(spark)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    docs = _store.documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_spans")


SQL8 = """
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM t),
c AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS reach FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT source, source_size, CASE WHEN level >= reach THEN cap::DOUBLE
  ELSE w * min_by(CASE WHEN level < reach THEN level END, CASE WHEN level < reach THEN reach END) OVER () END AS target FROM l),
d AS (SELECT *, ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS draw, length(bin(size)) AS class FROM s),
r AS (SELECT d.doc_id, d.size, f.source_size, f.target, coalesce(f.target / nullif(f.source_size, 0)::DOUBLE, 0) AS rate,
  ('0x' || substr(md5('mix:source:' || coalesce(d.source, '')), 1, 13))::BIGINT / 4503599627370496.0 AS start,
  row_number() OVER (PARTITION BY d.source ORDER BY class DESC, draw, doc_id, size)::DOUBLE AS k
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
  (floor(rate)::BIGINT + (floor(start + k * (rate - floor(rate))) - floor(start + (k - 1) * (rate - floor(rate))))::BIGINT) * size AS taken
FROM r
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _store.arrow_rows(spark)
    return secret_scan.scan(_store.documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    _store.arrow_rows(spark)
    return fingerprints.edited_pairs(_store.documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    _store.arrow_rows(spark)
    return media.media_column(_store.documents(spark, sf_dir))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    _store.arrow_rows(spark)
    return pieces.encode(_store.documents(spark, sf_dir).select("doc_id", "text"), pieces.default_model(), columns=("n_tokens", "ids_sha256", "decoded_sha256", "round_trip")).drop("text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _store.arrow_rows(spark)
    return license_scan.scan(_store.documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _store.documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op2_line_dedup": op2_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op1_sentencepiece": op1_sentencepiece,
    "op4_media_columns": op4_media_columns,
    "op3_jaccard_join": op3_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_source_mix": op8_source_mix,
    "op9_secret_scan": op9_secret_scan,
    "op10_document_fingerprints": op10_document_fingerprints,
}
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

SQL3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""

SQL5 = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format(text="text")}, []) AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM v) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM f),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.i) AS kept, count(*) AS n FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.i = c.i WHERE c.i IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE = {"op3_jaccard_join": SQL3, "op5_substring_dedup": SQL5, "op8_source_mix": SQL8}
