"""One query for each operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard, licenses, line_dedup, packing, pii, quality, secrets, sharding, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.identify(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_pii, op3_decontamination, op4_quality, op5_sharding, op6_packing, op7_secrets, op8_licenses, op9_line_dedup, op10_jaccard_join, pipeline)}

# Words of the contamination rule: A-Z in lower case, then runs of ASCII letters, digits and other characters.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE: dict[str, str] = {
    "op3_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        items AS (SELECT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS g
                  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM items),
        places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
        found AS (SELECT p.doc_id, p.i, p.n, t.item_id FROM places p JOIN items t ON t.n = p.n AND list_slice(p.w, p.i, p.i + p.n - 1) = t.g),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
        names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k, count(*) OVER (PARTITION BY doc_id) AS n,
                          len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
                   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM documents)
                   WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        x AS (SELECT *, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3, lead(w, 1) OVER o AS w2 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
        win AS (SELECT doc_id, k, 3 AS m, true AS three, [line, l2, l3] AS key FROM x WHERE k + 2 <= n
                UNION ALL SELECT doc_id, k, n, true, [line, CASE WHEN n = 2 THEN l2 END, NULL] FROM x WHERE k = 1 AND n < 3
                UNION ALL SELECT doc_id, k, 1, false, [line, NULL, NULL] FROM x WHERE w > 50 AND n > 1
                UNION ALL SELECT doc_id, k, 2, false, [line, l2, NULL] FROM x WHERE k + 1 <= n AND w + w2 > 50 AND n > 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, k) AS r FROM win),
        gone AS (SELECT doc_id, k, bool_or(three) AS three FROM (SELECT doc_id, unnest(range(k, k + m)) AS k, three FROM ranked WHERE r > 1) GROUP BY 1, 2),
        per AS (SELECT doc_id, count(*) AS n_lines, count(g.k) AS n_removed, count(*) FILTER (three) AS n_three FROM l LEFT JOIN gone g USING (doc_id, k) GROUP BY doc_id),
        every AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM documents),
        stay AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.p) AS kept FROM every e
                 WHERE NOT EXISTS (SELECT 1 FROM l JOIN gone USING (doc_id, k) WHERE l.doc_id = e.doc_id AND l.p = e.p) GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_three, 0) AS BIGINT) AS n_removed_three,
               CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS text_sha256
        FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN stay USING (doc_id)""",
}
