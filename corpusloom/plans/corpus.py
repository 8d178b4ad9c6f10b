"""The driver's tables as the engine's inputs: documents stand for pages of sites, with URLs that meet every path rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import js, text
from corpusloom.operators import classify
from corpusloom.plans.shared import stored

PATHS = "docs guides api pricing changelog support about blog getting-started misc".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, ord, url, title, description, first_paragraph, headings, main_content, word_count, depth, inbound, is_home, …"""
    d = table(spark, sf_dir, "documents")
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.col("doc_id") % 10 + 1).cast("int"))
    body = js.text("text")
    return d.select(
        F.col("source").alias("site_id"),
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), path, F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        js.cut(body, 80).alias("title"),
        F.substring(body, 81, 120).alias("description"),
        F.substring(body, 201, 300).alias("first_paragraph"),
        F.lit(None).cast("string").alias("site_name"),
        F.lit(None).cast("string").alias("canonical_url"),
        F.lit(None).cast("string").alias("declared_markdown_alternate"),
        F.lit(None).cast("string").alias("markdown_url"),
        F.array(F.substring(body, 1, 40)).alias("headings"),
        js.cut(body, text.MAIN_CHARS).alias("main_content"),
        js.word_count(body).cast("int").alias("word_count"),
        F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"),
        (F.col("doc_id") % 5).cast("int").alias("depth"),
        (F.col("doc_id") % 23).alias("inbound"),
        F.lit(False).alias("is_home"),
        body.alias("text"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with category, importance_score and content_hash."""
    p = pages(spark, sf_dir)
    cat = classify.category(F.col("url"), F.col("title"), F.col("headings"))["category"]
    p = p.withColumns({"category": cat, "content_hash": text.content_hash(F.lit(""), F.lit(""), F.col("main_content"))})
    return p.withColumn("importance_score", classify.importance(F.col("is_home"), F.col("category"), F.col("depth"), F.col("word_count"), F.col("inbound"), F.lit(False)))


def marked(spark: SparkSession, sf_dir: str, *without: str) -> DataFrame:
    """scored without its long texts (and other columns), written once: what joins, windows and filters read again and again are short rows,
    and no filter takes a copy of what reads whole texts down the plan."""
    return stored(scored(spark, sf_dir).drop("text", "main_content", "first_paragraph", *without), "marked")


#: The same in DuckDB's SQL: CTEs b (pages) and s (scored).
SQL = r"""
b AS (SELECT source AS site_id, doc_id AS ord, 'https://' || source || '.example.com/'
    || ['docs','guides','api','pricing','changelog','support','about','blog','getting-started','misc'][doc_id % 10 + 1] || '/' || doc_id AS url,
  ['docs','guides','api','pricing','changelog','support','about','blog','getting-started','misc'][doc_id % 10 + 1] AS k,
  left(t, 80) AS title, substring(t, 81, 120) AS description, substring(t, 201, 300) AS first_paragraph, left(t, 40) AS heading, left(t, 6000) AS main_content,
  len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS word_count, doc_id % 5 AS depth, doc_id % 23 AS inbound, t AS text
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
c AS (SELECT *, CASE WHEN k = 'docs' THEN 'Documentation' WHEN k = 'guides' THEN 'Guides' WHEN k = 'api' THEN 'API Reference' WHEN k = 'pricing' THEN 'Product'
    WHEN k = 'changelog' THEN 'Resources' WHEN k = 'support' THEN 'Support' WHEN k = 'about' THEN 'Company' WHEN k = 'blog' THEN 'Blog' WHEN k = 'getting-started' THEN 'Getting Started'
    ELSE (SELECT CASE WHEN regexp_matches(w, '(?i)\b(quickstart|getting started|installation|set ?up your)\b') THEN 'Getting Started'
      WHEN regexp_matches(w, '(?i)\b(api reference|endpoint|sdk reference|rest api|graphql)\b') THEN 'API Reference'
      WHEN regexp_matches(w, '(?i)\b(guide|tutorial|walkthrough|how to|step[- ]by[- ]step)\b') THEN 'Guides'
      WHEN regexp_matches(w, '(?i)\b(pricing|plans?|core features?)\b') THEN 'Product'
      WHEN regexp_matches(w, '(?i)\b(frequently asked|faq|support|help center)\b') THEN 'Support'
      WHEN regexp_matches(w, '(?i)\b(about us|our team|careers|we''re hiring)\b') THEN 'Company' ELSE 'Resources' END FROM (SELECT title || ' ' || heading AS w)) END AS category FROM b),
s AS (SELECT *, sha256(chr(10) || '---' || chr(10) || chr(10) || '---' || chr(10) || trim(regexp_replace(lower(main_content), '\s+', ' ', 'g'))) AS content_hash,
  CAST(greatest(0, floor(CASE category WHEN 'Getting Started' THEN 30 WHEN 'Documentation' THEN 28 WHEN 'API Reference' THEN 26 WHEN 'Guides' THEN 22 WHEN 'Product' THEN 18
    WHEN 'Resources' THEN 12 WHEN 'Support' THEN 12 WHEN 'Blog' THEN 10 WHEN 'Company' THEN 8 ELSE 5 END - depth * 4 + least(inbound, 20) * 1.5
    + CASE WHEN word_count < 60 THEN -25 WHEN word_count > 800 THEN 15 WHEN word_count > 300 THEN 10 ELSE 0 END + 0.5)) AS DOUBLE) AS importance_score FROM c)
"""

#: CTEs on top of s: o (curated pages with section, curated_out), l (links in order). Sections of pages that a person placed are in s.section_override.
SECTIONS_SQL = r"""
a AS (SELECT *, CASE WHEN importance_score < 20 THEN 'Optional' ELSE category END AS sec,
  list_position(['Getting Started','Documentation','Guides','API Reference','Product','Resources','Support','Company','Blog'], category) AS crank FROM m WHERE section_override IS NULL OR trim(section_override) = ''),
a2 AS (SELECT *, row_number() OVER (PARTITION BY site_id, sec ORDER BY importance_score DESC, ord) AS rn FROM a),
p1 AS (SELECT site_id, ord, row_number() OVER (PARTITION BY site_id ORDER BY crank, importance_score DESC, ord) AS gp FROM a2 WHERE sec <> 'Optional' AND rn <= 8),
kp AS (SELECT site_id, least(60, count(*)) AS kk FROM p1 GROUP BY site_id),
q1 AS (SELECT a2.site_id, ord, row_number() OVER (PARTITION BY a2.site_id ORDER BY importance_score DESC, CASE WHEN sec = 'Optional' THEN 0 ELSE crank END, ord) AS op, coalesce(kk, 0) AS kk
  FROM a2 LEFT JOIN kp USING (site_id) WHERE sec = 'Optional' OR rn > 8),
o AS (SELECT m.*, CASE WHEN trim(coalesce(m.section_override, '')) <> '' THEN trim(m.section_override) WHEN p1.gp <= 60 THEN m.category WHEN q1.op <= least(12, 60 - q1.kk) THEN 'Optional' END AS section,
  trim(coalesce(m.section_override, '')) <> '' AS is_manual,
  trim(coalesce(m.section_override, '')) = '' AND NOT coalesce(p1.gp <= 60, FALSE) AND NOT coalesce(q1.op <= least(12, 60 - q1.kk), FALSE) AS curated_out
  FROM m LEFT JOIN p1 ON m.site_id = p1.site_id AND m.ord = p1.ord LEFT JOIN q1 ON m.site_id = q1.site_id AND m.ord = q1.ord),
l AS (SELECT *, row_number() OVER (PARTITION BY site_id, section ORDER BY importance_score DESC, is_manual, ord) AS place,
  CASE WHEN section = 'Optional' THEN 1000 ELSE coalesce(list_position(['Getting Started','Documentation','Guides','API Reference','Product','Resources','Support','Company','Blog'], section), 100) END AS section_rank
  FROM o WHERE section IS NOT NULL)
"""
