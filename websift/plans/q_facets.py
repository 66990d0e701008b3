"""Facet and grouping queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as FC
from .context import ctx
from .registry import register

# Filter query applied before the field facet (F8): documents with some text.
MIN_CHARS = 50
# Named query facets (name, predicate).
QUERY_FACETS = [
    ("short", "n_chars < 1000"),
    ("medium", "n_chars >= 1000 AND n_chars < 10000"),
    ("long", "n_chars >= 10000"),
    ("english", "lang = 'en'"),
    ("empty", "n_chars < 0"),
]
RANGE_START, RANGE_END, RANGE_GAP = 0, 60000, 5000


def _docs(c):
    return c.t("documents").where(F.col("n_chars") >= MIN_CHARS)


@register("facet_field", ops=("G12", "F8", "F9"), sql=f"""
SELECT 'lang' AS field, lang AS value, CAST(count(*) AS BIGINT) AS count FROM documents WHERE n_chars >= {MIN_CHARS} GROUP BY lang
UNION ALL
SELECT 'source', source, CAST(count(*) AS BIGINT) FROM documents WHERE n_chars >= {MIN_CHARS} GROUP BY source
""")
def facet_field(spark, sf_dir):
    d = _docs(ctx(spark, sf_dir))
    return FC.field_facet(d, "lang").unionByName(FC.field_facet(d, "source"))


@register("facet_query", ops=("G13",), sql="\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{n}' AS name, CAST(count(*) FILTER (WHERE {p}) AS BIGINT) AS count "
    f"FROM documents) WHERE count > 0" for n, p in QUERY_FACETS))
def facet_query(spark, sf_dir):
    return FC.query_facet(ctx(spark, sf_dir).t("documents"), QUERY_FACETS)


@register("facet_range", ops=("G14", "F7"), sql=f"""
SELECT CASE WHEN n_chars < {RANGE_START} THEN 'before' WHEN n_chars >= {RANGE_END} THEN 'after'
            ELSE CAST({RANGE_START} + floor((n_chars - {RANGE_START}) / {RANGE_GAP}) * {RANGE_GAP} AS BIGINT)::VARCHAR END AS bucket,
       CAST(count(*) AS BIGINT) AS count
FROM documents GROUP BY 1
""")
def facet_range(spark, sf_dir):
    return FC.range_facet(ctx(spark, sf_dir).t("documents"), "n_chars", RANGE_START, RANGE_END, RANGE_GAP)


@register("facet_pivot", ops=("G15",), sql=f"""
SELECT lang, source, CAST(GROUPING(lang, source) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS count
FROM documents GROUP BY ROLLUP (lang, source)
""")
def facet_pivot(spark, sf_dir):
    return FC.pivot_facet(ctx(spark, sf_dir).t("documents"), "lang", "source")


@register("group_top_docs", ops=("W4", "G16", "O7"), sql=f"""
SELECT lang, CAST(group_count AS BIGINT) AS group_count, CAST(pos AS BIGINT) AS pos, doc_id, n_chars FROM (
  SELECT lang, doc_id, n_chars, count(*) OVER (PARTITION BY lang) AS group_count,
         row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id) AS pos
  FROM documents) WHERE pos <= 3
""")
def group_top_docs(spark, sf_dir):
    return FC.group_top(ctx(spark, sf_dir).t("documents"), "lang", F.col("n_chars").desc_nulls_last(), "doc_id", 3,
                        keep=("n_chars",))
