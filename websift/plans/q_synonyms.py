"""Synonym queries: token graphs in both orders of stop words and synonyms, and search over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import search as SR
from ..operators import synonyms as SY
from ..sources import derived as D
from . import sqlkit as S
from .context import ctx
from .q_search import _RESULT_SQL, _result_cols
from .registry import register

RULES = TX.SYNONYM_RULES + D.QUERY_SYNONYMS
_ENGLISH = "[" + ", ".join(S.lit(w) for w in TX.ENGLISH_STOPWORDS) + "]"


@register("synonym_graph", ops=("J13", "Q9", "S12"), sql=f"""
WITH RECURSIVE seq AS (
  SELECT item_id AS id, 'general' AS chain, {S.general_tokens('text')} AS s FROM benchmark
  UNION ALL SELECT item_id, 'english', {S.words('text')} FROM benchmark),
{S.cte_synonyms(RULES)},
stopped AS (
  SELECT id, chain, pos, n, CASE chain WHEN 'general' THEN alternatives ELSE list_sort(list_distinct(list_filter(list_transform(alternatives,
      lambda a: array_to_string(list_filter(string_split(a, ' '), lambda x: NOT list_contains({_ENGLISH}, x)), ' ')), lambda a: a <> ''))) END AS alts
  FROM slot)
SELECT CAST(id AS BIGINT) AS item_id, chain, CAST(pos AS BIGINT) AS slot, CAST(n AS BIGINT) AS n, array_to_string(alts, '|') AS alternatives
FROM stopped WHERE len(alts) > 0
""")
def synonym_graph(spark, sf_dir):
    """Token graph of every benchmark text: synonyms after the stop filter (general text) and before it (English)."""
    b = ctx(spark, sf_dir).t("benchmark").select("item_id", "text")
    rules = SY.rule_table(spark, RULES)
    general = SY.token_graph(b, rules, "item_id", TX.GENERAL_STOPWORDS, stops_first=True).withColumn("chain", F.lit("general"))
    english = SY.token_graph(b, rules, "item_id", TX.ENGLISH_STOPWORDS, stops_first=False).withColumn("chain", F.lit("english"))
    return general.unionByName(english).select(F.col("item_id").cast("long"), "chain", F.col("at").cast("long").alias("slot"), F.col("n").cast("long"),
                                               F.array_join("alternatives", "|").alias("alternatives"))


_SYNONYM_HITS = """
  SELECT DISTINCT a.query_id, t.id FROM alt a JOIN doc_tok t ON length(a.phrase) BETWEEN 2 AND 15 AND starts_with(t.t, a.phrase)
  WHERE NOT contains(a.phrase, ' ')
  UNION SELECT query_id, id FROM phrase_hit"""
_SEARCH = S.cte_search(D.QUERY_BATCH, hits_sql=_SYNONYM_HITS)
_BEFORE_HITS, _FROM_HITS = _SEARCH.split("hits AS (", 1)


@register("search_synonyms", ops=("J13", "Q9", "F3", "F17", "O3", "G6"), sql=f"""
WITH RECURSIVE {_BEFORE_HITS}
seq AS (SELECT query_id AS id, 'general' AS chain, {S.general_tokens("coalesce(q, '')")} AS s FROM qs),
{S.cte_synonyms(RULES)},
alt AS (SELECT DISTINCT id AS query_id, unnest(alternatives) AS phrase FROM slot),
val AS (
  SELECT id, {S.words('v')} AS d FROM (
    SELECT id, unnest(list_concat([title, text, url, base_url, CAST(rank AS VARCHAR), type_of_website],
                                  coalesce(metadata, []), coalesce(external_links, []))) AS v FROM docs) WHERE v IS NOT NULL),
ph AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS p FROM alt WHERE contains(phrase, ' ')),
place AS (SELECT id, d, generate_subscripts(d, 1) AS pos, unnest(d) AS t FROM val),
phrase_doc AS (
  SELECT DISTINCT ph.phrase, v.id FROM ph JOIN place v ON starts_with(v.t, ph.p[1])
  WHERE len(list_filter(range(1, len(p) + 1), lambda k: length(p[k]) BETWEEN 2 AND 15 AND coalesce(starts_with(d[pos + k - 1], p[k]), false)
                        AND d[pos + k - 1] <> 'and')) = len(p)),
phrase_hit AS (SELECT a.query_id, h.id FROM alt a JOIN phrase_doc h USING (phrase)),
hits AS ({_FROM_HITS}
{_RESULT_SQL} WHERE pos <= 10
""")
def search_synonyms(spark, sf_dir):
    """Top 10 per query, hits by the token graph: any word of it, or any multi-word alternative as a phrase."""
    c = ctx(spark, sf_dir)
    q = c.queries.select("query_id", F.col("q").alias("text"))
    graph = SY.token_graph(q, SY.rule_table(spark, RULES), "query_id", TX.GENERAL_STOPWORDS, stops_first=True)
    found = SY.graph_hits(graph, c.grams, c.vocab, c.postings, c.all_positions)
    return _result_cols(SR.ranked(SR.analyse_queries(c.queries), c.search_docs, c.grams, c.postings, rows=10, found=found))
