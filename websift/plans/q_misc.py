"""Suggestions, snippets, genre rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import genre as G
from ..operators import search as SR
from ..operators import snippets as SN
from ..operators import suggest as SG
from ..sources import derived as D
from . import sqlkit as S
from .context import ctx
from .q_store import _FRESH_META
from .registry import register

# The suggestion batch (query_id, typed text).
SUGGEST_BATCH = [(1, "thin"), (2, "a"), (3, "random string word asdfsdfjkn 0"), (4, "the qu"),
                 (5, "ble"), (6, "c++ (the"), (7, "ONE Th"), (8, "zzzzzz")]


def _sql_suggest_tokens(x: str) -> str:
    toks = (f"list_filter(string_split_regex(lower(regexp_replace({x}, '[^a-zA-Z0-9]', ' ', 'g')), '\\s+'), "
            f"lambda t: length(t) BETWEEN 2 AND 255)")
    return S.drop_stop(toks, TX.GENERAL_STOPWORDS)


@register("suggest_terms", ops=("G8", "F11", "O2", "O4", "S16", "S27", "W5"), sql=f"""
WITH {S.cte_parsed()},
dic AS (SELECT term, count(*) AS weight FROM (SELECT unnest({_sql_suggest_tokens('text')}) AS term FROM parsed) GROUP BY term),
qs AS (SELECT * FROM {S.values_table(SUGGEST_BATCH, ['query_id', 'q'])}),
q AS (SELECT query_id, q, list_last(string_split_regex(trim(lower(regexp_replace(q, '[^a-zA-Z0-9]', ' ', 'g'))), ' +')) AS prefix FROM qs),
q2 AS (SELECT * FROM q WHERE length(prefix) BETWEEN 2 AND 255),
m AS (SELECT q2.query_id, d.term, row_number() OVER (PARTITION BY q2.query_id ORDER BY d.weight DESC, d.term) AS rn
      FROM q2 JOIN dic d ON starts_with(d.term, q2.prefix)),
lists AS (SELECT query_id, list(term ORDER BY rn) FILTER (WHERE rn <= 7) AS terms FROM m GROUP BY query_id),
shown AS (SELECT q2.query_id, q2.q, q2.prefix,
                 CASE WHEN list_contains(coalesce(l.terms, []), q2.prefix) THEN l.terms
                      ELSE list_slice(list_concat([q2.q], coalesce(l.terms, [])), 1, 7) END AS s
          FROM q2 LEFT JOIN lists l USING (query_id)),
flat AS (SELECT query_id, q, prefix, generate_subscripts(s, 1) AS pos, unnest(s) AS suggestion FROM shown)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(pos AS BIGINT) AS pos, suggestion,
       CASE WHEN suggestion = q AND pos = 1 AND NOT starts_with(suggestion, prefix) THEN ''
            ELSE substring(suggestion, length(prefix) + 1) END AS completion
FROM flat
""")
def suggest_terms(spark, sf_dir):
    c = ctx(spark, sf_dir)
    dic = SG.dictionary(c.parsed, "text")
    qs = spark.createDataFrame(SUGGEST_BATCH, "query_id long, q string")
    return SG.suggest(qs, dic)


def _sql_window(text: str, words: str) -> str:
    pos = "instr(lower(acc.t), lower(w))"
    start = f"greatest({pos} - 1 - {SN.BEFORE}, 0)"
    init = f"({SN.BEFORE} + {start} + greatest(length(w), {SN.MIN_SPAN}) + {SN.TAIL})"
    ext = f"length(regexp_extract(substring(acc.t, {init} + 1, {SN.MAX_EXTEND}), '^[A-Za-z0-9]*', 0))"
    return (f"list_reduce({words}, lambda acc, w: {{'t': substring(acc.t, {start} + 1, least(length(acc.t), {init} + {ext}) - {start}), "
            f"'b': acc.b OR {pos} - 1 - {SN.BEFORE} > 0, 'e': acc.e OR length(acc.t) > {init} + {ext}}}, "
            f"{{'t': coalesce({text}, ''), 'b': false, 'e': false}})")


def _sql_fragments(t: str, words: str) -> str:
    p = f"instr(lower({t}), lower(w))"
    frags = (f"list_filter(list_transform({words}, lambda w: CASE WHEN {p} > 0 THEN "
             f"substring({t}, greatest({p} - {SN.FRAG_SPAN}, 1), length(w) + {2 * SN.FRAG_SPAN}) END), lambda x: x IS NOT NULL)")
    return (f"(CASE WHEN len({frags}) > 0 THEN array_to_string({frags}, ' &hellip; ') "
            f"ELSE substring({t}, 1, {SN.FALLBACK_CHARS}) END)")


def _sql_highlight(x: str, words: str) -> str:
    return (f"CASE WHEN len({words}) > 0 THEN regexp_replace({x}, '(?i)(' || array_to_string({words}, '|') || ')', '<b>\\1</b>', 'g') "
            f"ELSE {x} END")


@register("snippets", ops=("S24", "S25", "S26", "S30", "P13"), sql=f"""
WITH {S.cte_search(D.QUERY_BATCH)},
win AS (SELECT r.query_id, r.pos, r.id, qa.sw, d.metadata, d.text, {_sql_window('d.text', 'qa.sw')} AS st
        FROM ranked r JOIN qa USING (query_id) JOIN docs d ON d.id = r.id WHERE r.pos <= 10),
descr AS (SELECT *, CASE WHEN list_position(coalesce(metadata, []), 'description') > 0 THEN metadata[list_position(metadata, 'description') + 1]
                         WHEN list_position(coalesce(metadata, []), 'og:description') > 0 THEN metadata[list_position(metadata, 'og:description') + 1] END AS descr
          FROM win)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(pos AS BIGINT) AS pos, id AS page_id,
       CASE WHEN descr IS NOT NULL THEN {_sql_highlight('descr', 'sw')}
            ELSE {_sql_highlight("(CASE WHEN st.b THEN '&hellip; ' ELSE '' END) || st.t || (CASE WHEN st.e THEN ' &hellip;' ELSE '' END)", 'sw')} END AS snippet,
       {_sql_highlight(_sql_fragments('coalesce(text, \'\')', 'sw'), 'sw')} AS fragments
FROM descr
""")
def snippets(spark, sf_dir):
    c = ctx(spark, sf_dir)
    aq = SR.analyse_queries(c.queries)
    r = SR.ranked(aq, c.search_docs, c.grams, c.postings, rows=10)
    r = r.join(aq.select("query_id", "sort_words"), "query_id") \
        .join(c.search_docs.select(F.col("id").alias("doc_id"), "metadata"), "doc_id")
    return r.select(F.col("query_id").cast("long"), F.col("pos").cast("long"), F.col("doc_id").alias("page_id"),
                    SN.result_text("text", "metadata", "sort_words").alias("snippet"),
                    SN.fragments(F.col("text"), F.col("sort_words")).alias("fragments"))


def _sql_rule_genre(text: str, meta: str) -> str:
    case = "CASE " + " ".join(f"WHEN contains(lower(m), {S.lit(k)}) THEN {S.lit(g)}" for k, g in G.META_RULES) + " END"
    b = f"lower(coalesce({text}, ''))"
    return (f"coalesce(list_filter(list_transform(coalesce({meta}, []), lambda m: {case}), lambda x: x IS NOT NULL)[1], "
            f"CASE WHEN ((contains({b}, 'install') OR contains({b}, 'get started')) AND contains({b}, 'version')) "
            f"OR (contains({b}, 'maintained') AND contains({b}, 'develop')) THEN 'product' "
            f"WHEN (contains({b}, 'author') AND contains({b}, 'article')) OR contains({b}, 'written by') "
            f"OR contains({b}, 'further reading') THEN 'article' ELSE 'default' END)")


@register("genre_rules", ops=("S9", "S10", "J18", "Q16"), sql=f"""
WITH {S.cte_site()}, {S.cte_parsed()}, {S.cte_votes()},
touched AS (SELECT DISTINCT v.website_id FROM votes v JOIN pages p ON p.page_id = v.website_id),
meta AS (SELECT p.page_id AS id,
                CASE WHEN p.page_id IN (SELECT website_id FROM touched)
                     THEN {"[" + ", ".join(S.lit(v) for v, _ in sorted(_FRESH_META, key=lambda x: x[1])) + "]"} ELSE p.meta END AS metadata,
                p.text FROM parsed p),
known AS (SELECT * FROM {S.values_table(G.KNOWN_DOMAINS, ['base_url', 'known_genre'])})
SELECT m.id, coalesce(k.known_genre, {_sql_rule_genre('m.text', 'm.metadata')}) AS genre,
       CASE WHEN k.known_genre IS NOT NULL THEN 'known_domain' ELSE 'rules' END AS genre_source
FROM meta m JOIN site s ON s.page_id = m.id LEFT JOIN known k ON k.base_url = s.root
""")
def genre_rules(spark, sf_dir):
    """Genre of every website after the voted sites got their new metadata."""
    from . import q_store
    c = ctx(spark, sf_dir)
    meta = q_store.replace_children(spark, sf_dir).withColumnRenamed("website_id", "id")
    arr = meta.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "metadata_text"))).alias("m")) \
        .select("id", F.transform("m", lambda x: x.metadata_text).alias("metadata"))
    sites = c.websites.select("id", "base_url", "text").join(arr, "id", "left")
    return G.classify(sites, G.known_domains(spark))
