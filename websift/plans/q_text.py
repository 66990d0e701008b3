"""Text-analysis queries over documents, benchmark texts and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stopwords as SW
from ..functions import text as TX
from ..operators import analysis as AN
from ..operators import index as IX
from . import sqlkit as S
from .context import ctx
from .registry import register

SUFFIX = "tion"
# Misspelled words checked by the spelling suggester.
SPELL_WORDS = ["thinng", "documment", "teh", "bble", "xqzv", "the", "xhing"]


def _doc_tokens_sql(extra: str = "") -> str:
    return f"SELECT doc_id, unnest({S.general_tokens('text')}) AS term{extra} FROM documents"


@register("term_freq", ops=("G3", "S11", "S12"), sql=f"""
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM ({_doc_tokens_sql()}) GROUP BY doc_id, term
""")
def term_freq(spark, sf_dir):
    d = ctx(spark, sf_dir).t("documents").select(F.col("doc_id").alias("id"), "text")
    return IX.postings(d, F.col("text")).select("doc_id", "term", F.col("tf").cast("long"))


_FIELDS_SQL = f"""
toks AS (
  SELECT 'text' AS field, doc_id, unnest({S.general_tokens('text')}) AS term FROM documents
  UNION ALL SELECT 'lang', doc_id, lower(lang) FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT 'source', doc_id, lower(source) FROM documents WHERE source IS NOT NULL),
df AS (SELECT field, term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM toks GROUP BY field, term)"""


@register("field_stats", ops=("G17", "S32"), sql=f"""
WITH {_FIELDS_SQL},
top AS (SELECT field, term, df, row_number() OVER (PARTITION BY field ORDER BY df DESC, term) AS rn FROM df)
SELECT f.field, CAST(f.docs AS BIGINT) AS docs, CAST(f.terms AS BIGINT) AS terms, CAST(f.tokens AS BIGINT) AS tokens,
       t.term AS top_term, CAST(t.df AS BIGINT) AS top_df
FROM (SELECT field, count(DISTINCT doc_id) AS docs, count(DISTINCT term) AS terms, count(*) AS tokens FROM toks GROUP BY field) f
JOIN top t ON t.field = f.field AND t.rn = 1
""")
def field_stats(spark, sf_dir):
    toks = AN.field_tokens(ctx(spark, sf_dir).t("documents"))
    return AN.field_stats(toks)


@register("term_df_histogram", ops=("G17",), sql=f"""
WITH {_FIELDS_SQL}
SELECT field, CAST(length(bin(df)) - 1 AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n_terms FROM df GROUP BY 1, 2
""")
def term_df_histogram(spark, sf_dir):
    toks = AN.field_tokens(ctx(spark, sf_dir).t("documents"))
    return AN.df_histogram(toks)


_SYN = TX.synonym_pairs()


@register("synonym_expand", ops=("J13", "Q9"), sql=f"""
WITH syn AS (SELECT * FROM {S.values_table(sorted(set(_SYN)), ['term', 'replacement'])}),
toks AS (SELECT item_id, generate_subscripts(t, 1) AS pos, unnest(t) AS term
         FROM (SELECT item_id, {S.general_tokens("text || ' gb tv pixima'")} AS t FROM benchmark))
SELECT CAST(k.item_id AS BIGINT) AS item_id, CAST(k.pos AS BIGINT) AS pos, k.term,
       coalesce(array_to_string(list_sort(list(DISTINCT s.replacement)), ' '), k.term) AS expanded
FROM toks k LEFT JOIN syn s ON s.term = k.term
GROUP BY k.item_id, k.pos, k.term
""")
def synonym_expand(spark, sf_dir):
    """Query-side synonyms on the benchmark texts (each given three synonym words)."""
    b = ctx(spark, sf_dir).t("benchmark")
    q = b.select("item_id", F.concat(F.col("text"), F.lit(" gb tv pixima")).alias("text"))
    syn = spark.createDataFrame(sorted(set(_SYN)), "term string, replacement string")
    return AN.expand_synonyms(q, "item_id", syn)


_STOP_ROWS = SW.table_rows()


@register("analyze_lang", ops=("S17", "S18", "S12", "F12"), sql=f"""
WITH stops AS (SELECT * FROM {S.values_table(_STOP_ROWS, ['lang', 'word'])}),
toks AS (SELECT doc_id, lang,
                unnest(list_transform({S.words('text')},
                       lambda t: CASE WHEN lang = 'fr' THEN regexp_replace(t, {S.lit("^(?:" + "|".join(TX.FRENCH_ELISIONS) + ")['’]")}, '') ELSE t END)) AS term
         FROM documents)
SELECT d.doc_id, d.lang, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept
FROM documents d LEFT JOIN (
  SELECT t.doc_id, count(*) AS n_tokens,
         count(*) FILTER (WHERE s.word IS NULL AND t.term <> '' AND regexp_matches(t.term, '^[\\p{{L}}\\p{{N}}]+$')) AS n_kept
  FROM toks t LEFT JOIN stops s ON s.lang = t.lang AND s.word = t.term GROUP BY t.doc_id) x USING (doc_id)
""")
def analyze_lang(spark, sf_dir):
    """Per-language chain: elision strip (fr), language stop list, alphanumeric filter."""
    d = ctx(spark, sf_dir).t("documents")
    stops = spark.createDataFrame(_STOP_ROWS, "lang string, word string")
    return AN.language_counts(d, stops)


@register("token_chains", ops=("S11", "S14", "S19", "S20", "S22", "S32", "F12"), sql=f"""
SELECT p_partkey,
  array_to_string(list_transform({S.drop_stop(S.words('p_name'), TX.ENGLISH_STOPWORDS)}, lambda t: regexp_replace(t, '[''’]s$', '')), ' ') AS english,
  array_to_string(regexp_extract_all(p_brand, {S.lit(TX.WORD_PART_PATTERN)}), ' ') AS parts,
  array_to_string(regexp_extract_all(p_brand, {S.lit(TX.WORD_PART_PATTERN)}), '') AS catenated,
  array_to_string(list_filter(string_split_regex(p_name, '\\s+'), lambda x: x <> ''), '|') AS ws_tokens,
  lower(p_type) AS whole_value,
  CASE WHEN length(p_type) >= 2 THEN array_to_string(list_transform(range(1, length(p_type)), lambda i: substring(p_type, i, 2)), ' ') ELSE p_type END AS bigrams,
  split_part(p_name, ' ', 1) AS payload_term,
  round(coalesce(TRY_CAST(CAST(p_size AS VARCHAR) || '.5' AS FLOAT), 1.0), 3) AS payload_weight
FROM part
""")
def token_chains(spark, sf_dir):
    p = ctx(spark, sf_dir).t("part")
    return AN.token_chains(p)


@register("suffix_search", ops=("F10",), sql=f"""
SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM ({_doc_tokens_sql()})
WHERE starts_with(reverse(term), reverse({S.lit(SUFFIX)})) GROUP BY term
""")
def suffix_search(spark, sf_dir):
    d = ctx(spark, sf_dir).t("documents").select(F.col("doc_id").alias("id"), "text")
    post = IX.postings(d, F.col("text"))
    return AN.suffix_terms(IX.vocab(post), SUFFIX).select("term", F.col("df").cast("long"))


@register("did_you_mean", ops=("S29", "F3"), sql=f"""
WITH {S.cte_links()}, {S.cte_docs()},
vocab AS (SELECT t AS term, count(DISTINCT id) AS df FROM doc_tok GROUP BY t),
w AS (SELECT unnest({"[" + ", ".join(S.lit(x) for x in SPELL_WORDS) + "]"}) AS word),
miss AS (SELECT word FROM w WHERE word NOT IN (SELECT term FROM vocab)),
cand AS (SELECT m.word, v.term, levenshtein(m.word, v.term) AS dist, v.df FROM miss m JOIN vocab v
         ON abs(length(v.term) - length(m.word)) <= 2
         WHERE levenshtein(m.word, v.term) <= 2),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, df DESC, term) AS rn FROM cand)
SELECT word, term AS suggestion, CAST(dist AS BIGINT) AS distance, CAST(df AS BIGINT) AS hits FROM best WHERE rn = 1
""")
def did_you_mean(spark, sf_dir):
    c = ctx(spark, sf_dir)
    words = spark.createDataFrame([(w,) for w in SPELL_WORDS], "word string")
    return AN.spelling(words, c.vocab, c.spelling_index)


@register("stop_filter", ops=("S12", "S14", "S11"), sql=f"""
SELECT doc_id,
       CAST(len({S.words('text')}) AS BIGINT) AS n_words,
       CAST(len({S.general_tokens('text')}) AS BIGINT) AS n_general,
       CAST(len({S.drop_stop(S.words('text'), TX.ENGLISH_STOPWORDS)}) AS BIGINT) AS n_english
FROM documents
""")
def stop_filter(spark, sf_dir):
    """Tokens per document before stop words, after the general list and after the English list."""
    d = ctx(spark, sf_dir).t("documents")
    t = F.col("text")
    return d.select("doc_id", F.size(TX.words(t)).cast("long").alias("n_words"),
                    F.size(TX.general_tokens(t)).cast("long").alias("n_general"),
                    F.size(TX.english_tokens(t)).cast("long").alias("n_english"))
