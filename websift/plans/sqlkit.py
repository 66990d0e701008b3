"""DuckDB SQL text for the oracle side of every registered query.

These helpers write the same rules as the column functions, in DuckDB's SQL
dialect, so each oracle statement is self-contained text over the
pre-registered table views.
"""

from __future__ import annotations

from ..functions import html as H
from ..functions import text as TX
from ..functions import urls as U
from ..sources import derived as D


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def decode(x: str) -> str:
    """Character references decoded once each: the text is cut at ampersands, each part's leading reference replaced."""
    ref = f"regexp_extract(p, {lit(H.ENTITY_PATTERN)}, 1)"
    names = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in H.ENTITIES.items()) + "}"
    code = (f"CASE WHEN lower({ref}[1:2]) = '#x' THEN CAST('0x' || {ref}[3:] AS BIGINT) "
            f"WHEN {ref}[1:1] = '#' THEN CAST({ref}[2:] AS BIGINT) END")
    char = (f"CASE WHEN {ref}[1:1] = '#' THEN (CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND {H.MAX_CODE_POINT} "
            f"THEN chr(CAST({code} AS INTEGER)) END) ELSE element_at({names}, {ref})[1] END")
    part = f"CASE WHEN {char} IS NOT NULL THEN {char} || p[length({ref}) + 2:] ELSE '&' || p END"
    return (f"CASE WHEN contains({x}, '&') THEN string_split({x}, '&')[1] || "
            f"array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: {part}), '') ELSE {x} END")


def title(html: str) -> str:
    return (f"CASE WHEN regexp_matches({html}, {lit('(?is)<title[^>]*>.*?</title>')}) "
            f"THEN {strip_ws(f'regexp_extract({html}, {lit(H.TITLE_PATTERN)}, 1)')} END")


def has_body(html: str) -> str:
    return f"regexp_matches({html}, {lit('(?i)<body[^>]*>')})"


def text_nodes(fragment: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({fragment}, {lit(H.TAG_SPLIT)}), "
            f"lambda x: {strip_ws(decode('x'))}), lambda x: x <> '')")


def body_text(html: str) -> str:
    body = f"regexp_extract({html}, {lit(H.BODY_PATTERN)}, 1)"
    return f"CASE WHEN {has_body(html)} THEN array_to_string({text_nodes(body)}, ', ') ELSE '' END"


def meta_values(html: str) -> str:
    return ("flatten(list_transform(regexp_extract_all(" + html + ", " + lit(H.META_TAG_PATTERN) + "), "
            "lambda m: list_transform(regexp_extract_all(m, " + lit(H.ATTR_VALUE_PATTERN) + "), "
            "lambda a: " + decode("regexp_replace(a, " + lit(H.ATTR_QUOTE_PATTERN) + ", '', 'g')") + ")))")


def hrefs(html: str) -> str:
    bare = "regexp_replace(h, " + lit(r"""^["']|["']$""") + ", '', 'g')"
    return f"list_transform(regexp_extract_all({html}, {lit(H.HREF_PATTERN)}, 1), lambda h: {decode(strip_ws(bare))})"


def display_title(title_x: str, text_x: str) -> str:
    return (f"CASE WHEN coalesce({title_x}, '') = '' THEN "
            f"(CASE WHEN length({text_x}) > 25 THEN substr({text_x}, 1, 24) || '...' ELSE {text_x} END) "
            f"ELSE {title_x} END")


def host(url: str) -> str:
    return f"nullif(lower(regexp_extract({url}, {lit(U.HOST_PATTERN)}, 1)), '')"


def root_of_host(h: str) -> str:
    """Registrable domain for the hosts of the test data (the example.* suffixes)."""
    return f"nullif(regexp_extract({h}, '([^./]+\\.example\\.(?:com|net|org))$', 1), '')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(TX.WORD_PATTERN)})"


def drop_stop(tokens: str, stops: list[str]) -> str:
    arr = "[" + ", ".join(lit(w) for w in stops) + "]"
    return f"list_filter({tokens}, lambda t: NOT list_contains({arr}, t))"


def general_tokens(x: str) -> str:
    return drop_stop(words(x), TX.GENERAL_STOPWORDS)


def link_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(TX.LINK_PART_PATTERN)})"


def values_table(rows: list[tuple], cols: list[str]) -> str:
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return lit(x)
        return repr(x)
    body = ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


# ---- shared CTEs -------------------------------------------------------

def cte_site() -> str:
    return (f"site AS (SELECT page_id, url, {host('url')} AS host, "
            f"{root_of_host(host('url'))} AS root FROM pages)")


def cte_parsed() -> str:
    return (f"parsed AS (SELECT page_id, url, {title('html')} AS title, {body_text('html')} AS text, "
            f"{meta_values('html')} AS meta, {hrefs('html')} AS hrefs FROM pages)")


def cte_outlinks() -> str:
    noise = "[" + ", ".join(lit(h) for h in D.NOISE_HREFS) + "]"
    fan = "[" + ", ".join(str(k) for k in D.EDGE_FANOUT) + "]"
    return f"""n_pages AS (SELECT count(*) AS n FROM pages),
fan AS (SELECT p.page_id, k, (p.page_id * 7 + k * 13) % n.n AS t_id
        FROM pages p, n_pages n, unnest({fan}) AS u(k)),
outlinks AS (
  SELECT f.page_id, CASE WHEN f.k = 1 THEN s.url ELSE 'https://' || s.root || '/' END AS href
  FROM fan f JOIN site s ON s.page_id = f.t_id
  WHERE (CASE WHEN f.k = 1 THEN s.url ELSE 'https://' || s.root || '/' END) IS NOT NULL
  UNION ALL
  SELECT page_id, unnest({noise}) AS href FROM pages WHERE page_id % 50 = 0)"""


def cte_links() -> str:
    """site, parsed, outlinks, all_links, ext_links, edges."""
    return f"""{cte_site()},
{cte_parsed()},
{cte_outlinks()},
all_links AS (SELECT page_id, unnest(hrefs) AS href FROM parsed UNION ALL SELECT page_id, href FROM outlinks),
ext_links AS (
  SELECT l.page_id, l.href, {root_of_host(host('l.href'))} AS domain
  FROM all_links l JOIN site s ON s.page_id = l.page_id
  WHERE {root_of_host(host('l.href'))} IS NOT NULL
    AND (s.root IS NULL OR {root_of_host(host('l.href'))} <> s.root)),
edges AS (SELECT DISTINCT page_id, domain FROM ext_links)"""


def cte_votes() -> str:
    return """votes AS (
  SELECT event_id, ts, user_id * 2 AS website_id,
         CASE WHEN event_type = 'click' THEN 'up' ELSE 'down' END AS reaction
  FROM events WHERE event_type IN ('click', 'error'))"""


def cte_docs(rank_sql: str = "0.0") -> str:
    """Search documents (needs cte_links): website + metadata[] + external_links[] + tokens."""
    return f"""docs AS (
  SELECT p.page_id AS id, p.title, p.text, p.url, s.root AS base_url, CAST({rank_sql} AS DOUBLE) AS rank,
         'default' AS type_of_website, p.meta AS metadata,
         (SELECT list(e.domain ORDER BY e.domain) FROM edges e WHERE e.page_id = p.page_id) AS external_links
  FROM parsed p JOIN site s USING (page_id)),
doc_tok AS (
  SELECT id, unnest({general_tokens("concat_ws(' ', title, array_to_string(coalesce(metadata, []), ' '), text, url, base_url, array_to_string(coalesce(external_links, []), ' '), CAST(rank AS VARCHAR), type_of_website)")}) AS t
  FROM docs)"""


ANY_TERM = "SELECT DISTINCT q.query_id, t.id FROM qterm q JOIN doc_tok t ON starts_with(t.t, q.w)"


def cte_synonyms(lines: list[str]) -> str:
    """syn (source, m, alternatives) and slot (id, chain, pos, n, alternatives) of the word lists ``seq`` (id, chain, s):
    each list is walked from its first word, over the longest left side found at each place."""
    pairs = []
    for line in lines:
        left, arrow, right = line.partition("=>")
        pairs += [(a.strip(), b.strip()) for a in left.split(",") for b in (right if arrow else left).split(",")]
    joined = lambda x: f"array_to_string({words(x)}, ' ')"
    return f"""syn AS (
  SELECT {joined('l')} AS source, len({words('any_value(l)')}) AS m, list(DISTINCT {joined('r')} ORDER BY {joined('r')}) AS alternatives
  FROM {values_table(pairs, ['l', 'r'])} GROUP BY {joined('l')}),
best AS (
  SELECT id, chain, pos, max(m) AS m, arg_max(alternatives, m) AS alternatives
  FROM (SELECT id, chain, s, unnest(range(1, len(s) + 1)) AS pos FROM seq) q JOIN syn ON array_to_string(s[pos:pos + m - 1], ' ') = source
  GROUP BY ALL),
walk AS (
  SELECT id, chain, CAST(1 AS BIGINT) AS pos FROM seq WHERE len(s) > 0
  UNION ALL
  SELECT w.id, w.chain, w.pos + coalesce(b.m, 1) FROM walk w LEFT JOIN best b USING (id, chain, pos) JOIN seq q USING (id, chain)
  WHERE w.pos + coalesce(b.m, 1) <= len(q.s)),
slot AS (
  SELECT w.id, w.chain, w.pos - 1 AS pos, coalesce(b.m, 1) AS n, coalesce(b.alternatives, [q.s[w.pos]]) AS alternatives
  FROM walk w LEFT JOIN best b USING (id, chain, pos) JOIN seq q USING (id, chain))"""


def cte_search(queries_rows, rank_sql: str = "0.0", hits_sql: str = ANY_TERM) -> str:
    """Brute-force search: every query term against every token of every document.

    ``hits_sql``: the hits (query_id, id), by default of any query term."""
    qv = values_table(queries_rows, ["query_id", "q"])
    return f"""{cte_links()},
{cte_docs(rank_sql)},
qs AS (SELECT * FROM {qv}),
qa AS (SELECT query_id,
         list_distinct(list_filter({general_tokens("coalesce(q, '')")}, lambda t: length(t) BETWEEN 2 AND 15)) AS terms,
         list_transform(regexp_extract_all(coalesce(q, ''), '[a-zA-Z0-9]+'), lambda w: lower(w)) AS sw
       FROM qs),
qterm AS (SELECT query_id, unnest(terms) AS w FROM qa),
hits AS ({hits_sql}),
sw AS (SELECT query_id, generate_subscripts(sw, 1) AS idx, unnest(sw) AS w FROM qa),
tfall AS (SELECT s.query_id, s.idx, t.id, count(*) AS tf FROM sw s JOIN doc_tok t ON starts_with(t.t, s.w)
          WHERE length(s.w) BETWEEN 2 AND 15 GROUP BY ALL),
keyed AS (
  SELECT h.query_id, h.id, s.idx,
         coalesce(f.tf, 0) AS tf_all,
         CASE WHEN length(s.w) >= 2 THEN len(list_filter({link_tokens('d.url')}, lambda t: starts_with(t, s.w))) ELSE 0 END AS tf_url
  FROM hits h JOIN docs d ON d.id = h.id
  LEFT JOIN sw s ON s.query_id = h.query_id
  LEFT JOIN tfall f ON f.query_id = h.query_id AND f.idx = s.idx AND f.id = h.id),
per_doc AS (
  SELECT k.query_id, k.id,
         coalesce(list(CAST(k.tf_url AS BIGINT) ORDER BY k.idx) FILTER (WHERE k.idx IS NOT NULL), []) AS tf_url,
         coalesce(list(CAST(k.tf_all AS BIGINT) ORDER BY k.idx) FILTER (WHERE k.idx IS NOT NULL), []) AS tf_all
  FROM keyed k GROUP BY k.query_id, k.id),
ranked AS (
  SELECT p.*, d.url, d.title, d.text, d.rank,
         row_number() OVER (PARTITION BY p.query_id ORDER BY p.tf_url DESC, d.rank DESC, p.tf_all DESC, p.id ASC) AS pos,
         count(*) OVER (PARTITION BY p.query_id) AS num_found
  FROM per_doc p JOIN docs d ON d.id = p.id)"""
