"""DuckDB SQL for the operators that SQL can express; each compares all rows with each other, without candidates."""

#: Words of a whole text, as the operators count them.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Smallest id that each row reaches over ``link`` (a, b), both directions listed.
REACH = """reach AS (
  SELECT id AS a, id AS b FROM node
  UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)"""

JACCARD = f"""
WITH RECURSIVE doc AS (SELECT doc_id AS id, {WORDS} AS w FROM documents),
node AS (SELECT id FROM doc),
shingle AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], chr(31)) AS s
  FROM (SELECT id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM doc)),
size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.id != y.id GROUP BY ALL),
link AS (SELECT c.a, c.b FROM common c JOIN size x ON x.id = c.a JOIN size y ON y.id = c.b WHERE 5 * c.n >= 4 * (x.n + y.n - c.n)),
{REACH},
low AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a),
copy AS (SELECT doc_id AS id, CASE WHEN len({WORDS}) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS copy_id FROM documents)
SELECT node.id AS doc_id, low.class_id, copy.copy_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links
FROM node JOIN low USING (id) JOIN copy USING (id) LEFT JOIN degree USING (id)
"""

EMBEDDINGS = f"""
WITH RECURSIVE vec AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
node AS (SELECT id FROM vec),
good AS (
  SELECT id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM vec
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
link AS (
  SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id != y.id AND len(x.v) = len(y.v)
  WHERE list_inner_product(x.v, y.v) / (x.norm * y.norm) >= 0.93),
{REACH},
low AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT node.id AS vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, low.component_id, node.id = low.component_id AS kept
FROM node JOIN low USING (id) LEFT JOIN degree USING (id)
"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
#: Base32 of a SHA-1: five hexadecimal digits are four letters.
_DIGEST = ("array_to_string(list_transform(range(0, 32), lambda k: " + _BASE32
           + "[CAST((CAST('0x' || sha[(k // 4) * 5 + 1:(k // 4) * 5 + 5] AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1]), '')")

WARC = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM page)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM best
"""


def quality_sql() -> str:
    """Base counts and verdicts; the histograms' references are the operator's own fixed values."""
    from . import quality as q

    def part(a: str, b: str) -> str:
        return f"(CASE WHEN {a} > 0 THEN {a} * log2({a} * 2 / ({a} + {b})) ELSE 0.0 END)"

    def distance(p: list[str], ref: list[str]) -> str:
        return "sqrt(greatest((" + " + ".join(part(a, b) + " + " + part(b, a) for a, b in zip(p, ref)) + ") / 2, 0.0))"

    def by_lang(values: dict, default) -> str:
        return "(CASE lower(lang) " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in values.items()) + f" ELSE {float(default)!r} END)"

    def left(pattern: str, text: str = "rest") -> str:
        return f"length(regexp_replace({text}, '{pattern}', '', 'g'))"

    quote = lambda x: x.replace("'", "''")
    counts = [left(r"[^\p{Ll}]+", "t"), left(quote(q.UPPER)), left(quote(q.DIGIT)), f"length(t) - {left('[ \\t\\n\\x0B\\f\\r]', 't')}", left(quote(q.PUNCT))]
    shares = [f"({c}) / greatest(length(t), 1)::DOUBLE" for c in counts]
    refs = [by_lang({k: v[i] for k, v in q.CLASS_REFERENCE.items()}, q.GENERIC_CLASSES[i]) for i in range(len(q.CLASSES))]
    n = len(next(iter(q.COMMON_REFERENCE.values())))
    word = ["(CASE lower(lang) " + " ".join(f"WHEN '{k}' THEN '{list(v)[i]}'" for k, v in q.COMMON_REFERENCE.items()) + " END)" for i in range(n)]
    hits = [f"len(list_filter(w, lambda x: x = {x})) / greatest(len(w), 1)::DOUBLE" for x in word]
    common = [by_lang({k: list(v.values())[i] for k, v in q.COMMON_REFERENCE.items()}, 0) for i in range(n)]
    common.append(by_lang({k: 1 - sum(v.values()) for k, v in q.COMMON_REFERENCE.items()}, 1))
    p, h = [f"s{i}" for i in range(len(shares))], [f"h{i}" for i in range(n)]
    p_all, h_all = [*p, f"greatest(1.0 - ({' + '.join(p)}), 0.0)"], [*h, f"greatest(1.0 - ({' + '.join(h)}), 0.0)"]
    known = "coalesce(lower(lang) IN (" + ", ".join(f"'{k}'" for k in q.COMMON_REFERENCE) + "), false)"
    return rf"""
WITH doc AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\p{{Ll}} ]+', '', 'g') AS rest, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(31)) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM doc WHERE len(w) > 8)),
twice AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, s)) GROUP BY doc_id),
share AS (SELECT *, {", ".join(f"{x} AS s{i}" for i, x in enumerate(shares))}, {", ".join(f"{x} AS h{i}" for i, x in enumerate(hits))} FROM doc),
base AS (
  SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - {left('[#*$%&|<>]', 't')} AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         {distance(p_all, refs)} AS class_distance, {distance(h_all, common)} AS common_distance
  FROM share d LEFT JOIN cover c USING (doc_id)),
failed AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (length(t) >= {q.MIN_CHARS_FOR_CLASSES} AND class_distance > {q.MAX_CLASS_DISTANCE})
         AND NOT (n_words >= {q.MIN_WORDS_FOR_COMMON} AND {known} AND common_distance > {q.MAX_COMMON_DISTANCE}) AS kept
FROM failed
"""

#: A control string with any backslashes after its first character, and the same with one more.
_HELD = r"(\[\\*/?INST\]|<\\*/s>|<\\*\|endoftext\|>)"

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(role, '{_HELD}')) + len(regexp_extract_all(text, '{_HELD}'))
            + length('[INST][/INST]</s>') AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

#: Unsigned crc32 of an ASCII string, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::UBIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda z: 0::UBIGINT)),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT)"""

TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
name AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, CAST({_CRC.format('s')} % 6 AS BIGINT) AS h FROM name),
r AS (
  SELECT c.conv_id, 0 AS seg, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
seq AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY seg, pos) FILTER (seg IS NOT NULL), []) AS s
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
step AS (SELECT conv_id, d AS depth, sha256(CAST(to_json(s[1:d]) AS VARCHAR)) AS k, len(s) AS m,
                CASE WHEN d > 0 THEN length(s[d].text) ELSE 0 END AS chars
         FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS (
  SELECT min(conv_id) AS owner, depth, k, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (m = depth), '')) AS ends_sha256
  FROM step GROUP BY depth, k),
path AS (SELECT conv_id, depth, owner FROM step JOIN node USING (depth, k)),
tree AS (SELECT n.*, p.owner AS up FROM node n LEFT JOIN path p ON p.conv_id = n.owner AND p.depth = n.depth - 1),
child AS (SELECT up AS owner, depth - 1 AS depth, count(*) AS n FROM tree WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT tree.*, coalesce(child.n, 0) AS n_children FROM tree LEFT JOIN child USING (owner, depth)),
under AS (
  SELECT p.owner, p.depth, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens
  FROM full_node f JOIN path p ON p.conv_id = f.owner AND p.depth <= f.depth GROUP BY ALL)
SELECT f.owner AS conv_id, CAST(f.depth AS BIGINT) AS depth, f.up AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, f.ends_sha256
FROM full_node f JOIN under u ON u.owner = f.owner AND u.depth = f.depth
"""

COLLOCATIONS = r"""
WITH piece AS (
  SELECT row_number() OVER () AS id, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
word AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece)),
gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3
  FROM word, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, p, CAST(count(*) AS HUGEINT) AS c, min(w1) AS w1, min(CASE WHEN k > 1 THEN w2 END) AS w2, min(CASE WHEN k > 2 THEN w3 END) AS w3
      FROM gram GROUP BY lang, k, p),
n AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND c >= 10),
cuts AS (
  SELECT c.lang, c.k, c.p, c.c AS a, x AS cut,
         CASE x WHEN 1 THEN c.w1 ELSE concat_ws(' ', c.w1, c.w2) END AS lp,
         CASE WHEN c.k = 2 THEN c.w2 WHEN x = 1 THEN concat_ws(' ', c.w2, c.w3) ELSE c.w3 END AS rp
  FROM cand c, (SELECT unnest([1, 2]) AS x) WHERE x < c.k),
scored AS (
  SELECT cuts.*, l.c AS l, r.c AS r, 1000000 * a * a // (l.c * r.c) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.k = cut AND l.p = lp JOIN f r ON r.lang = cuts.lang AND r.k = cuts.k - cut AND r.p = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
gone AS (
  SELECT DISTINCT s.lang, s.p FROM cand s JOIN (
    SELECT lang, c, concat_ws(' ', w1, w2) AS p FROM cand WHERE k = 3 UNION ALL SELECT lang, c, concat_ws(' ', w2, w3) FROM cand WHERE k = 3) t
  ON s.lang = t.lang AND s.p = t.p AND s.k = 2 WHERE 100 * t.c >= 50 * s.c)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best JOIN n USING (lang) ANTI JOIN gone USING (lang, p)
QUALIFY rank <= 2000
"""
