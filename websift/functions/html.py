"""HTML → columns, as JVM-side regular-expression expressions.

One pass of column expressions per page instead of a Python parser: they run
in the JVM and scale with the scan (higher-order functions are interpreted
there, not part of generated code).  The
tokenisation rules (stated once here, mirrored by the SQL oracle):

* a *tag* is ``<[^>]*>``; a comment ``<!-- ... -->`` is a tag too, so it splits
  text nodes;
* a *text node* is the text between two tags, entity-decoded and trimmed;
* the title is the first ``<title>`` element's inner text, not decoded;
* the body is what follows the first ``<body ...>`` up to ``</body>`` or the end.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities: the HTML 4 names of the standard library, and ``apos``; a no-break space counts as a blank.
ENTITIES = {**{name: chr(cp) for name, cp in name2codepoint.items()}, "apos": "'", "nbsp": " "}
ENTITY_PATTERN = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
MAX_CODE_POINT = 0x10FFFF

TAG_SPLIT = r"(?s)<!--.*?-->|<[^>]*>"
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"
BODY_PATTERN = r"(?is)<body[^>]*>(.*?)(?:</body>|\z)"
META_TAG_PATTERN = r"(?i)<meta\b[^>]*>"
ATTR_VALUE_PATTERN = r"""\s[^\s=<>"'/]+\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
ATTR_QUOTE_PATTERN = r"""^\s[^\s=<>"'/]+\s*=\s*["']?|["']$"""
HREF_PATTERN = r"""(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
SCRIPT_BLOCK = r"(?is)<script\b[^>]*>(.*?)</script>"
COUNTED_TAGS = ("a", "li", "script", "iframe", "input")
HIDDEN_BLOCK = r"(?is)<(?:script|style|iframe)\b[^>]*>.*?</(?:script|style|iframe)\s*>"


def _decode_after_ampersand(part: Column) -> Column:
    """``part`` follows an ampersand: its leading entity decoded, or the ampersand put back."""
    ref = F.regexp_extract(part, ENTITY_PATTERN, 1)
    code = F.when(F.lower(F.substring(ref, 1, 2)) == "#x", F.conv(F.substring(ref, 3, 6), 16, 10).cast("long")) \
        .when(ref.startswith("#"), F.substring(ref, 2, 7).cast("long"))
    number = F.when(code.between(1, 0xD7FF) | code.between(0xE000, MAX_CODE_POINT),
                    F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv]), ref)
    char = F.when(ref.startswith("#"), number).otherwise(named)
    return F.when(char.isNotNull(), F.concat(char, F.substr(part, F.length(ref) + 2))).otherwise(F.concat(F.lit("&"), part))


def decode_entities(c: Column) -> Column:
    """Named and numeric character references, each decoded once (``&amp;lt;`` gives ``&lt;``); others stay."""
    parts = F.split(c, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), _decode_after_ampersand)
    return F.when(c.contains("&"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(c)


def strip_ws(c: Column) -> Column:
    """Trim every kind of white space (``trim`` only removes blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def title(html: Column) -> Column:
    """Inner HTML of the first <title>, trimmed; NULL when absent."""
    t = strip_ws(F.regexp_extract(html, TITLE_PATTERN, 1))
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), t)


def body(html: Column) -> Column:
    return F.regexp_extract(html, BODY_PATTERN, 1)


def has_body(html: Column) -> Column:
    return html.rlike(r"(?i)<body[^>]*>")


def text_nodes(fragment: Column) -> Column:
    """Decoded, trimmed, non-empty text nodes of an HTML fragment."""
    parts = F.transform(F.split(fragment, TAG_SPLIT), lambda x: strip_ws(decode_entities(x)))
    return F.filter(parts, lambda x: x != "")


def body_text(html: Column) -> Column:
    """Every text node under the body joined with ', '."""
    return F.array_join(text_nodes(body(html)), ", ")


def meta_values(html: Column) -> Column:
    """Attribute values of every <meta>, in document order (flattened)."""
    metas = F.regexp_extract_all(html, F.lit(META_TAG_PATTERN), 0)
    per_meta = F.transform(metas, lambda m: F.transform(
        F.regexp_extract_all(m, F.lit(ATTR_VALUE_PATTERN), 0),
        lambda a: decode_entities(F.regexp_replace(a, ATTR_QUOTE_PATTERN, ""))))
    return F.flatten(per_meta)


def hrefs(html: Column) -> Column:
    """All ``<a href>`` values in document order."""
    raw = F.regexp_extract_all(html, F.lit(HREF_PATTERN), 1)
    return F.transform(raw, lambda h: decode_entities(strip_ws(F.regexp_replace(h, r"""^["']|["']$""", ""))))


def _without_script_bodies(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)(<script\b[^>]*>).*?(</script>)", "$1$2")


def closed_tag_count(html: Column, tag: str) -> Column:
    """End tags that close an open one; unclosed tags never count.

    ``<tag/>`` opens and closes.  Contents of <script> are not markup.
    """
    tags = F.regexp_extract_all(_without_script_bodies(html),
                                F.lit(rf"(?i)</?{tag}\b[^>]*>"), 0)
    # event: 1 open, -1 close, 0 open+close
    ev = F.transform(tags, lambda t: F.when(t.startswith("</"), F.lit(-1))
                     .when(t.endswith("/>"), F.lit(0)).otherwise(F.lit(1)))
    init = F.struct(F.lit(0).alias("open"), F.lit(0).alias("n"))
    acc = F.aggregate(ev, init, lambda s, e: F.when(e == 1, F.struct((s.open + 1).alias("open"), s.n.alias("n")))
                      .when(e == 0, F.struct(s.open.alias("open"), (s.n + 1).alias("n")))
                      .when(s.open > 0, F.struct((s.open - 1).alias("open"), (s.n + 1).alias("n")))
                      .otherwise(s))
    return acc.n


def script_words(html: Column) -> Column:
    """Whitespace tokens inside <script> elements."""
    blocks = F.regexp_extract_all(html, F.lit(SCRIPT_BLOCK), 1)
    return F.aggregate(F.transform(blocks, lambda b: F.size(F.regexp_extract_all(b, F.lit(r"\S+"), 0))),
                       F.lit(0), lambda a, x: a + x)


def visible_text(html: Column) -> Column:
    """Text without script/style/iframe subtrees, white space collapsed, lower case."""
    cleaned = F.regexp_replace(html, HIDDEN_BLOCK, " ")
    nodes = text_nodes(cleaned)
    return F.lower(strip_ws(F.regexp_replace(F.array_join(nodes, " "), r"\s+", " ")))
