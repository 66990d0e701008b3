"""Text analysis as column expressions (tokenise, stop, grams, query parsing).

Every chain is a composition of ``regexp_extract_all`` / ``filter`` /
``transform``, evaluated in the JVM.  The word tokeniser approximates a
Unicode word tokeniser: runs of letters, digits and underscore, joined over
an apostrophe or a dot between two such runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*"
LINK_PART_PATTERN = r"[A-Za-z0-9_-]+"
SORT_WORD_PATTERN = r"[a-zA-Z0-9]+"
# parts end where lower case is followed by upper case, and between letters and digits
WORD_PART_PATTERN = r"\p{Lu}*[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+|\p{Lu}+|\p{N}+"

# Stop words of the general text chain.
GENERAL_STOPWORDS = ["and"]
# Stop words of the English chain (with the two test words).
ENGLISH_STOPWORDS = [
    "stopworda", "stopwordb", "a", "an", "and", "are", "as", "at", "be", "but", "by",
    "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was",
    "will", "with",
]
# Query-time synonym rules (equivalence groups and one-way maps).
SYNONYM_RULES = [
    "aaafoo => aaabar",
    "bbbfoo => bbbfoo bbbbar",
    "cccfoo => cccbar cccbaz",
    "fooaaa,baraaa,bazaaa",
    "GB,gib,gigabyte,gigabytes",
    "MB,mib,megabyte,megabytes",
    "Television, Televisions, TV, TVs",
    "pixima => pixma",
]
# Words the stemmer must keep as they are.
PROTECTED_WORDS = ["dontstems", "zwhacky"]
# French elisions stripped before a word.
FRENCH_ELISIONS = ["l", "m", "t", "qu", "n", "s", "j", "d", "c", "jusqu", "quoiqu",
                   "lorsqu", "puisqu"]

# Characters escaped in a query string (backslash itself first).
QUERY_SPECIALS = r"""([\\+\-!():^\[\]"{}~*?|&;/])"""

TEXT_GRAM_MIN, TEXT_GRAM_MAX = 2, 15
LINK_GRAM_MIN, LINK_GRAM_MAX = 2, 2000


def words(text: Column) -> Column:
    """Lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def drop_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    stops = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(tokens, lambda t: ~F.array_contains(stops, t))


def general_tokens(text: Column) -> Column:
    """General chain (``text_all``): tokenise, stop 'and', lower case."""
    return drop_stopwords(words(text), GENERAL_STOPWORDS)


def english_tokens(text: Column) -> Column:
    """English chain without the stemmer: tokenise, stop list, possessive strip."""
    return F.transform(drop_stopwords(words(text), ENGLISH_STOPWORDS), strip_possessive)


def strip_possessive(tok: Column) -> Column:
    """S14."""
    return F.regexp_replace(tok, r"['’]s$", "")


def strip_elision(tok: Column, elisions: list[str] = FRENCH_ELISIONS) -> Column:
    """Drop a leading elided article (l', qu', ...)."""
    return F.regexp_replace(tok, "^(?:" + "|".join(elisions) + ")['’]", "")


def link_tokens(text: Column) -> Column:
    """Link chain: ``[A-Za-z0-9-_]+`` parts, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(LINK_PART_PATTERN), 0)


def escape_query(q: Column) -> Column:
    """Backslash before each special character of the query syntax."""
    return F.regexp_replace(q, QUERY_SPECIALS, r"\\$1")


def encode_component(x: Column) -> Column:
    """Percent-encoding of RFC 3986 (space as %20, unreserved ``-_.~`` kept)."""
    e = F.url_encode(x)
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")),
                     F.lit("*"), F.lit("%2A"))


def decode_component(x: Column) -> Column:
    """Percent-decoding; NULL for malformed input."""
    return F.try_url_decode(x)


def match_words(q: Column) -> Column:
    """S3: whitespace-separated query words."""
    return F.filter(F.split(q, r"\s+"), lambda x: x != "")


def sort_words(q: Column) -> Column:
    """Alphanumeric runs of the query, lower-cased (termfreq arguments)."""
    return F.transform(F.regexp_extract_all(q, F.lit(SORT_WORD_PATTERN), 0), F.lower)


def edge_grams(tok: Column, lo: int, hi: int) -> Column:
    """Prefixes of length lo..min(len, hi)."""
    return F.transform(F.sequence(F.lit(lo), F.greatest(F.lit(lo), F.least(F.length(tok), F.lit(hi)))),
                       lambda i: F.substring(tok, 1, i))


def suggest_tokens(text: Column) -> Column:
    """S16 (without the stemmer): non-alphanumerics to blanks, lower, length 2..255, stop."""
    toks = F.split(F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9]", " ")), r"\s+")
    toks = F.filter(toks, lambda t: F.length(t).between(2, 255))
    return drop_stopwords(toks, GENERAL_STOPWORDS)


def whitespace_tokens(text: Column) -> Column:
    """Tokens kept verbatim."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_delimiter_parts(tok: Column) -> Column:
    """Split on case change, letter/digit and punctuation boundaries."""
    return F.regexp_extract_all(tok, F.lit(WORD_PART_PATTERN), 0)


def cjk_bigrams(text: Column) -> Column:
    """Overlapping character bigrams of a run."""
    n = F.length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, 2))) \
        .otherwise(F.array(text))


def payload_token(tok: Column) -> Column:
    """``word|1.4`` → struct(term, weight)."""
    parts = F.split(tok, r"\|")
    return F.struct(parts.getItem(0).alias("term"),
                    F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("float"), F.lit(1.0).cast("float")).alias("weight"))


def synonym_pairs() -> list[tuple[str, str]]:
    """(term, replacement) pairs; equivalence groups expand to all members."""
    pairs: list[tuple[str, str]] = []
    for rule in SYNONYM_RULES:
        if "=>" in rule:
            left, right = rule.split("=>")
            for l in left.split(","):
                for r in right.split():
                    pairs.append((l.strip().lower(), r.strip().lower()))
        else:
            group = [w.strip().lower() for w in rule.split(",") if w.strip()]
            for a in group:
                for b in group:
                    pairs.append((a, b))
    return pairs
