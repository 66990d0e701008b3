"""Quality rules: base counts and divergence of a document's histograms from language references.

Only DataFrame functions.  Everything is computed inside the row of a
document (arrays and higher-order functions), so a scan, one projection and
no shuffle do the whole job, whatever the skew of sources or copies.

Method: the shares of six character classes and of the most common function
words of the document's language form two histograms.  Each is compared with
the reference histogram of the language by the Jensen-Shannon distance (the
square root of the divergence in bits, 0 to 1).  A histogram counts only
above a minimum length, as short texts have noisy shares.

Defined results: null text counts as empty; an empty text has no words and
fails the base rules; a null or unknown ``lang`` is compared with the generic
character reference only; extra columns are kept by ``filter_quality`` and
ignored elsewhere, whatever their names; repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Guards: histograms of shorter texts aren't judged.
MIN_CHARS_FOR_CLASSES = 250
MIN_WORDS_FOR_COMMON = 80
#: Largest Jensen-Shannon distance that still counts as prose.  A text without any common word of its language is 0.304
#: (de), 0.329 (fr), 0.352 (en) or 0.380 (es) away, so a larger bound of the second would let all such texts pass.
MAX_CLASS_DISTANCE = 0.20
MAX_COMMON_DISTANCE = 0.30

#: Character classes, in this order: lower case, upper case, digit, white space, punctuation, anything else.
CLASSES = ("lower", "upper", "digit", "space", "punct", "other")
DIGIT, UPPER, PUNCT = r"[^\p{Nd}]+", r"[^\p{Lu}\p{Lt}]+", r"[^.,;:!?'\"()\[\]’“”«»¿¡\-–]+"

# Rounded shares of character classes in edited prose of each language.
CLASS_REFERENCE = {
    "en": (0.780, 0.025, 0.010, 0.160, 0.023, 0.002),
    "de": (0.775, 0.050, 0.010, 0.138, 0.025, 0.002),
    "fr": (0.775, 0.025, 0.010, 0.160, 0.028, 0.002),
    "es": (0.780, 0.022, 0.010, 0.162, 0.024, 0.002),
}
GENERIC_CLASSES = (0.778, 0.030, 0.010, 0.155, 0.025, 0.002)

# Ten very common function words of each language, of three letters at most, and their rounded share
# of all words in prose.
COMMON_REFERENCE = {
    "en": {"the": .060, "of": .032, "and": .028, "to": .026, "in": .021, "a": .021, "is": .012, "for": .010, "it": .009, "was": .008},
    "de": {"der": .034, "die": .033, "und": .028, "in": .018, "den": .012, "das": .011, "von": .010, "zu": .010, "ist": .009, "mit": .008},
    "fr": {"de": .045, "la": .027, "le": .022, "et": .020, "les": .018, "à": .016, "des": .016, "en": .013, "un": .011, "du": .011},
    "es": {"de": .058, "la": .036, "que": .028, "el": .028, "en": .026, "y": .025, "a": .019, "los": .017, "se": .012, "del": .012},
}

SPACES = " \t\n\u000b\u000c\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def word_array(text: Column) -> Column:
    """Maximal runs of characters outside ``[\\x20\\x09-\\x0D]``; null text has none.

    All other blanks become spaces first: splitting at one plain character needs no regular expression."""
    plain = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def _windows(h: Column, n: Column) -> Column:
    """Hashes of all windows of eight consecutive words."""
    return F.transform(F.slice(h, F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0))),
                       lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: union of [p, p + 8) over their starts p."""
    def starts(pairs: Column) -> Column:
        return F.filter(pairs, lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a one-element array and a lambda name the sorted pairs, so that they are sorted once
    positions = F.sort_array(F.transform(F.flatten(F.transform(F.array(pairs), starts)), lambda x: x["i"]))
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(positions, first, lambda acc, p: F.struct(
        p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")))["n"]
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(F.lit(0).cast("long"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays that sum to 1; bits, 0 to 1)."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2, F.lit(0.0)))


def _with_rest(shares: Column) -> Column:
    """The histogram with a last bin for all that the others leave."""
    rest = 1 - F.aggregate(shares, F.lit(0.0), lambda x, y: x + y)
    return F.concat(shares, F.array(F.greatest(rest, F.lit(0.0))))


def _reference(index: Column, rows: list) -> Column:
    """Row ``index`` of a fixed table of histograms."""
    return F.get(F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows]), index)


def measures(df: DataFrame, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: the columns ``carry``, the base counts, the two distances, base_failed and kept.

    Steps are projections of their own, so that the word array, the hashes and
    the windows are each computed once.
    """
    carry = carry or []
    langs = list(COMMON_REFERENCE)
    d = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
                  F.coalesce(F.col(text), F.lit("")).alias("_t"),
                  (F.array_position(F.array(*[F.lit(x) for x in langs]), F.lower(F.col(lang))) - 1).cast("int").alias("_l"))
    d = d.withColumn("_l", F.when(F.col("_l") >= 0, F.col("_l")))
    keep = [f"_c{i}" for i in range(len(carry))] + ["_l"]
    # most characters of prose are lower case or blanks: the other classes are counted in what is left without them
    d = d.select(*keep, word_array(F.col("_t")).alias("_w"), F.length("_t").alias("_len"),
                 F.length(F.replace("_t", F.lit(" "), F.lit(""))).alias("_len1"),
                 F.regexp_replace("_t", r"[\p{Ll} ]+", "").alias("_rest"),
                 F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    common = F.get(F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in COMMON_REFERENCE.values()]), F.col("_l"))
    longest = max(len(w) for ws in COMMON_REFERENCE.values() for w in ws)
    d = d.select(*keep, "_rest", "_len", "_len1", F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
                 F.filter("_w", lambda w: F.length(w) <= longest).alias("_short"), common.alias("_common"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup"))
    d = d.select(*keep, "_rest", "_len", "_len1", "_n", "_dup", _windows(F.col("_h"), F.col("_n")).alias("_win"),
                 F.filter(F.transform("_short", lambda w: F.array_position(F.col("_common"), w).cast("int")), lambda i: i > 0).alias("_hits"))
    blanks = F.length("_rest") - F.length(_without(F.col("_rest"), SPACES))
    d = d.select(*keep, "_hits", "_n", "_len", F.col("_n").cast("long").alias("n_words"),
                 (F.col("_len1") - blanks).cast("long").alias("word_chars"),
                 (F.length("_rest") - F.length(_without(F.col("_rest"), SYMBOLS))).cast("long").alias("n_symbols"),
                 F.col("_dup").cast("long").alias("n_dup_lines"), _covered(F.col("_win")).alias("n_repeat_words"),
                 F.array((F.col("_len1") - F.length("_rest")).cast("double"),
                         *[F.length(F.regexp_replace("_rest", p, "")).cast("double") for p in (UPPER, DIGIT)],
                         (F.col("_len") - F.col("_len1") + blanks).cast("double"),
                         F.length(F.regexp_replace("_rest", PUNCT, "")).cast("double")).alias("_classes"))
    n_common = len(next(iter(COMMON_REFERENCE.values())))
    shares = F.transform("_classes", lambda x: x / F.greatest(F.col("_len"), F.lit(1)))
    # a lambda names the hits: were their column read in the inner lambda, they would be computed for every word
    hits = F.flatten(F.transform(F.array("_hits"), lambda found: F.transform(
        F.sequence(F.lit(1), F.lit(n_common)),
        lambda i: F.size(F.filter(found, lambda x: x == i)) / F.greatest(F.col("_n"), F.lit(1)))))
    generic = F.coalesce(F.col("_l"), F.lit(len(langs)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = d.select(*keep, *counts,
                 F.when(F.col("_len") >= MIN_CHARS_FOR_CLASSES, _distance(_with_rest(shares), _reference(
                     generic, [*[CLASS_REFERENCE[x] for x in langs], GENERIC_CLASSES]))).alias("class_distance"),
                 F.when((F.col("_n") >= MIN_WORDS_FOR_COMMON) & F.col("_l").isNotNull(), _distance(
                     _with_rest(hits), _reference(F.col("_l"), [[*v.values(), 1 - sum(v.values())] for v in COMMON_REFERENCE.values()])
                 )).alias("common_distance"),
                 ((F.col("n_words") < MIN_WORDS)
                  | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"))
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) \
        | F.coalesce(F.col("common_distance") > MAX_COMMON_DISTANCE, F.lit(False))
    return d.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *counts, "base_failed",
                    (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "common_distance")


def filter_quality(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that pass, with the columns of ``df`` unchanged."""
    columns = df.columns
    names = [f"_in{i}" for i in range(len(columns))]
    d = df.toDF(*names)
    d = d.select(F.struct(*names).alias("_row"), F.col(names[columns.index(text)]).alias("_text"),
                 F.col(names[columns.index(lang)]).alias("_lang"))
    m = measures(d, "_text", "_lang", carry=["_row"])
    # a filter would be pushed below the projections, and each step's expressions copied into it; a generator is not
    return m.select(F.explode(F.array_repeat("_row", F.col("kept").cast("int"))).alias("_row")) \
        .select(*[F.col(f"_row.{n}").alias(c) for n, c in zip(names, columns)])
