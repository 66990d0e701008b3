"""Result text for display (S23–S26, S30): description pick, snippet window, highlight.

All SQL expressions over small per-result arrays (the query words), so the
work stays in codegen next to the result rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, MIN_SPAN, TAIL, MAX_EXTEND = 50, 100, 200, 290

# Narrow the text word after word; state: text, cut at start, cut at end.
_WINDOW = f"""aggregate({{words}}, named_struct('t', {{text}}, 'b', false, 'e', false),
  (acc, w) -> named_struct(
    't', substring(acc.t,
        greatest(instr(lower(acc.t), lower(w)) - 1 - {BEFORE}, 0) + 1,
        least(length(acc.t),
              {BEFORE} + greatest(instr(lower(acc.t), lower(w)) - 1 - {BEFORE}, 0) + greatest(length(w), {MIN_SPAN}) + {TAIL}
              + length(regexp_extract(substring(acc.t,
                    {BEFORE} + greatest(instr(lower(acc.t), lower(w)) - 1 - {BEFORE}, 0) + greatest(length(w), {MIN_SPAN}) + {TAIL} + 1,
                    {MAX_EXTEND}), '^[A-Za-z0-9]*', 0)))
        - greatest(instr(lower(acc.t), lower(w)) - 1 - {BEFORE}, 0)),
    'b', acc.b OR instr(lower(acc.t), lower(w)) - 1 - {BEFORE} > 0,
    'e', acc.e OR length(acc.t) > {BEFORE} + greatest(instr(lower(acc.t), lower(w)) - 1 - {BEFORE}, 0)
              + greatest(length(w), {MIN_SPAN}) + {TAIL}
              + length(regexp_extract(substring(acc.t,
                    {BEFORE} + greatest(instr(lower(acc.t), lower(w)) - 1 - {BEFORE}, 0) + greatest(length(w), {MIN_SPAN}) + {TAIL} + 1,
                    {MAX_EXTEND}), '^[A-Za-z0-9]*', 0))))"""


def highlight(text: Column, words: Column) -> Column:
    """Every word, case-insensitively, in <b></b> (one pass); no words → unchanged."""
    pattern = F.concat(F.lit("(?i)("), F.array_join(words, "|"), F.lit(")"))
    return F.when(F.size(words) > 0, F.regexp_replace(text, pattern, F.lit("<b>$1</b>"))).otherwise(text)


def snippet(text: str, words: str) -> Column:
    """The window of the text around the query words, with '&hellip;' marks."""
    st = F.expr(_WINDOW.replace("{words}", words).replace("{text}", f"coalesce({text}, '')"))
    body = F.concat(F.when(st.b, F.lit("&hellip; ")).otherwise(F.lit("")), st.t,
                    F.when(st.e, F.lit(" &hellip;")).otherwise(F.lit("")))
    return body


FRAG_SPAN, FALLBACK_CHARS = 30, 100


def fragments(text: Column, words: Column) -> Column:
    """Highlighted fragments around each word's first hit joined by ' &hellip; ';
    the start of the stored value when no word occurs."""
    t = F.coalesce(text, F.lit(""))
    frags = F.filter(F.transform(words, lambda w: F.when(
        F.instr(F.lower(t), F.lower(w)) > 0,
        F.substring(t, F.greatest(F.instr(F.lower(t), F.lower(w)) - FRAG_SPAN, F.lit(1)),
                    F.length(w) + 2 * FRAG_SPAN))), lambda x: x.isNotNull())
    body = F.when(F.size(frags) > 0, F.array_join(frags, " &hellip; ")).otherwise(F.substring(t, 1, FALLBACK_CHARS))
    return highlight(body, words)


def description(metadata: Column) -> Column:
    """Value after 'description', else after 'og:description' (NULL if neither)."""
    d = F.array_position(metadata, "description")
    o = F.array_position(metadata, "og:description")
    return (F.when(d > 0, F.try_element_at(metadata, (d + 1).cast("int")))
            .when(o > 0, F.try_element_at(metadata, (o + 1).cast("int"))))


def result_text(text: str, metadata: str, words: str) -> Column:
    """The displayed text: highlighted description, else highlighted snippet."""
    w = F.col(words)
    desc = description(F.coalesce(F.col(metadata), F.array().cast("array<string>")))
    return F.when(desc.isNotNull(), highlight(desc, w)).otherwise(highlight(snippet(text, words), w))
