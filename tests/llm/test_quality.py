import re

from websift.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed)


def test_counts_equal_brute_force(spark, docs, rows):
    extra = [(900, "a b c d e f g h " * 4 + "| # x\ny\ny\n \n \nz", "en"), (901, "é ü x\x0b\x0cq", "de"), (902, "w " * 9, "es"),
             (903, " ".join(f"t{i % 11}" for i in range(60)), None), (904, "\U0001f600 " * 30, "fr")]
    df = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.measures(df, carry=["doc_id"]).collect()))
    want = sorted((r[0] is None, r[0] or 0, *brute(r[1])) for r in [(x[0], x[1]) for x in rows] + [x[:2] for x in extra])
    assert got == want


def test_divergence_separates_prose_from_noise(spark):
    clean = "The house of the old man was in the valley, and it is said that for a long time the river ran by it. " * 1 + \
        "In the summer of that year a boat came to the shore, and the people went to see what was in it. It was full of grain."
    rows = [(1, clean, "en"), (2, " ".join(w.upper() + "!!" for w in clean.split()), "en"),
            (3, " ".join(w + "$$$" for w in clean.split()), "en"), (4, clean, None), (5, "$$$ %%% " * 5, "en")]
    got = {r.doc_id: r for r in quality.measures(spark.createDataFrame(rows, "doc_id long, text string, lang string"), carry=["doc_id"]).collect()}
    assert got[1].kept and got[4].kept
    assert not got[2].kept and not got[3].kept and not got[5].kept
    assert got[5].class_distance is None  # too short to be judged; the base rules fail it
    assert all(0 <= r.class_distance <= 1 for r in got.values() if r.class_distance is not None)


def test_filter_keeps_columns_and_empty_table(docs, empty):
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    kept = sorted(r.doc_id for r in quality.measures(docs, carry=["doc_id"]).where("kept and doc_id is not null").collect())
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == kept
    assert quality.filter_quality(empty).count() == 0


def test_reference_histograms_are_distributions():
    for v in quality.CLASS_REFERENCE.values():
        assert abs(sum(v) - 1) < 1e-9
    assert abs(sum(quality.GENERIC_CLASSES) - 1) < 1e-9
    for v in quality.COMMON_REFERENCE.values():
        assert sum(v.values()) < 1 and len(v) == 10


def test_text_without_common_words_is_dropped_in_every_language(spark):
    """The distance of the common words has to be reachable: prose without one of them is no prose of its language."""
    body = "Bramble lantern orchard whistle copper meadow thimble harbour velvet cinder, marble saddle willow pepper anchor."
    words = [body.replace("le", f"le{'abcdefgh'[i % 8]}").replace("er", f"er{'klmnopqr'[i % 8]}") for i in range(8)]
    strange = " ".join(words)
    rows = [(lang, strange, lang) for lang in quality.COMMON_REFERENCE] + [("none", strange, None)]
    got = {r.id: r for r in quality.measures(spark.createDataFrame(rows, "id string, text string, lang string"), carry=["id"]).collect()}
    assert not any(r.base_failed or r.class_distance > quality.MAX_CLASS_DISTANCE for r in got.values())
    assert all(not got[lang].kept and got[lang].n_words >= quality.MIN_WORDS_FOR_COMMON for lang in quality.COMMON_REFERENCE)
    assert got["none"].kept  # no language to compare with
