import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from websift.llm import collocations, oracles

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, w1 string, part int"


def table():
    rng = random.Random(8)
    words = ["the", "of", "New", "york", "CITY", "é", "É", "a\x01b", "x\xa0y", "\x1f", "日本", "of'", "z"] + [f"w{k}" for k in range(60)]
    rows = []
    for k in range(400):
        text = " ".join(rng.choice(words[:13] if rng.random() < .6 else words) for _ in range(rng.randrange(0, 40)))
        if k % 5 == 0:
            text += rng.choice([" new york city", "\tnew  york city.", "! ha ha ha ha ha", "\nred\tred green,blue;red green blue"])
        rows.append((k, text, ["en", "fr", None, "und", "de"][k % 5]))
    rows += [(900, None, "en"), (901, "", "xx"), (902, " \t\n., ", "yy"), (903, "a b. " * 4000, "en"), (903, "a b. " * 4000, "en"),
             (904, "lone " * 12, "one"), (905, "p q r s " * 30, "pq"), (None, "new york", None)]
    return [(*r, "p", 1, "w", 2) for r in rows]


def brute(rows, min_count=10, top=2000):
    f, n, out = defaultdict(Counter), Counter(), []
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        gone = {s for p, a in cand.items() if len(p) == 3 for s in (p[:2], p[1:]) if 100 * a >= 50 * c[s]}
        found = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def result(df, **kw):
    return sorted(tuple(r) for r in collocations.collocations(df, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"min_count": 3, "top": 50}])
def test_equals_brute_force(spark, kw):
    rows = table()
    assert result(spark.createDataFrame(rows, SCHEMA), **kw) == brute([r[:3] for r in rows], **kw)


@pytest.mark.parametrize("bits", [6, 20])
def test_small_chunks_and_many_ranges_give_the_same(spark, bits):
    """Words whose phrases lie in several ranges, pairs whose triples lie in several batches, a bitmap that is full."""
    rows = table()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = result(spark.createDataFrame(rows, SCHEMA), min_count=3, chunk_bytes=2000, bitmap_bits=bits)
        assert got == brute([r[:3] for r in rows], min_count=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def test_words_keep_all_but_blanks_and_breaks():
    batch = pa.RecordBatch.from_pydict({"lang": ["a"], "text": ["Ab\tCD  é.É\x0b\x85x \xa0, "]})
    (lang, at, words), = collocations._chunks([batch])
    assert [None if i < 0 else words[int(i)].as_py().decode() for i in at] == ["ab", "cd", "é", None, "É", None, "\x85x", "\xa0", None]


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(1, None, None, "", 1, "", 1)], SCHEMA)) == []


def test_large_counts_are_exact(spark):
    big = 99_999_999_999_999
    df = spark.createDataFrame([(big, big, big - 1)], "n long, l long, r long")
    a, l, r = (collocations.F.col(c).cast("decimal(14,0)") for c in "nlr")
    x = df.select(collocations.F.call_function("div", a * a * collocations.F.lit(1_000_000).cast("decimal(7,0)"), l * r)).first()[0]
    assert x == 10**6 * big * big // (big * (big - 1))


def test_sql_agrees(spark):
    rows = [r[:3] for r in table()]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, "doc_id long, text string, lang string").toPandas())
    rel = con.sql(oracles.COLLOCATIONS)
    names = rel.columns
    got = sorted(tuple(x[names.index(c)] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for x in rel.fetchall())
    assert got == brute(rows)
