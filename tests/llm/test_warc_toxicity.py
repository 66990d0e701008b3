import base64
import gzip
import hashlib
import io
import json
import os
import random
import zlib

import numpy as np
import pytest

from websift.llm import toxicity, warc

PAGES = "page_id long, url string, html string, archive string, place long"


def pages():
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", f"<p>{rng.random()}</p>" * rng.randrange(1, 50), "x", 0) for i in range(60)]
    rows += [(100 + i, "http://h/same", "<p>same</p>", "x", 0) for i in range(20)]
    return rows + [(200, None, None, None, None), (201, "a\r\nb c", "", None, None), (202, "u", "é€" * 60_000, None, None), rows[3], rows[3],
                   (None, "u", "<p>same</p>", None, None)]


def test_round_trip_equals_brute_force(spark):
    rows = pages()
    payload = [(r[0], (r[2] or "").encode()) for r in rows]
    best = {}
    for p, b in payload:
        if p is not None:
            best[b] = max(best.get(b, -1), p)
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = sorted(((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for p, b in payload), key=key)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=key) == want
    digest = {base64.b32encode(hashlib.sha1(b).digest()).decode(): v for b, v in best.items()}
    responses = [r for r in got if r.record_type == "response"]
    assert len(responses) == len(digest) and all(r.page_id == digest[r.payload_digest] and r.refers_to is None for r in responses)
    assert all(r.refers_to == digest[r.payload_digest] for r in got if r.record_type == "revisit")


def test_smaller_payloads_are_all_responses(spark):
    got = warc.round_trip(spark.createDataFrame(pages(), PAGES), min_bytes=100).collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)


def test_members_are_whole_gzip_members_and_the_index_points_at_them(spark, tmp_path):
    whole, members = f"file://{tmp_path}/whole", f"file://{tmp_path}/members"
    records = warc.write_archives(spark.createDataFrame(pages(), PAGES).coalesce(1), whole, archive_bytes=20_000)
    names = sorted(os.listdir(tmp_path / "whole"))
    assert len(names) > 1  # a task begins a new archive after its limit
    inflater = zlib.decompressobj(wbits=31)
    raw = (tmp_path / "whole" / names[0]).read_bytes()
    inflater.decompress(raw)
    assert inflater.eof and not inflater.unused_data  # one stream for the whole file
    archives = warc.normalise(whole, warc.decisions(records), members, len(names)).collect()
    assert sum(a.records for a in archives) == len(pages())
    for a in archives:
        raw = (tmp_path / "members" / a.archive).read_bytes()
        index = [json.loads(x) for x in (tmp_path / "members" / a.sidecar).read_text().splitlines()]
        assert index[0]["offset"] == 0 and index[-1]["offset"] + index[-1]["length"] == len(raw)
        for e in index:
            one = gzip.decompress(raw[e["offset"]:e["offset"] + e["length"]])
            h = warc.parse_headers(one.partition(b"\r\n\r\n")[0])
            assert h["WARC-Record-ID"] == e["id"] and h["WARC-Type"] == e["type"] and one.endswith(b"\r\n\r\n")
        assert [r for r in warc.inflate(io_stream(raw))] == [gzip.decompress(raw[e["offset"]:e["offset"] + e["length"]]) for e in index]


def io_stream(raw):
    return io.BytesIO(raw)


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def toxic_table(n=900):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(80)] + rng.choices(["the", "of", "and"], k=20)
        letters = ["".join(chr(97 + int(c)) for c in str(zlib.crc32(w.encode()) % 10 ** 6)) if w.startswith("w") else w for w in words]
        bad = i % 8 == 0
        if bad:
            letters[10:10] = rng.sample(["idiot", "scum", "moron", "trashling", "trashes"], 3)
        rows.append((i, " ".join(letters), "en"))
        if i % 2 == 0:
            labels.append((i, int(bad), 1))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = toxic_table()
    rows += [(9000, None, None), (9001, "", "en"), (None, "you idiot", "en"), (3, rows[3][1], "en")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"),
                         spark.createDataFrame(labels + [labels[0], (None, 1, 1)], "doc_id long, toxic int, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    right = sum(r.predicted == int(r.doc_id % 8 == 0) for r in held)
    assert right >= 0.97 * len(held) and any(r.predicted for r in held)


@pytest.mark.parametrize("times", [0.25, 4])
def test_the_share_of_toxic_labels_does_not_matter(spark, times):
    """Labels with a quarter or four times the toxic share of the documents (1 in 8)."""
    rows, _ = toxic_table(3600)
    toxic, clean = ([r[0] for r in rows if (r[0] % 8 == 0) == bad] for bad in (True, False))
    some = toxic[:int(len(clean) * times / (8 - times))]
    labels = [(d, 1) for d in some] + [(d, 0) for d in clean[:int(len(some) * (8 / times - 1))]]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 8 == 0) for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("share", [0.01, 0.05, 0.2, 0.5])
def test_class_prior(share):
    rng = np.random.default_rng(5)
    n, k = 8000, 40
    bad = rng.random(n) < share
    x = (rng.random((n, k)) < np.where(bad[:, None], 0.25, 0.02 * (np.arange(k) % 4))).astype(np.float32)
    toxic = (rng.random((600, k)) < 0.25).astype(np.float32)
    assert 0.85 * share <= toxicity.class_prior(toxic, x) <= 1.5 * share


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = toxic_table()
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t, q) for d, t, q in labels]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(df, spark.createDataFrame(x, "doc_id long, toxic int, quality int")).collect())
            for x in (labels, flipped))
    assert np.allclose([x[1] for x in a], [x[1] for x in b])


def test_toxicity_without_examples(spark):
    df = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(df, none).collect()] == [0.0]
    assert toxicity.score(df.limit(0), none).count() == 0


def test_unlabelled_examples_are_no_negatives():
    rng = np.random.default_rng(0)
    toxic, clean = ((rng.random((n, 30)) < 0.3).astype(np.float32) for n in (60, 400))
    toxic[:, 0], clean[:, 0] = 1, 0
    unlabelled = np.vstack([clean, toxic[:40]])
    w, b = toxicity.fit_nnpu(toxic, unlabelled, 0.085)
    assert ((clean @ w + b) < 0).mean() > 0.95 and ((toxic @ w + b) > 0).mean() > 0.95
    # a prior above the true share makes the estimated risk of clean text negative: the fit stops there, it doesn't diverge
    w, b = toxicity.fit_nnpu(toxic, unlabelled, 0.3)
    assert np.isfinite(w).all() and abs(b) < 30
