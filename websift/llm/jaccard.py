"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification of what is left.

1. Texts are classes of equal texts (by digest); each class has one MinHash signature.
2. Classes that share a band of the signature are joined into neighbourhoods (connected components of the bucket
   graph, star edges only: no bucket is expanded into pairs).
3. A neighbourhood is compared in one task, or, beyond ``BLOCK_CLASSES`` classes or ``BLOCK_SHINGLES`` shingles, in
   blocks against blocks in many tasks, so no task holds more than two blocks.  Pairs are compared ``STEP`` MinHash
   values at a time; a pair is dropped once the posterior probability (uniform prior) that its similarity reaches the
   threshold falls under ``TOLERANCE``.  The pairs left are counted exactly on their shingle sets.
4. Tasks give back per class its number of links and the smallest class that it reaches there, never pairs; the
   components of those links are the groups of near-duplicates.

A pair at the threshold is missed with probability below 1e-6 (bands) plus 1e-8 (pruning); copies are never missed.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts of one to four words link
with texts of the same words; repeated rows are copies of each other; null doc_ids are never a class id while the
class has another; an empty table gives an empty result; other columns are ignored, or kept by ``keep_one``.  A doc_id
on several texts, or a group without any, makes class_id no name of a group (two groups can have one class_id, or
null): ``group_id`` tells groups apart, and ``keep_one`` goes by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import components, cut, runs, smallest_roots

THRESHOLD = Fraction(4, 5)
TOLERANCE = 1e-9
STEP = 20
BLOCK_CLASSES = 2000
BLOCK_SHINGLES = 2_000_000
#: Pairs and shingles that verification looks at together (bounds its memory).
PAIR_CHUNK, SHINGLE_CHUNK = 50_000, 4096


def least_matches(threshold=THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values (STEP, 2 STEP, ...): fewer matches than this drop a pair.

    With a uniform prior and m of n values equal, P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    t, out = float(threshold), []
    for n in range(STEP, S.HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _signatures(df: DataFrame) -> DataFrame:
    """(doc_id, node = digest of the text, size = shingles with repeats, sig)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, offsets = S.shingles(b["text"])
            sigs = S.signatures(h, offsets)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "node": b["node"], "size": np.diff(offsets),
                                "sig": [s.tobytes() for s in sigs]})
    return df.mapInPandas(run, "doc_id long, node binary, size long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(key, id): one row per class and band."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sigs = np.frombuffer(b"".join(b["sig"]), dtype=np.uint16).reshape(len(b), S.HASHES)
                yield pd.DataFrame({"key": S.band_keys(sigs).ravel(), "id": np.repeat(b["id"].to_numpy(), S.BANDS)})
    return classes.select("id", "sig").mapInPandas(run, "key long, id long")


def similar(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, least: list[int],
            threshold=THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of positions) with similarity >= threshold between ``left`` and ``right``, chunk by chunk.

    ``same``: both are one block, each pair is looked at once.  ``sets``: sorted distinct shingles."""
    sizes = np.array([len(x) for x in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # shingles of one text only are in no intersection
    renamed = np.cumsum(shared) - 1
    use = shared[column]
    rows, column = rows[use], renamed[column[use]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    n_columns = int(shared.sum())
    lows = np.arange(0, n_columns, SHINGLE_CHUNK)
    cuts = np.searchsorted(column, np.append(lows, n_columns))
    for at in range(0, len(left), 256):
        l = left[at:at + 256]
        # all pairs of the chunk on the first values, then only those that are left
        equal = np.zeros((len(l), len(right)), dtype=np.uint8)
        for k in range(STEP):
            equal += sigs[l, k][:, None] == sigs[right, k][None, :]
        alive = equal >= least[0]
        if same:
            alive &= l[:, None] < right[None, :]
        i, j = np.nonzero(alive)
        x, y, found = l[i], right[j], equal[i, j].astype(np.int64)
        for step, m in enumerate(least[1:], 1):
            for p in range(0, len(x), PAIR_CHUNK):
                s = slice(p, p + PAIR_CHUNK)
                found[s] += (sigs[x[s], step * STEP:(step + 1) * STEP] == sigs[y[s], step * STEP:(step + 1) * STEP]).sum(1)
            ok = found >= m
            x, y, found = x[ok], y[ok], found[ok]
        if not len(x):
            continue
        both = np.zeros(len(x), dtype=np.int64)
        for c, low in enumerate(lows):
            bits = np.zeros((len(sets), SHINGLE_CHUNK), dtype=bool)
            bits[rows[cuts[c]:cuts[c + 1]], column[cuts[c]:cuts[c + 1]] - low] = True
            packed = np.packbits(bits, axis=1).view(np.uint64)
            for p in range(0, len(x), PAIR_CHUNK):
                s = slice(p, p + PAIR_CHUNK)
                both[s] += np.bitwise_count(packed[x[s]] & packed[y[s]]).sum(1, dtype=np.int64)
        union = sizes[x] + sizes[y] - both
        ok = both * threshold.denominator >= union * threshold.numerator
        if ok.any():
            yield x[ok], y[ok]


def _compare(batches: Iterator[pd.DataFrame], least: list[int], threshold=THRESHOLD) -> Iterator[pd.DataFrame]:
    """Runs of equal (component, i, j) in sorted batches are groups; each gives (id, root, links) per linked class."""
    def group(g: pd.DataFrame) -> pd.DataFrame | None:
        g = g.sort_values("id", ignore_index=True)
        h, offsets = S.shingles(g["text"])
        sets = [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        sigs = np.frombuffer(b"".join(g["sig"]), dtype=np.uint16).reshape(len(g), S.HASHES)
        i, j, block = int(g["i"].iloc[0]), int(g["j"].iloc[0]), g["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        weight, links = g["copies"].to_numpy(), np.zeros(len(g), dtype=np.int64)
        root = np.arange(len(g))
        for x, y in similar(sigs, sets, left, right, i == j, least, threshold):
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            # star edges of what was found before stand for it
            root = smallest_roots(len(g), np.concatenate((x, np.arange(len(g)))), np.concatenate((y, root)))
        linked = links > 0
        ids = g["id"].to_numpy()
        return pd.DataFrame({"id": ids[linked], "root": ids[root[linked]], "links": links[linked]}) if linked.any() else None

    for g in runs(batches, ["component", "i", "j"]):
        if (out := group(g)) is not None:
            yield out


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold=THRESHOLD, tolerance: float = TOLERANCE,
         block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``df``: doc_id, node (digest of the text), group_id (number of the group of near-duplicates,
    of this run), class_id (smallest doc_id of the group), copy_id (smallest doc_id with the same text) and n_links
    (rows with similarity >= threshold)."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.coalesce(F.col(text), F.lit(""))).alias("node"),
                     F.col(text).alias("text"))
    rows = cut(_signatures(docs), "signatures")
    classes = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"),
                                       F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    # neighbourhoods
    bands = cut(_bands(classes.where("size > 0")), "bands")
    low = bands.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1")
    near = cut(components(bands.join(low, "key").where("id != low"), "id", "low"), "neighbourhoods")
    inside = cut(near.join(classes, near["node"] == classes["id"]).select("component", "id", classes["node"], "copies", "size", "sig"), "inside")
    # blocks
    volume = inside.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_classes), F.ceil(F.sum("size") / block_shingles)).alias("blocks"))
    # one row stands for a class, found by its own key: the copies of a text are spread over tasks and go no further
    stands = near.join(classes, near["node"] == classes["id"]).select(_row_key(F.col("first_id"), classes["node"]).alias("_key"))
    texts = docs.withColumn("_key", _row_key(F.col("doc_id"), F.col("node"))).join(stands, "_key", "left_semi") \
        .groupBy("node").agg(F.first("text").alias("text"))
    dealt = inside.join(volume, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))) \
        .join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
                         "id", "copies", "sig", "text")
    least = least_matches(threshold, tolerance)
    found = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j") \
        .mapInPandas(lambda batches: _compare(batches, least, threshold), "id long, root long, links long")
    found = cut(found, "links")
    # groups
    groups = components(found, "id", "root").select(F.col("node").alias("id"), "component")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("id", "node", "first_id", "copies", "size").join(groups, "id", "left").join(links, "id", "left")
    lowest = classes.join(groups, "id").groupBy("component").agg(F.min("first_id").alias("lowest"))
    named = named.join(lowest, "component", "left").select(
        "node", "size", F.coalesce("component", "id").alias("group_id"), F.coalesce("lowest", "first_id").alias("class_id"), F.col("first_id").alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    blank = F.col("size") == 0
    return rows.select("doc_id", "node").join(named, "node").select(
        "doc_id", "node", "group_id", F.when(blank, F.col("doc_id")).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(blank, F.col("doc_id")).otherwise(F.coalesce("copy_id", "doc_id")).alias("copy_id"),
        F.when(blank, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def _row_key(doc_id: Column, node: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.hex(node))))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group (smallest doc_id; of rows with one doc_id, the one whose text has the smallest digest),
    with the columns of ``df``; rows without words all stay, but for exact repeats of a row."""
    links = cut(join(df, doc_id, text, **options), "links")
    blank = F.unhex(F.md5(F.lit("")))
    linked = links.withColumn("_own", F.when(F.col("n_links") == 0, _row_key(F.col("doc_id"), F.col("node"))))
    kept = linked.groupBy("group_id", "_own").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best")) \
        .select(_row_key(F.col("best.doc_id"), F.col("best.node")).alias("_key")).distinct()
    columns = df.columns
    names = [f"_in{i}" for i in range(len(columns))]
    name = dict(zip(columns, names))
    d = df.toDF(*names)
    node = F.when(F.col(name[text]).isNull(), blank).otherwise(text_key(F.col(name[text])))
    d = d.withColumn("_key", _row_key(F.col(name[doc_id]).cast("long"), node))
    return d.join(kept, "_key").dropDuplicates(["_key"]).select(*[F.col(n).alias(c) for n, c in zip(names, columns)])
