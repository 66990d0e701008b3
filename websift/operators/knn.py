"""Exact k-nearest-neighbour vote.

Training rows belong to the cell of their nearest pivot; a cell is cut into rings of distance from its pivot.  For a test
row and a ring the triangle inequality gives a least and a largest possible distance, and the border between two cells
another least one.  A test row first visits the rings that surely hold k rows; its k-th distance there is a radius, and
it then visits the rings that can hold a row within it, and no others.  The result is that of comparing all pairs.

Pivots are the training rows with the least hashes, about the square root of their number and at most ``max_pivots``; a
cell has at most ``MAX_RINGS`` rings, so pivots and ring bounds, which every task holds, are bounded by parameters.  Rings
of cells near each other share a block of at most ``block_rows`` rows, and a test row is sent once to each block with a
ring that it visits, with a bit for each ring there; so where no ring can be left out, the copies of the test rows grow
with the training rows over ``block_rows`` and not with the cells.  Rings of more than ``block_rows`` rows are split by
hash, and so are the visitors of a block, so a task compares about ``block_rows`` with ``block_rows`` / ``VISITS`` rows, also
where a third of all rows are equal.  Rows without a vector have no neighbours and are none's; ids are distinct.  For
approximate search ``approx_neighbours`` gives the LSH join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_document, materialize

K = 50
BLOCK_ROWS = 65536
RING_ROWS = 4096
VISITS = 8  # training rows of a task for each of its visitors
CHUNK = 256
SLICE = 2048  # training rows whose distances from a chunk are held at once
MAX_PIVOTS = 1024
MAX_RINGS = 16
SLACK = 1e-9  # of rounding in the bounds; visits one ring too many rather than one too few
RING = ["cell", "ring"]


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_numpy()).astype(np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 17) // max(b.size, 1))  # differences that stay in a processor's cache
    parts = [((a[s:s + step, None, :] - b[None, :, :]) ** 2).sum(axis=2) for s in range(0, len(a), step)]
    return np.sqrt(np.concatenate(parts)) if parts else np.zeros((0, len(b)))


def pivots(train: DataFrame, max_pivots: int = MAX_PIVOTS) -> np.ndarray:
    """At most ``max_pivots`` training vectors, chosen by the hash of their ids."""
    n = min(max_pivots, math.isqrt(train.count()) + 1)
    return np.array([r["vec"] for r in train.orderBy(F.xxhash64("id"), "id").limit(n).select("vec").collect()], dtype=np.float64)


def cells(train: DataFrame, piv: np.ndarray, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, pd.DataFrame]:
    """Training rows (id, vec, label, cell, ring, block, at), and the rings (cell, ring, n, lo, hi, block, salts, at)."""
    def nearest(batches):
        for b in batches:
            parts = [_distances(_matrix(b["vec"][s:s + CHUNK]), piv) for s in range(0, len(b), CHUNK)]
            d = np.concatenate(parts) if parts else np.zeros((0, len(piv)))
            yield b.assign(cell=d.argmin(axis=1).astype(np.int32), dist=d.min(axis=1))
    spark = train.sparkSession
    schema = f"id long, vec {dict(train.dtypes)['vec']}, label int, cell int, dist double"
    rows = materialize(train.select("id", "vec", F.col("label").cast("int").alias("label")).mapInPandas(nearest, schema))
    size = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("from"), F.max("dist").alias("to")) \
        .withColumn("rings", F.least(F.lit(MAX_RINGS), F.ceil(F.col("n") / min(block_rows, RING_ROWS))).cast("int")).drop("n")
    place = F.when(F.col("to") > F.col("from"), F.floor((F.col("dist") - F.col("from")) / (F.col("to") - F.col("from")) * F.col("rings"))).otherwise(0)
    # one row a cell, then one row a ring: bounded by the parameters, hence broadcast
    rows = rows.join(F.broadcast(materialize(size)), "cell") \
        .withColumn("ring", F.least(place, F.col("rings") - 1).cast("int")).drop("from", "to", "rings")
    rings = _blocks(rows.groupBy(*RING).agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).toPandas(),
                    piv, block_rows)
    placed = spark.createDataFrame(rings[[*RING, "block", "salts", "at"]], "cell int, ring int, block int, salts int, at int")
    rows = rows.join(F.broadcast(placed), RING) \
        .withColumn("block", (F.col("block") + F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int")).drop("dist", "salts")
    return rows, rings


def _blocks(rings: pd.DataFrame, piv: np.ndarray, block_rows: int) -> pd.DataFrame:
    """``rings`` with the block of each, and its number ``at`` there; a ring of more than ``block_rows`` rows has the
    ``salts`` blocks from ``block`` on for itself."""
    d = _distances(piv, piv[:math.isqrt(len(piv))])
    cell = rings["cell"].to_numpy()
    rings = rings.assign(head=d.argmin(axis=1)[cell], far=d.min(axis=1)[cell]).sort_values(["head", "far", *RING]).drop(columns=["head", "far"])
    salts = -(-rings["n"].to_numpy() // block_rows)
    block, at, room, after = [], [], 0, 0
    for n, parts in zip(rings["n"].tolist(), salts.tolist()):
        if n <= room:
            block.append(after - 1)
            at.append(at[-1] + 1)
            room -= n
        else:
            block.append(after)
            at.append(0)
            after, room = after + parts, block_rows - n  # none is left beside a ring with several blocks
    return rings.assign(block=block, salts=salts, at=at).reset_index(drop=True)


def _bounds(vecs: np.ndarray, piv: np.ndarray, between: np.ndarray, rings: pd.DataFrame):
    """Least and largest distance of each vector from the rows of each ring."""
    cell = rings["cell"].to_numpy()
    d = _distances(vecs, piv)
    own = d.argmin(axis=1)
    at, lo, hi = d[:, cell], rings["lo"].to_numpy(), rings["hi"].to_numpy()
    gap = between[own][:, cell]  # a ring's row is nearer to its own pivot than to the vector's
    border = np.divide(at ** 2 - d[np.arange(len(d)), own][:, None] ** 2, 2 * gap, out=np.zeros_like(at), where=gap > 0)
    return np.maximum.reduce([at - hi, lo - at, border, np.zeros_like(at)]), at + hi


def _visits(test: DataFrame, piv: np.ndarray, rings: pd.DataFrame, k: int) -> DataFrame:
    """(id, vec, most, block, salts, need, pairs) to visit: with a column ``most`` (a squared distance) in ``test`` the rings
    within it, without the first ones.  ``need`` has a bit for each ring of the block, ``pairs`` is the rows in those to visit."""
    between = _distances(piv, piv)
    n = rings["n"].to_numpy()
    blocks = [(b, np.flatnonzero(rings["block"].to_numpy() == b)) for b in pd.unique(rings["block"])]
    salts = rings["salts"].to_numpy()
    later = "most" in test.columns

    def visit(batches):
        for b in batches:
            for s in range(0, len(b), CHUNK):
                part = b.iloc[s:s + CHUNK]
                least, most = _bounds(_matrix(part["vec"]), piv, between, rings)
                order = np.argsort(most, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                chosen = np.zeros(most.shape, dtype=bool)
                np.put_along_axis(chosen, order, before < k, axis=1)
                if later:
                    r = np.sqrt(part["most"].to_numpy()[:, None])
                    chosen = ~chosen & (least <= r * (1 + SLACK) + SLACK)
                for block, own in blocks:
                    here = chosen[:, own]
                    q = np.flatnonzero(here.any(axis=1))
                    if len(q):
                        yield pd.DataFrame({"id": part["id"].to_numpy()[q], "vec": part["vec"].to_numpy()[q],
                                            "most": part["most"].to_numpy()[q] if later else np.inf, "block": block, "salts": salts[own[0]],
                                            "need": [bits.tobytes() for bits in np.packbits(here[q], axis=1)], "pairs": here[q] @ n[own]})
    return test.mapInPandas(visit, f"id long, vec {dict(test.dtypes)['vec']}, most double, block int, salts int, need binary, pairs long")


def _first(q: np.ndarray, c: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first entries of each ``q`` by (d, c)."""
    order = np.lexsort((c, d, q))
    q, c, d = q[order], c[order], d[order]
    first = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[first], c[first], d[first]


def _closest(x: np.ndarray, m: np.ndarray, most: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of m, squared distance) of the k first rows of ``m`` by (distance, row) that are within ``most`` and,
    if given, ``allowed``.

    A matrix product gives every squared distance up to rounding; only the rows that may be among the k are then measured
    exactly.  Rows with non-finite numbers are all measured.  ``m`` is taken in slices, each bounded by what was found."""
    q, c, d = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    with np.errstate(all="ignore"):
        xx, mm = (x * x).sum(axis=1), (m * m).sum(axis=1)
        slack = 16 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (xx + mm.max())
        odd = ~np.isfinite(xx + mm.max())
        left, right = np.column_stack([-2.0 * x, xx, np.ones(len(x))]), np.column_stack([m, np.ones(len(m)), mm])
        bound, reduced = most, 0
        for s in range(0, len(m), SLICE):
            near = left @ right[s:s + SLICE].T
            if allowed is not None:
                near[~allowed[:, s:s + SLICE]] = np.inf
            chosen = near <= (bound + slack)[:, None]
            if k < near.shape[1] and np.count_nonzero(chosen) > 2 * k * len(x):
                chosen = near <= (np.minimum(np.partition(near, k - 1, axis=1)[:, k - 1], bound) + slack)[:, None]
            if odd.any():
                chosen |= odd[:, None]
            if allowed is not None:
                chosen &= allowed[:, s:s + SLICE]
            i, j = np.divmod(np.flatnonzero(chosen), chosen.shape[1])
            j += s
            e = np.concatenate([((x[i[t:t + CHUNK * CHUNK]] - m[j[t:t + CHUNK * CHUNK]]) ** 2).sum(axis=1)
                                for t in range(0, max(len(i), 1), CHUNK * CHUNK)])
            kept = ~(e > bound[i])
            q, c, d = np.concatenate([q, i[kept]]), np.concatenate([c, j[kept]]), np.concatenate([d, e[kept]])
            if len(q) > reduced + 2 * k * len(x) or not s:
                q, c, d = _first(q, c, d, k)
                reduced = len(q)
                end = np.searchsorted(q, np.arange(len(x)), side="right") - 1
                full = np.flatnonzero(np.bincount(q, minlength=len(x)) == k)
                bound = bound.astype(np.float64)
                bound[full] = np.fmin(bound[full], d[end[full]])
    return _first(q, c, d, k)


def _nearest(visits: DataFrame, rows: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(id, nb_id, nb_label, dist2): the k nearest rows of each visited block that are not farther than the visitor's
    ``most``; ties by training id."""
    v = visits.withColumn("block", F.explode(F.sequence(F.col("block"), F.col("block") + F.col("salts") - 1)))
    # one row for each ``block_rows`` training rows, hence broadcast
    parts = F.broadcast(v.groupBy("block").agg(F.ceil(F.count("*") / max(1, block_rows // VISITS)).cast("int").alias("parts")))
    v = v.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")) \
        .select("block", "part", "id", "vec", "most", "need")
    t = rows.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select("block", "part", "id", "vec", "label", "at")

    def topk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "nb_id": [], "nb_label": [], "dist2": []})
        right = right.sort_values("id", kind="mergesort")
        m, nb, label, at = _matrix(right["vec"]), right["id"].to_numpy(), right["label"].to_numpy(), right["at"].to_numpy()
        left = left.sort_values("need", kind="mergesort")  # rows of a chunk visit the same rings, where they can
        need = np.unpackbits(np.frombuffer(b"".join(left["need"]), dtype=np.uint8).reshape(len(left), -1), axis=1).astype(bool)
        there = np.unique(at)
        out = []
        for s in range(0, len(left), CHUNK):
            q, asked = left.iloc[s:s + CHUNK], need[s:s + CHUNK]
            cols = slice(None) if asked[:, there].any(axis=0).all() else np.flatnonzero(asked.any(axis=0)[at])
            near, ids, labels, of = m[cols], nb[cols], label[cols], at[cols]
            if not len(ids):
                continue
            # ties by training id: the right side is id-sorted
            i, j, d = _closest(_matrix(q["vec"]), near, q["most"].to_numpy(), min(k, len(ids)),
                               None if asked[:, np.unique(of)].all() else asked[:, of])
            out.append(pd.DataFrame({"id": q["id"].to_numpy()[i], "nb_id": ids[j], "nb_label": labels[j], "dist2": d}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "nb_id": [], "nb_label": [], "dist2": []})
    key = ["block", "part"]
    return v.groupBy(*key).cogroup(t.groupBy(*key)).applyInPandas(topk, "id long, nb_id long, nb_label int, dist2 double")


def _first_k(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("dist2", "nb_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(test: DataFrame, train: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS,
               report: dict | None = None) -> DataFrame:
    """(id, nb_id, nb_label, dist2, rank) for the k nearest training rows of each test row; ties by training id.

    Both inputs: (id, vec ARRAY<FLOAT|DOUBLE>, label).  ``report`` receives the pairs compared and the pairs there are."""
    test, train = (d.select("id", "vec", "label").where("vec is not null") for d in (test, train))
    piv = pivots(train, max_pivots)
    test, train = (by_document(d, "id") for d in (test, train))  # spread, as a small file is a single task
    if not len(piv):
        return train.select("id", F.col("id").alias("nb_id"), F.col("label").cast("int").alias("nb_label"),
                            F.lit(0.0).alias("dist2"), F.lit(0).alias("rank")).where("false")
    rows, rings = cells(train, piv, block_rows)
    early = materialize(_visits(test.select("id", "vec"), piv, rings, k))
    seen = materialize(_first_k(_nearest(early, rows, k, block_rows), k).drop("rank"))
    # fewer than k rows in all: every ring has been visited
    kth = seen.groupBy("id").agg(F.max("dist2").alias("most"))
    late = materialize(_visits(test.select("id", "vec").join(kth, "id"), piv, rings, k))
    if report is not None:
        report["compared"] = early.unionByName(late).agg(F.sum("pairs")).first()[0] or 0
        report["pairs"] = test.count() * train.count()
    return _first_k(seen.unionByName(_nearest(late, rows, k, block_rows)), k)


def vote(nbs: DataFrame) -> DataFrame:
    """Majority label among the neighbours; ties go to the smallest label."""
    counts = nbs.groupBy("id", "nb_label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("id").orderBy(F.col("n").desc(), F.col("nb_label").asc())
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1) \
        .select("id", F.col("nb_label").alias("predicted"))


def approx_neighbours(test: DataFrame, train: DataFrame, threshold: float, bucket_length: float = 2.0):
    """LSH (Euclidean random projections) join for very large inputs: approximate."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    tv = test.withColumn("features", array_to_vector("vec"))
    rv = train.withColumn("features", array_to_vector("vec"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                        numHashTables=3, seed=42).fit(rv)
    return model.approxSimilarityJoin(tv, rv, threshold, distCol="dist")
