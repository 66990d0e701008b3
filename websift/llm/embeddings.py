"""Embedding near-duplicates by a subspace pigeonhole join: exact links of cosine >= threshold within a label.

Unit vectors are rotated by a fixed orthogonal matrix and split into blocks of ``BLOCK_DIMS`` dimensions.  Two vectors
of cosine c are at squared distance 2 - 2c; if that is at most the budget of the threshold, some block is at most at
its proportional share of it.  Each block is a range join: vectors are dealt to cells on the block's first
coordinate, neighbours near a cell's border are its guests, and pairs whose block distance is within the share are
candidates.  A pair found in several blocks counts in the first of them; its cosine is then computed in double
precision from the vectors as given.  Equal vectors of a label are one class and are not compared with each other.

A cell beyond ``CELL_VECTORS`` is compared in blocks against blocks in many tasks.  Tasks give back per class its
number of links and the smallest class that it reaches, not pairs.

Defined results: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of different lengths don't link; repeated rows are other vectors and link with each other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, runs, smallest_roots

THRESHOLD = 0.93
BLOCK_DIMS = 8
CELL_VECTORS = 4096
#: Allowance for rounding in distances that only choose candidates.
SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def bounds(dims: int) -> np.ndarray:
    """Borders of the blocks of dimensions."""
    return np.linspace(0, dims, max(1, dims // BLOCK_DIMS) + 1).astype(int)


def budgets(dims: int, threshold: float) -> np.ndarray:
    """Squared-distance budget of each block, in proportion to its dimensions."""
    return (2 - 2 * threshold) * np.diff(bounds(dims)) / dims + SLACK


def _rotated(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(vectors.shape[1])


def _vectors(df: DataFrame) -> DataFrame:
    """(vec_id, label, dims, key, vector): key names equal vectors; it is null where the vector can't link."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for label, e in zip(b["label"], b["embedding"]):
                v = None if e is None else pd.to_numeric(pd.Series(e), errors="coerce").to_numpy(dtype=np.float64) + 0.0
                ok = v is not None and len(v) and not pd.isna(label) and np.isfinite(v).all() and v.any()
                raw = v.tobytes() if ok else None
                rows.append((len(v) if ok else None, hashlib.md5(raw).digest() if ok else None, raw))
            out = pd.DataFrame(rows, columns=["dims", "key", "vector"])
            out["dims"] = out["dims"].astype("Int32")
            yield pd.concat([b[["vec_id", "label"]].reset_index(drop=True).astype({"vec_id": "Int64"}), out], axis=1)
    return df.mapInPandas(run, "vec_id long, label string, dims int, key binary, vector binary")


def _deal(classes: DataFrame, threshold: float) -> DataFrame:
    """One row per class and block for its home cell, and one more where it is a guest of the cell above."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, g in b.groupby("dims"):
                x = _rotated(np.frombuffer(b"".join(g["vector"]), dtype=np.float64).reshape(len(g), dims))
                for k, (at, budget) in enumerate(zip(bounds(dims)[:-1], budgets(dims, threshold))):
                    radius = float(np.sqrt(budget))
                    place = x[:, at] / (2 * radius)  # cells are two radii wide
                    cell = np.floor(place).astype(np.int64)
                    guest = place - cell >= 0.5 - SLACK
                    home = g.assign(part=k, cell=cell, home=True)
                    yield home
                    if guest.any():
                        yield home[guest].assign(cell=cell[guest] + 1, home=False)
    return classes.select("label", "dims", "id", "copies", "vector").mapInPandas(
        run, "label string, dims int, id long, copies long, vector binary, part int, cell long, home boolean")


def _links(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for g in runs(batches, ["label", "dims", "part", "cell", "i", "j"]):
        g = g.sort_values("id", ignore_index=True)
        dims, part = int(g["dims"].iloc[0]), int(g["part"].iloc[0])
        raw = np.frombuffer(b"".join(g["vector"]), dtype=np.float64).reshape(len(g), dims)
        x, norms = _rotated(raw), np.linalg.norm(raw, axis=1)
        edges, share = bounds(dims), budgets(dims, threshold)
        own = x[:, edges[part]:edges[part + 1]]
        squares = (own ** 2).sum(1)
        block, home, ids = g["block"].to_numpy(), g["home"].to_numpy(), g["id"].to_numpy()
        left, right = np.flatnonzero(block == g["i"].iloc[0]), np.flatnonzero(block == g["j"].iloc[0])
        same = g["i"].iloc[0] == g["j"].iloc[0]
        weight, links, root = g["copies"].to_numpy(), np.zeros(len(g), dtype=np.int64), np.arange(len(g))
        for at in range(0, len(left), 512):
            l = left[at:at + 512]
            near = squares[l][:, None] + squares[right][None, :] - 2 * (own[l] @ own[right].T) <= share[part] + SLACK
            if same:
                near &= l[:, None] < right[None, :]
            near &= home[l][:, None] | home[right][None, :]
            i, j = np.nonzero(near)
            for p in range(0, len(i), 100_000):
                a, b = l[i[p:p + 100_000]], right[j[p:p + 100_000]]
                within = np.stack([((x[a, s:e] - x[b, s:e]) ** 2).sum(1) for s, e in zip(edges[:-1], edges[1:])], axis=1) <= share
                first = within.any(axis=1) & (within.argmax(axis=1) == part)
                a, b = a[first], b[first]
                cosine = np.einsum("ij,ij->i", raw[a], raw[b]) / (norms[a] * norms[b])
                a, b = a[cosine >= threshold], b[cosine >= threshold]
                if len(a):
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    everyone = np.arange(len(g))
                    root = smallest_roots(len(g), np.concatenate((a, everyone)), np.concatenate((b, root)))
        linked = links > 0
        if linked.any():
            yield pd.DataFrame({"id": ids[linked], "root": ids[root[linked]], "links": links[linked]})


def join(df: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding",
         label: str = "label", cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id and kept."""
    given = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    rows = cut(_vectors(given), "vectors")
    valid = rows.where("key is not null")
    classes = valid.groupBy("label", "dims", "key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    dealt = cut(_deal(classes, threshold), "cells")
    cell = ["label", "dims", "part", "cell"]
    # a cell of guests alone has no pairs of its own
    sizes = dealt.groupBy(*cell).agg(F.ceil(F.count("*") / cell_vectors).alias("blocks"), F.max("home").alias("used"), F.count("*").alias("n")) \
        .where("used and n > 1").select(*cell, "blocks")
    pairs = dealt.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    group = [*cell, "i", "j"]
    found = cut(pairs.repartition(*group).sortWithinPartitions(*group).mapInPandas(
        lambda batches: _links(batches, threshold), "id long, root long, links long"), "links")
    groups = components(found, "id", "root").select(F.col("node").alias("id"), "component")
    lowest = classes.join(groups, "id").groupBy("component").agg(F.min("first_id").alias("lowest"))
    named = classes.select("id", "label", "dims", "key", "first_id", "copies").join(groups, "id", "left") \
        .join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(lowest, "component", "left") \
        .select("label", "dims", "key", F.coalesce("lowest", "first_id").alias("lowest"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = rows.select("vec_id", "label", "dims", "key").join(named, ["label", "dims", "key"], "left")
    component = F.coalesce("lowest", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
