"""Prefix trie of conversations, with subtree sums by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns (role, text); (smallest member, depth) is its key.  Prefixes are found
without gathering a conversation: the rows are sorted into task ranges, and a prefix's fingerprint is the sum of its
turns' SHA-256 values times powers of a base, modulo a prime, in four lanes (124 bits).  Such sums can be continued
over the border of two tasks and moved to another position, so a conversation may lie in many tasks, and one that
takes its first turns from another conversation needs only the sums at both ends of the seam.

Subtree sums (``rollup``): every component of the parent-edge forest that has more than ``IN_TASK`` nodes is split by a
Spark round at its centroid, the deepest node whose subtree holds more than half of the component.  The totals of the
pieces below it, with its own value, are added to the nodes on the path from the centroid to the component's top;
below it each child's subtree, above it the rest, are components of the next round.  So the rounds grow with the
logarithm of the number of nodes, whatever the depth.  Paths and pieces are looked up by key in the table of the
owners' prefixes.  Components that fit a task are split the same way by numpy, all of a batch at once.

No task gathers a conversation, a node's members or a component: members are counted with map-side combine; the ids of
the conversations that end at a node are sorted into ranges and joined into strings of at most ``CHUNK`` ids, which
alone stream through the hash of their node.

Defined results: rows without conv_id belong to no conversation and are left out; a null role or text is empty; null
turns come first, ties follow the order of ``turns`` and repeated rows are turns each; an empty table has no node;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .turns import in_order, turns

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_917, 741_103_597, 214_013_953)
LANES = range(len(BASES))
IN_TASK = 8192
CHUNK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "hi", "lo"]


def _unpack(hi: str, lo: str, to: str) -> list:
    """Four lanes of two packed longs as columns ``to``0 to ``to``3."""
    return [F.shiftright(F.col(p), s).bitwiseAND(PRIME).alias(f"{to}{2 * i + j}")
            for i, p in enumerate((hi, lo)) for j, s in enumerate((31, 0))]


def _pack(lanes: list, hi: str, lo: str) -> list:
    return [(F.shiftleft(a, 31) + b).alias(n) for n, a, b in ((hi, lanes[0], lanes[1]), (lo, lanes[2], lanes[3]))]


class _Sums:
    """Running sums of turn values times powers of the bases, per conversation, over batches."""

    def __init__(self):
        self.powers = np.ones((len(BASES), 1), dtype=np.uint64)
        self.conv, self.n, self.sums = None, 0, [0] * len(BASES)

    def power(self, n: int) -> np.ndarray:
        while self.powers.shape[1] < n:  # doubles the table
            m = self.powers.shape[1]
            step = np.array([[pow(b, m, PRIME)] for b in BASES], dtype=np.uint64)
            self.powers = np.concatenate([self.powers, self.powers * step % PRIME], axis=1)
        return self.powers

    def add(self, conv: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, sums with and without the row) of sorted rows; values: lanes x rows."""
        at = np.arange(len(conv))
        new = np.concatenate([[conv[0] != self.conv or self.n == 0], conv[1:] != conv[:-1]])
        first = np.maximum.accumulate(np.where(new, at, -1))
        carried = first < 0
        index = np.where(carried, at + self.n, at - first)
        terms = values * self.power(int(index.max()) + 1)[:, index] % PRIME
        total = np.cumsum(terms, axis=1)  # below 2^31 a row
        before = np.where(carried, 0, (total - terms)[:, np.maximum(first, 0)])
        old = np.where(carried, np.array(self.sums, dtype=np.uint64)[:, None], np.uint64(0))
        here = (total - before + old) % PRIME
        self.conv, self.n, self.sums = conv[-1], int(index[-1]) + 1, [int(x) for x in here[:, -1]]
        return index + 1, here, (here + np.uint64(PRIME) - terms) % PRIME


def _continue(parts: list, lanes: range = LANES) -> list[tuple]:
    """(part, conv_id, rows before, sums, powers) for the parts whose first conversation began in an earlier one."""
    out, conv, n, sums = [], None, 0, [0] * len(BASES)
    for part, first, last, rows, own in parts:
        if n and first == conv:
            out.append((part, conv, n, *sums, *(pow(b, n, PRIME) for b in BASES)))
        if n and first == last == conv:
            sums = [(s + pow(b, n, PRIME) * o) % PRIME for s, b, o in zip(sums, BASES, own)]
            n += rows
        else:
            conv, n, sums = last, rows, list(own)
    return out


def prefixes(df: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), chars and the lanes of the prefix with (s) and without (b) the row, of every turn."""
    spark = df.sparkSession
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = turns(df).where("conv_id is not null")
    rows = rows.withColumns({f"t{k}": F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") % PRIME for k in LANES}) \
        .withColumn("chars", F.char_length("text").cast("long")).drop("role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), _Sums()
        for b in batches:
            if b.num_rows:
                conv = b.column("conv_id").to_numpy()
                values = np.stack([b.column(f"t{k}").to_numpy() for k in LANES]).astype(np.uint64)
                pos, s, p = sums.add(conv, values)
                packed = [(x[i] << np.uint64(31) | x[i + 1]).astype(np.int64) for x in (s, p) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, dtype=np.int32)), b.column("conv_id"),
                                                  pa.array(pos.astype(np.int64)), *map(pa.array, packed), b.column("chars")],
                                                 names=["part", "conv_id", "pos", "hi", "lo", "phi", "plo", "chars"])
    narrow = in_order(rows).select("conv_id", *(f"t{k}" for k in LANES), "chars")
    done = cut(narrow.mapInArrow(run, "part int, conv_id long, pos long, hi long, lo long, phi long, plo long, chars long"), "turns")
    ends = done.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos", "hi", "lo")).alias("end")) \
        .select("part", "first", "end.conv_id", "end.pos", *_unpack("end.hi", "end.lo", "s")).orderBy("part").collect()  # one row a task
    carry = _continue([(r[0], r[1], r[2], r[3], list(r[4:])) for r in ends])
    names = [*(f"c{k}" for k in LANES), *(f"w{k}" for k in LANES)]
    table = spark.createDataFrame(carry, "part int, conv_id long, rows long, " + ", ".join(f"{n} long" for n in names))
    wide = done.select("part", "conv_id", "pos", "chars", *_unpack("hi", "lo", "s"), *_unpack("phi", "plo", "b"))
    wide = wide.join(F.broadcast(table), ["part", "conv_id"], "left")  # at most one row a task
    return wide.select("conv_id", (F.col("pos") + F.coalesce("rows", F.lit(0))).alias("pos"), "chars",
                       *(((F.coalesce(f"c{k}", F.lit(0)) + F.coalesce(f"w{k}", F.lit(1)) * F.col(f"{x}{k}")) % PRIME).alias(f"{x}{k}")
                         for x in "sb" for k in LANES))


def steps(df: DataFrame, max_shared: int = 5, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """(steps, ends): a row for each prefix (not empty) of each rebuilt conversation, and each one's whole sequence.

    A conversation c is rebuilt from the first h turns of c - c % ``family``, h = crc32(c as text) % (``max_shared`` + 1),
    and its own turns after its first h; with ``max_shared`` 0 conversations stay as they are."""
    own = prefixes(df)
    lanes = [f"{x}{k}" for x in "sb" for k in LANES]
    row = F.struct("pos", "chars", *lanes)
    convs = cut(own.groupBy("conv_id").agg(F.max(F.struct("pos", *(f"s{k}" for k in LANES))).alias("last"),
                                           F.array_sort(F.collect_list(F.when(F.col("pos") <= max_shared, row))).alias("first")), "convs")
    base = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (max_shared + 1)).cast("int")
    info = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family}).join(base, "base", "left")
    info = info.withColumn("shared", F.coalesce(F.filter("base_first", lambda t: t["pos"] <= F.col("h")), F.slice("first", 1, 0)))
    info = info.withColumn("k", F.size("shared"))

    def at(array: str, index: str, lane: str):
        return F.when(F.col(index) > 0, F.try_element_at(F.col(array), F.col(index))[lane])
    info = info.select("conv_id", "h", "k", "last", "shared", *(F.coalesce(at("shared", "k", f"s{i}"), F.lit(0)).alias(f"p{i}") for i in LANES),
                       *(F.coalesce(at("first", "h", f"s{i}"), F.lit(0)).alias(f"q{i}") for i in LANES))
    info = cut(info, "rebuilt")

    def moved(column, i: int):
        """The lane of an own prefix behind the shared turns: without the first h turns, moved from h to k."""
        inverse = F.array(*(F.lit(pow(BASES[i], -e, PRIME)) for e in range(max_shared + 1)))
        return (F.col(f"p{i}") + (column - F.col(f"q{i}") + PRIME) % PRIME * F.get(inverse, F.col("h") - F.col("k"))) % PRIME
    mine = own.join(info.drop("last", "shared"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "chars",
        *_pack([moved(F.col(f"s{i}"), i) for i in LANES], "hi", "lo"), *_pack([moved(F.col(f"b{i}"), i) for i in LANES], "phi", "plo"))
    shared = info.select("conv_id", F.explode("shared").alias("t")).select("conv_id", "t.*").select(
        "conv_id", F.col("pos").alias("depth"), "chars", *_pack([F.col(f"s{i}") for i in LANES], "hi", "lo"),
        *_pack([F.col(f"b{i}") for i in LANES], "phi", "plo"))
    longer = F.col("last.pos") > F.col("h")
    ends = info.select("conv_id", (F.col("k") + F.greatest(F.col("last.pos") - F.col("h"), F.lit(0))).alias("depth"),
                       *_pack([F.when(longer, moved(F.col(f"last.s{i}"), i)).otherwise(F.col(f"p{i}")) for i in LANES], "hi", "lo"))
    return cut(mine.unionByName(shared), "steps"), cut(ends, "ends")


def ends_digest(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """SHA-256 of the ascending decimal ids that end at each node, comma-joined."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row():
            return pa.RecordBatch.from_pylist([dict(zip(KEY, key), at=ids[0], ids=",".join(map(str, ids)))], schema=schema)
        schema = pa.schema([*((k, pa.int64()) for k in KEY), ("at", pa.int64()), ("ids", pa.string())])
        for b in batches:
            for *k, c in zip(*(b.column(x).to_pylist() for x in [*KEY, "conv_id"])):
                if ids and (k != key or len(ids) >= chunk):
                    yield row()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def rows():
            return pa.RecordBatch.from_pylist(done, schema=pa.schema([*((k, pa.int64()) for k in KEY), ("ends_sha256", pa.string())]))
        for b in batches:
            for *k, ids in zip(*(b.column(x).to_pylist() for x in [*KEY, "ids"])):
                if k != key:
                    if state is not None:
                        done.append(dict(zip(KEY, key), ends_sha256=state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if done:
                yield rows()
                done = []
        if state is not None:
            done.append(dict(zip(KEY, key), ends_sha256=state.hexdigest()))
            yield rows()
    order = [*KEY, "conv_id"]
    chunks = ends.select(*(F.col(k).cast("long").alias(k) for k in order)).repartitionByRange(*order).sortWithinPartitions(*order) \
        .mapInArrow(join, "depth long, hi long, lo long, at long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "at").select(*KEY, "ids") \
        .mapInArrow(digest, "depth long, hi long, lo long, ends_sha256 string")


def decompose(parent: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (columns x nodes) in a forest by centroid decomposition; parent -1: a top.

    ``size`` holds the number of nodes in each subtree.  All components are split at once in each of the rounds."""
    n = len(parent)
    parent, size, out, alive, every = parent.copy(), size.copy(), np.zeros_like(values), np.ones(n, dtype=bool), np.arange(n)
    top = _tops(parent)
    while alive.any():
        cand = np.flatnonzero(alive & (2 * size > size[top]))
        cand = cand[np.lexsort((size[cand], top[cand]))]
        c = cand[np.concatenate([[True], top[cand][1:] != top[cand][:-1]])]  # one centroid a component
        own_top, own_size = top[c], size[c].copy()
        chosen = np.full(n, -1)
        chosen[own_top] = every[:len(c)]
        below = alive & (parent >= 0)
        below[below] = chosen[top[below]] >= 0
        below[below] = c[chosen[top[below]]] == parent[below]  # the children of centroids: tops of new components
        child, of = np.flatnonzero(below), chosen[top[below]]
        parent[child] = -1
        top = _tops(parent)
        total = np.zeros_like(values)
        np.add.at(total, (slice(None), top[alive]), values[:, alive])
        add = values[:, c].copy()
        np.add.at(add, (slice(None), of), total[:, child])
        at, k = c, every[:len(c)]
        while len(at):  # from the centroids to their tops
            out[:, at] += add[:, k]
            size[at] -= own_size[k]
            go = at != own_top[k]
            at, k = parent[at[go]], k[go]
        alive[c] = False
    return out


def _tops(parent: np.ndarray) -> np.ndarray:
    jump = np.where(parent < 0, np.arange(len(parent)), parent)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump
        jump = further


SUMS = "owner long, depth long, n_leaves long, saved_tokens long"
TOP = ["top_owner", "top_depth"]


def _in_tasks(state: DataFrame) -> DataFrame:
    """Subtree sums of components that fit a task; a batch has whole components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(f: pd.DataFrame) -> pa.RecordBatch:
            place = pd.Series(np.arange(len(f)), index=pd.MultiIndex.from_arrays([f["owner"], f["depth"]]))
            # a top's parent is in another component or absent
            inner = ((f["owner"] != f["top_owner"]) | (f["depth"] != f["top_depth"])).to_numpy()
            parent = np.full(len(f), -1)
            parent[inner] = place.loc[pd.MultiIndex.from_arrays([f["up"][inner], f["depth"][inner] - 1])].to_numpy()
            sums = decompose(parent, f["size"].to_numpy(), f[["leaf", "saved"]].to_numpy().T)
            return pa.RecordBatch.from_arrays([pa.array(f["owner"].to_numpy()), pa.array(f["depth"].to_numpy()), pa.array(sums[0]),
                                               pa.array(sums[1])], names=["owner", "depth", "n_leaves", "saved_tokens"])
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b.to_pandas())
            if sum(map(len, held)) >= 4 * IN_TASK:
                f = pd.concat(held, ignore_index=True)
                last = (f["top_owner"] == f["top_owner"].iloc[-1]) & (f["top_depth"] == f["top_depth"].iloc[-1])
                if not last.all():
                    yield solve(f[~last].reset_index(drop=True))
                held = [f[last]]
        if held and len(f := pd.concat(held, ignore_index=True)):
            yield solve(f)
    # the root has no "up"; as a top's it is not used
    return state.select("owner", "depth", F.coalesce("up", F.lit(0)).alias("up"), "size", "leaf", "saved", *TOP).repartition(*TOP) \
        .sortWithinPartitions(*TOP).mapInArrow(run, SUMS)


def rollup(tree: DataFrame, paths: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """owner, depth and the subtree sums of ``leaf`` and ``saved`` for every node.

    ``tree``: owner, depth, up (parent's owner), size (nodes in the subtree), leaf, saved; ``paths``: for each owner
    conv_id the owner at each depth and ``above``, the owner one turn less deep."""
    root = tree.where("depth = 0").select("owner", "size").first() or (0, 0)  # without a root there are no nodes
    state = cut(tree.select("owner", "depth", "up", "size", "leaf", "saved", *(F.lit(x).cast("long").alias(n) for x, n in zip(
        (root[0], 0, root[1]), (*TOP, "total")))), "state")
    small, sums = [state.where(F.col("total") <= in_task)], []
    while True:
        big = state.where(F.col("total") > in_task)
        centre = big.where("2 * size > total").groupBy(*TOP).agg(F.min(F.struct("size", "owner", "depth")).alias("c")) \
            .select(*TOP, F.col("c.owner").alias("c_owner"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size"))
        centre = cut(centre, "centroids")
        if centre.isEmpty():
            break
        # the nodes from each centroid to the top of its component
        line = cut(centre.join(paths.select(F.col("conv_id").alias("c_owner"), F.col("depth").alias("i"), F.col("owner").alias("line_owner")), "c_owner")
                   .where("i >= top_depth and i <= c_depth").select(*TOP, "line_owner", F.col("i").alias("line_depth"), "c_size"), "lines")
        inner = big.join(centre.drop("c_size"), TOP)
        # each deeper node's prefix one turn below its component's centroid tells on which side it lies
        look = paths.select(F.col("conv_id").alias("owner"), F.col("depth").alias("look"), F.col("owner").alias("via"), "above")
        inner = inner.withColumn("look", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1)).join(look, ["owner", "look"], "left") \
            .join(line.select(F.col("line_owner").alias("owner"), F.col("line_depth").alias("depth"), F.col("c_size").alias("less")),
                  ["owner", "depth"], "left")
        below = F.coalesce(F.col("above") == F.col("c_owner"), F.lit(False))
        centroid = (F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth"))
        inner = cut(inner.select("owner", "depth", "up", "leaf", "saved", *TOP, below.alias("below"), centroid.alias("centroid"),
                                 (F.col("size") - F.coalesce("less", F.lit(0))).alias("size"),
                                 F.when(below, F.col("via")).otherwise(F.col("top_owner")).alias("new_owner"),
                                 F.when(below, F.col("look")).otherwise(F.col("top_depth")).alias("new_depth")), "split")
        # totals of the components below the centroids and of the centroids, added along the lines
        pieces = inner.where("below or centroid").groupBy(*TOP).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        sums.append(line.join(pieces, TOP).select(F.col("line_owner").alias("owner"), F.col("line_depth").alias("depth"), "n_leaves", "saved_tokens"))
        rest = inner.where("not centroid").select("owner", "depth", "up", "size", "leaf", "saved", F.col("new_owner").alias("top_owner"),
                                                  F.col("new_depth").cast("long").alias("top_depth"))
        state = cut(rest.join(rest.groupBy(*TOP).agg(F.max("size").alias("total")), TOP), "state")
        small.append(state.where(F.col("total") <= in_task))
    out = _in_tasks(_union(small))
    return _union([out, *sums]).groupBy("owner", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def trie(df: DataFrame, max_shared: int = 5, family: int = 100, in_task: int = IN_TASK, chunk: int = CHUNK) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    step, ends = steps(df, max_shared, family)
    nodes = step.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
                                   F.min(F.struct("phi", "plo")).alias("p")).select(*KEY, "owner", "n_convs", "chars", "p.phi", "p.plo")
    root = ends.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *(F.lit(0).cast("long").alias(k) for k in KEY), "owner", "n_convs", *(F.lit(0).cast("long").alias(k) for k in ("chars", "phi", "plo")))
    nodes = cut(nodes.unionByName(root), "nodes")
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("owner").alias("up"))
    edges = cut(nodes.join(parent, ["depth", "phi", "plo"], "left").drop("phi", "plo"), "edges")
    children = edges.where("depth > 0").groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    # the prefixes of the owners, with owners instead of fingerprints; an owner's nodes are the last ones of its path
    owners = edges.groupBy("owner").agg(F.max("depth").alias("last"), F.count("*").alias("own")).withColumnRenamed("owner", "conv_id")
    zero = F.lit(0).cast("long")
    walk = step.select("conv_id", *KEY).unionByName(ends.select("conv_id", *(zero.alias(k) for k in KEY))).join(owners, "conv_id")
    paths = cut(walk.join(edges.select(*KEY, "owner", F.col("up").alias("above")), KEY).select(
        "conv_id", "depth", "owner", "above", F.least(F.col("own"), F.col("last") - F.col("depth") + 1).alias("adds")), "paths")
    sizes = paths.groupBy("owner", "depth").agg(F.sum("adds").alias("size"))
    tree = edges.join(children, ["owner", "depth"], "left").join(sizes, ["owner", "depth"])
    tree = cut(tree.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumns(
        {"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "tree")
    sums = rollup(tree, paths.drop("adds"), in_task)
    out = tree.join(sums, ["owner", "depth"]).join(ends_digest(ends, chunk), KEY, "left")
    return out.select(F.col("owner").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs",
                      "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
