"""Phrase collocations over sorted count streams, per language.

Texts are lower-cased (A-Z), cut at punctuation and line ends into pieces and at blanks into words; phrases do not
cross pieces.  Counting is done in three passes over the whole texts, each a task-local count (words of a few
megabytes of text as numbers, sorted and run-length counted by numpy) and a sum in Spark, so a frequent phrase is one
row a task before the shuffle.  A phrase of at least ``min_count`` occurrences has only parts of at least as many, so
the second pass counts pairs of frequent words and the third triples of frequent pairs.  What is frequent reaches the
tasks as a bitmap of 2^``BITMAP_BITS`` hash slots, of a fixed size whatever the corpus: a slot shared by chance lets a
rare phrase be counted that the final sums then drop, so it costs time but no result.

The counts of words, pairs and triples then form one stream.  In prefix order (w1, w2, w3; shorter first) each phrase
stands behind its beginnings: one lockstep pass over a task's range, holding one word's and one pair's count, gives
the left counts of all cuts and each pair's most frequent extension to the right.  In suffix order (last word first)
the same pass gives the right counts and the extensions to the left.  No lookup table is built.  Ranges of one pair
stay in one task; a word whose phrases lie in several tasks is carried over by one row a task.

Defined results: a null text is empty, a null language ``und``; repeated rows count each time; an empty table gives
no rows; other columns are ignored.  Counts below 10^14 are exact (decimal products of at most 38 digits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Fixed by the definition of a piece: punctuation and line ends.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
CHUNK_BYTES = 4 << 20
BITMAP_BITS = 27
_PIECE_BITS = 19
_BREAK = b"."  # ends a piece, so it is in no word
_SPACE = pa.scalar(b" ", pa.large_binary())
_COUNTS = "lang string, phrase string, n long"


def _letters() -> bytes:
    table = bytearray(range(256))
    for c in PIECE_ENDS:
        table[c] = _BREAK[0]
    for c in range(ord("A"), ord("Z") + 1):
        table[c] += 32
    table[ord("\t")] = ord(" ")
    return bytes(table)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(lang, word numbers, words) of a few megabytes of text each; number -1 ends a piece."""
    table, held, size = _letters(), {}, 0

    def flush():
        for lang, texts in held.items():
            data = (b" " + _BREAK + b" ").join(texts).translate(table).replace(_BREAK, b" " + _BREAK + b" ")
            words = pc.split_pattern(pa.array([data], pa.large_binary()), " ").values.dictionary_encode()
            at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            blank, stop = (pc.index(words.dictionary, pa.scalar(w, pa.large_binary())).as_py() for w in (b"", _BREAK))
            if blank >= 0:
                at = at[at != blank]
            if stop >= 0:
                at[at == stop] = -1
            yield lang, at, words.dictionary
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if text:
                data = text.encode()
                held.setdefault(lang, []).append(data)
                size += len(data)
                if size >= chunk_bytes:
                    yield from flush()
                    held, size = {}, 0
    yield from flush()


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), dtype=np.int64))),
                                       phrases.cast(pa.large_string()).cast(pa.string()), pa.array(counts.astype(np.int64))],
                                      names=["lang", "phrase", "n"])


def _hashes(lang, words) -> np.ndarray:
    """A 64-bit hash of each word with its language (one, or one per word)."""
    def of(x):
        return pd.util.hash_array(np.array([w if isinstance(w, bytes) else w.encode() for w in x], dtype=object), categorize=False)
    own = of([lang])[0] if isinstance(lang, str) else of(lang)
    return of(words) ^ (own * np.uint64(0x9E3779B97F4A7C15)) if len(words) else np.zeros(0, dtype=np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ b >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)


def _slot(h: np.ndarray, bitmap_bits: int) -> np.ndarray:
    return ((h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bitmap_bits)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    s = _slot(h, (8 * len(bits)).bit_length() - 1)
    return (bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(counts: DataFrame, bitmap_bits: int = BITMAP_BITS) -> np.ndarray:
    """The slots of the words or pairs in ``counts`` (lang, phrase), put together by Spark in pieces of 64 KB at most."""
    piece_bits = min(_PIECE_BITS, bitmap_bits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words = list(zip(*(p.split(" ") for p in b.column("phrase").to_pylist())))
                h = [_hashes(b.column("lang").to_pylist(), w) for w in words]
                s = _slot(h[0] if len(h) == 1 else _pair(*h), bitmap_bits).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s >> piece_bits), pa.array(s & ((1 << piece_bits) - 1))], names=["piece", "at"])

    def piece(f: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << piece_bits, dtype=np.uint8)
        bits[f["at"].to_numpy()] = 1
        return pd.DataFrame({"piece": f["piece"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})
    rows = counts.select("lang", "phrase").mapInArrow(slots, "piece long, at long").distinct() \
        .groupBy("piece").applyInPandas(piece, "piece long, bits binary").collect()  # 2^bitmap_bits bits at most
    out, width = np.zeros(1 << (bitmap_bits - 3), dtype=np.uint8), 1 << (piece_bits - 3)
    for r in rows:
        out[r["piece"] * width:(r["piece"] + 1) * width] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _sum(rows: DataFrame, kind: str, least: int = 1) -> DataFrame:
    return cut(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), kind)


def counts(df: DataFrame, min_count: int = 10, lang: str = "lang", text: str = "text", chunk_bytes: int = CHUNK_BYTES,
           bitmap_bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, n) of all words, and of the pairs and triples with at least ``min_count`` occurrences."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, at, dictionary in _chunks(batches, chunk_bytes):
            n = np.bincount(at[at >= 0], minlength=len(dictionary))
            used = np.flatnonzero(n)
            yield _rows(name, dictionary.take(pa.array(used)), n[used])
    one = _sum(texts.mapInArrow(words, _COUNTS), "words")
    held = spark.sparkContext.broadcast(bitmap(one.where(F.col("n") >= min_count), bitmap_bits))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, at, dictionary in _chunks(batches, chunk_bytes):
            frequent = np.append(_has(held.value, _hashes(name, dictionary.to_pylist())), False)[at]  # -1: no word
            here = np.flatnonzero(frequent[:-1] & frequent[1:])
            key, n = np.unique(at[here] * len(dictionary) + at[here + 1], return_counts=True)
            yield _rows(name, pc.binary_join_element_wise(*(dictionary.take(pa.array(i)) for i in np.divmod(key, max(1, len(dictionary)))), _SPACE), n)
    two = _sum(texts.mapInArrow(pairs, _COUNTS), "pairs", min_count)
    held2 = spark.sparkContext.broadcast(bitmap(two, bitmap_bits))

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, at, dictionary in _chunks(batches, chunk_bytes):
            h, size = np.append(_hashes(name, dictionary.to_pylist()), np.uint64(0))[at], max(1, len(dictionary))
            frequent = _has(held2.value, _pair(h[:-1], h[1:])) & (at[:-1] >= 0) & (at[1:] >= 0)
            here = np.flatnonzero(frequent[:-1] & frequent[1:])
            first, of = np.unique(at[here] * size + at[here + 1], return_inverse=True)
            key, n = np.unique(of * size + at[here + 2], return_counts=True)
            pair, c = np.divmod(key, size)
            yield _rows(name, pc.binary_join_element_wise(*(dictionary.take(pa.array(i)) for i in (*np.divmod(first[pair], size), c)), _SPACE), n)
    three = _sum(texts.mapInArrow(triples, _COUNTS), "triples", min_count)
    return one, two, three


def lockstep(stream: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``stream`` (lang, ``keys``, n) with names[0]: the count of the first key, names[1]: of the first two (triples), and
    names[2]: the largest count of a triple that begins with the pair (pairs; 0: none).

    The rows are sorted by lang and ``keys``, nulls first, so each phrase follows its beginnings."""
    order, fields = ["lang", *keys], [f.name for f in stream.schema]
    rest = [f for f in fields if f not in order and f != "n"]
    schema = ", ".join([*(f"{k} string" for k in order), "n long", *(f"{r} long" for r in rest), *(f"{x} long" for x in names), "part int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, one, two, open_pair, most = TaskContext.get().partitionId(), -1, -1, None, 0

        def rows(table: pa.RecordBatch, ext: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> pa.RecordBatch:
            extra = [pa.array(x.astype(np.int64)) for x in (c1, c2, ext)] + [pa.array(np.full(len(ext), part, dtype=np.int32))]
            return pa.RecordBatch.from_arrays([*table.columns, *extra], names=[*table.schema.names, *names, "part"])
        for b in batches:
            if not b.num_rows:
                continue
            n, at = b.column("n").to_numpy(), np.arange(b.num_rows)
            level = 1 + sum((~b.column(k).is_null().to_numpy(zero_copy_only=False)).astype(int) for k in keys[1:])
            word, pair = (np.maximum.accumulate(np.where(level == k, at, -1)) for k in (1, 2))
            c1 = np.where(word >= 0, n[word], one)
            c2 = np.where(level == 3, np.where(pair >= 0, n[pair], two), 0)
            ext, triple = np.zeros(b.num_rows, dtype=np.int64), level == 3
            np.maximum.at(ext, pair[triple & (pair >= 0)], n[triple & (pair >= 0)])
            most = max(most, n[triple & (pair < 0)].max(initial=0))
            short = np.flatnonzero(level < 3)
            if open_pair is not None and len(short):  # no more triples of the pair that was open
                yield rows(open_pair[0], np.array([most]), open_pair[1], open_pair[2])
                open_pair = None
            keep = np.ones(b.num_rows, dtype=bool)
            if len(short) and level[short[-1]] == 2:
                p = short[-1]
                open_pair, most, keep[p] = (b.slice(p, 1), c1[p:p + 1], c2[p:p + 1]), ext[p], False
            if keep.any():
                yield rows(b.filter(pa.array(keep)), ext[keep], c1[keep], c2[keep])
            one = n[word[-1]] if word[-1] >= 0 else one
            two = n[pair[-1]] if pair[-1] >= 0 else two
        if open_pair is not None:
            yield rows(open_pair[0], np.array([most]), open_pair[1], open_pair[2])
    done = cut(stream.select(*order, "n", *rest).repartitionByRange(*order[:3]).sortWithinPartitions(*order).mapInArrow(run, schema), "lockstep")
    last = done.where(F.col(keys[1]).isNull()).groupBy("part").agg(F.max(F.struct("lang", keys[0], "n")).alias("w")).select("part", "w.n")
    ends, carry, n = dict(last.collect()), [], -1  # one row a task
    for part in range(max(ends, default=-1) + 1):
        carry.append((part, n))
        n = ends.get(part, n)
    last_part = done.agg(F.max("part")).first()[0]
    carry += [(part, n) for part in range(len(carry), (last_part if last_part is not None else -1) + 1)]
    carried = F.broadcast(done.sparkSession.createDataFrame(carry, "part int, _before long"))
    return done.join(carried, "part").withColumn(names[0], F.when(F.col(names[0]) < 0, F.col("_before")).otherwise(F.col(names[0]))) \
        .drop("part", "_before")


def collocations(df: DataFrame, min_count: int = 10, top: int = 2000, cover: int = 50, lang: str = "lang", text: str = "text",
                 chunk_bytes: int = CHUNK_BYTES, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two or three words.

    a: occurrences; the score floor(10^6 * a^2 / (l * r)) is that of the lowest cut (the first of ties) into a beginning
    with l and a rest with r occurrences; n: the language's words.  A phrase goes if a longer one that contains it has at
    least ``cover`` percent of its occurrences."""
    one, two, three = counts(df, min_count, lang, text, chunk_bytes, bitmap_bits)
    total = one.groupBy("lang").agg(F.sum("n").alias("words"))

    def words(rows: DataFrame, k: int) -> DataFrame:
        parts = F.split("phrase", " ", -1)
        return rows.select("lang", *((parts[i] if i < k else F.lit(None).cast("string")).alias(f"w{i + 1}") for i in range(3)), "n")
    stream = words(one.where(F.col("n") >= min_count), 1).unionByName(words(two, 2)).unionByName(words(three, 3))
    left = lockstep(stream, ["w1", "w2", "w3"], ["first", "first_two", "right"])
    # suffix order: the last word, the one before, the first of three
    triple, pair = F.col("w3").isNotNull(), F.col("w2").isNotNull()
    turned = left.select("lang", F.coalesce("w3", "w2", "w1").alias("s1"), F.when(triple, F.col("w2")).when(pair, F.col("w1")).alias("s2"),
                         F.when(triple, F.col("w1")).alias("s3"), "n", "first", "first_two", "right")
    both = lockstep(turned, ["s1", "s2", "s3"], ["last", "last_two", "left"]).where("s2 is not null")

    def score(l, r):
        a, l, r = (x.cast("decimal(14,0)") for x in (F.col("n"), l, r))
        return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)
    three_words = F.col("s3").isNotNull()
    cuts = both.withColumns({
        "l1": F.col("first"), "r1": F.when(three_words, F.col("last_two")).otherwise(F.col("last")),
        "l2": F.when(three_words, F.col("first_two")), "r2": F.when(three_words, F.col("last"))})
    cuts = cuts.where(three_words | (100 * F.greatest("left", "right") < cover * F.col("n")))
    cuts = cuts.withColumns({"x1": score(F.col("l1"), F.col("r1")), "x2": score(F.col("l2"), F.col("r2"))})
    second = three_words & (F.col("x2") < F.col("x1"))
    found = cuts.select("lang", F.concat_ws(" ", "s3", "s2", "s1").alias("phrase"), F.col("n").alias("a"),
                        *(F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(n) for c, n in (("l", "l"), ("r", "r"), ("x", "score"))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
