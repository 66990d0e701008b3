"""Packing documents into fixed-length sequences: first-fit decreasing in randomised groups.

A document's ids (an end id after them) are cut into pieces of at most ``SEQ_LEN``.  Pieces are dealt to groups by a
hash of their place in the written piece table, about ``GROUP_PIECES`` to a group, so groups are random, even and
bounded whatever copies, sources or lengths there are.  Inside a group, pieces go in decreasing length to the first
sequence with room; a tournament tree over the sequences' free room finds it in logarithmic time.  Groups are packed
independently, with no shuffle of texts: only piece descriptions (a few numbers each) move.

Defined results: a null text counts as empty and has one piece, the end id; a text longer than a sequence fills whole
sequences and leaves its tail to be packed; repeated rows are packed as often as they occur; null doc_ids stay null;
an empty table gives no pieces; other columns are ignored; a special token's string in a text gets the token's id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import END_ID, Encoder

SEQ_LEN = 2048
GROUP_PIECES = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _rid long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(df: DataFrame, seq_len: int = SEQ_LEN, vocabulary: str | None = None, doc_id: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; ``_rid`` numbers the rows of the table; ``with_ids`` adds the ids (little-endian uint32)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        encoder, n = Encoder(vocabulary, special=True), TaskContext.get().partitionId() << 40
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                ids = encoder.encode(t) + end
                total = len(ids) // 4
                for at in range(0, total, seq_len):
                    part = ids[4 * at:4 * (at + seq_len)]
                    rows.append((d, at, len(part) // 4, zlib.crc32(part), total, n, *([part] if with_ids else [])))
                    n += 1
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rid", *(["ids"] if with_ids else [])])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInPandas(run, PIECES + (", ids binary" if with_ids else ""))


def first_fit_decreasing(lengths, capacity: int):
    """(bin, offset) of each item: by decreasing length, each into the first bin with room."""
    n = len(lengths)
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [capacity] * (2 * leaves)  # room[1] is the root; a node holds the largest room below it
    bins, offsets = [0] * n, [0] * n
    for k in sorted(range(n), key=lambda i: -lengths[i]):
        size, at = lengths[k], 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[k], offsets[k] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
    return bins, offsets


def pack(df: DataFrame, seq_len: int = SEQ_LEN, group_pieces: int = GROUP_PIECES, seed: int = 7, **options) -> DataFrame:
    """Pieces of all documents with sequence_id and offset (gapless from 0 in each sequence)."""
    table = cut(pieces(df, seq_len, **options), "pieces")
    groups = max(1, -(-table.count() // group_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rid", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), seq_len)
        pdf["sequence_id"] = [(int(pdf["_group"].iloc[0]) << 32) + b for b in bins]
        pdf["offset"] = offsets
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    group = F.pmod(F.xxhash64(F.lit(seed), F.col("_rid")), F.lit(groups))
    return table.withColumn("_group", group).groupBy("_group").applyInPandas(run, PACKED)
