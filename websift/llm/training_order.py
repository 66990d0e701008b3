"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride binary shards.

1. Each task tokenizes its documents, joins their ids (an end id after each document) and cuts them into sequences of
   ``SEQ_LEN`` ids; only a task's last sequence is padded.  Sequences are written in compressed runs.
2. With the number of sequences known, sequence k gets slot P(k): a keyed Feistel permutation of the next power of
   four, walked along its cycle until the slot is in range.  No sort and no random numbers: any slot can be computed
   from the key, and the sequence of a slot by the inverse.
3. Shards hold ``SHARD_SEQUENCES`` consecutive slots.  Each task sends its sequences compressed by shard; a range
   partition of shards is put together in one buffer per shard and written as a file of fixed stride: slot s is at byte
   (s mod SHARD_SEQUENCES) * stride of shard s // SHARD_SEQUENCES, so a reader goes on from any slot by one seek.

What one task holds is bounded by ``FLUSH_SEQUENCES`` sequences or one shard, whatever lengths, copies or sources
there are.  The driver sees one count per task.  Files carry the task attempt in their names and the table names the
files of the attempts that ended well.

Defined results: a null text counts as empty and gives its end id alone; repeated rows are written as often as they
occur; null doc_ids stay null in the lists of documents; texts longer than a sequence go on in the next; an empty
table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_folder, runs
from .shingles import mix
from .tokens import Encoder

SEQ_LEN = 2048
SHARD_SEQUENCES = 4096
FLUSH_SEQUENCES = 8192
RUN_SEQUENCES = 256
DTYPE = "<u2"  # ids of a vocabulary of fewer than 65,536; "<u4" for larger ones
END_ID = PAD_ID = 50256  # marks ends alone: its string in a text is encoded as ordinary text
ROUNDS = 6
DEFAULT_KEY = "websift-order"
LEVEL = 3


def _round_keys(key: str) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(f"{key}|{r}".encode(), digest_size=8).digest(), "big") for r in range(ROUNDS)]


def permute(k: np.ndarray, n: int, key: str = DEFAULT_KEY, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0 .. n - 1 by a balanced Feistel network with cycle-walking."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [np.uint64(x) for x in _round_keys(key)]
    out = np.asarray(k).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> bits, out[todo] & mask
        for x in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ (mix(a + x) & mask), a
            else:
                a, b = b, a ^ (mix(b + x) & mask)
        out[todo] = (a << bits) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _sequences(df: DataFrame, seq_len: int, vocabulary: str | None, dtype: str) -> DataFrame:
    """Runs of sequences: task, first (number of the first in the task), n, ids (compressed), tokens and docs of each."""
    width = np.dtype(dtype).itemsize
    stride = seq_len * width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        encoder, packer = Encoder(vocabulary, dtype, special=False), zstandard.ZstdCompressor(level=LEVEL)
        end = np.array([END_ID], dtype=dtype).tobytes()
        task, first = TaskContext.get().partitionId(), 0
        buf, inside = bytearray(), []  # ids not yet written; (doc_id, first byte) of the documents in them
        tokens, docs = [], []

        def rows(upto: int, used: int) -> tuple:
            """Sequences of the first ``upto`` bytes, of which ``used`` are ids of documents."""
            n = upto // stride
            lists = [[] for _ in range(n)]
            for (d, at), (_, after) in zip(inside, [*inside[1:], (None, used)]):
                for s in range(at // stride, min(n, -(-after // stride))):
                    lists[s].append(d)
            sizes = [min(stride, used - s * stride) // width for s in range(n)]
            return task, first, n, packer.compress(bytes(buf[:upto])), sizes, lists

        columns = ["task", "first", "n", "ids", "tokens", "docs"]
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["text"]):
                inside.append((None if pd.isna(d) else int(d), len(buf)))
                buf += encoder.encode(t) + end
                if len(buf) >= RUN_SEQUENCES * stride:
                    upto = len(buf) // stride * stride
                    out.append(rows(upto, len(buf)))
                    first += upto // stride
                    last = inside[-1]
                    inside = [(last[0], 0)] if len(buf) > upto else []
                    del buf[:upto]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if buf:
            used = len(buf)
            buf += np.full(-used % stride // width, PAD_ID, dtype=dtype).tobytes()
            yield pd.DataFrame([rows(len(buf), used)], columns=columns)
    return df.mapInPandas(run, "task long, first long, n int, ids binary, tokens array<int>, docs array<array<long>>")


def _by_shard(table: DataFrame, base: dict[int, int], total: int, key: str, stride: int, shard_sequences: int) -> DataFrame:
    """(shard, slots, ids, tokens, docs): what a task holds for a shard, in slot order."""
    def flush(slots, data, tokens, docs):
        import zstandard
        packer = zstandard.ZstdCompressor(level=LEVEL)
        slots, rows = np.concatenate(slots), np.concatenate(data)
        order = np.argsort(slots)
        shard = slots[order] // shard_sequences
        for part in np.split(order, np.flatnonzero(np.diff(shard)) + 1):
            yield (int(slots[part[0]] // shard_sequences), slots[part].tolist(), packer.compress(rows[part].tobytes()),
                   [tokens[i] for i in part], [docs[i] for i in part])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        names = ["shard", "slots", "ids", "tokens", "docs"]
        slots, data, tokens, docs, held = [], [], [], [], 0
        for b in batches:
            for task, first, n, ids, size, lists in b.itertuples(index=False):
                raw = zstandard.ZstdDecompressor().decompress(ids, max_output_size=n * stride)
                data.append(np.frombuffer(raw, dtype=np.uint8).reshape(n, stride))
                slots.append(permute(base[task] + first + np.arange(n), total, key))
                tokens += list(size)
                docs += [list(x) for x in lists]
                held += n
                if held >= FLUSH_SEQUENCES:
                    yield pd.DataFrame(list(flush(slots, data, tokens, docs)), columns=names)
                    slots, data, tokens, docs, held = [], [], [], [], 0
        if held:
            yield pd.DataFrame(list(flush(slots, data, tokens, docs)), columns=names)
    return table.mapInPandas(run, "shard long, slots array<long>, ids binary, tokens array<int>, docs array<array<long>>")


def _write(parts: DataFrame, folder: str, total: int, stride: int, shard_sequences: int) -> DataFrame:
    """Write each shard as one file; one row per sequence: slot, shard, file, n_tokens, doc_ids."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyarrow import fs as pafs
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for g in runs(batches, ["shard"]):
            shard = int(g["shard"].iloc[0])
            low = shard * shard_sequences
            n = min(shard_sequences, total - low)
            buf, tokens, docs = np.zeros((n, stride), dtype=np.uint8), [0] * n, [None] * n
            filled = 0
            for slots, ids, size, lists in zip(g["slots"], g["ids"], g["tokens"], g["docs"]):
                raw = zstandard.ZstdDecompressor().decompress(ids, max_output_size=len(slots) * stride)
                buf[np.asarray(slots) - low] = np.frombuffer(raw, dtype=np.uint8).reshape(len(slots), stride)
                for s, t, d in zip(slots, size, lists):
                    tokens[s - low], docs[s - low] = t, list(d)
                filled += len(slots)
            if filled != n:
                raise ValueError(f"shard {shard} got {filled} of {n} sequences")
            name = f"shard-{shard:08d}-{TaskContext.get().taskAttemptId()}.bin"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(buf)
            yield pd.DataFrame({"slot": np.arange(low, low + n), "shard": shard, "file": name, "n_tokens": tokens, "doc_ids": docs})
    return parts.mapInPandas(run, "slot long, shard long, file string, n_tokens long, doc_ids array<long>")


def materialise(df: DataFrame, folder: str, seq_len: int = SEQ_LEN, key: str = DEFAULT_KEY, vocabulary: str | None = None,
                dtype: str = DTYPE, shard_sequences: int = SHARD_SEQUENCES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards to ``folder``; one row per sequence: slot, shard, file, n_tokens, doc_ids."""
    stride = seq_len * np.dtype(dtype).itemsize
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = cut(_sequences(docs, seq_len, vocabulary, dtype), "sequences")
    counts = sorted((r["task"], r["n"]) for r in table.groupBy("task").agg(F.sum("n").alias("n")).collect())  # one per task
    base, total = {}, 0
    for task, n in counts:
        base[task], total = total, total + n
    parts = _by_shard(table, base, total, key, stride, shard_sequences)
    shards = max(1, -(-total // shard_sequences))
    # one shard is one task's work: the range partitions are cut between shards
    dealt = parts.repartitionByRange(shards, "shard").sortWithinPartitions("shard")
    return cut(_write(dealt, folder, total, stride, shard_sequences), "slots")


def read_sequences(slots: DataFrame, folder: str, seq_len: int = SEQ_LEN, dtype: str = DTYPE, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """``slots`` with ids_crc32 and byte_offset, read from the shards by seeking to each slot's place."""
    stride = seq_len * np.dtype(dtype).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            crc = np.zeros(len(b), dtype=np.int64)
            for name, g in b.groupby("file", sort=False):
                with fs.open_input_file(f"{base}/{name}") as f:
                    for i, slot, n in zip(b.index.get_indexer(g.index), g["slot"], g["n_tokens"]):
                        f.seek(slot % shard_sequences * stride)
                        crc[i] = zlib.crc32(f.read(n * np.dtype(dtype).itemsize))
            yield b.assign(byte_offset=b["slot"] % shard_sequences * stride, ids_crc32=crc)
    return slots.mapInPandas(run, "slot long, shard long, file string, n_tokens long, doc_ids array<long>, byte_offset long, ids_crc32 long")


def order(df: DataFrame, **options) -> DataFrame:
    """Write and read back: slot, shard, byte_offset, n_tokens, ids_crc32 and doc_ids of every sequence."""
    folder = new_folder(df.sparkSession, "training-order")
    out = read_sequences(materialise(df, folder, **options), folder)
    return out.select("slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids")
