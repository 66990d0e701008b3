"""Chat formatting with loss masks aligned by offsets.

A conversation's turns are rendered one after the other, each as ``[INST]`` role ``[/INST]`` text ``</s>``.  The
template's control strings (and the vocabulary file's own added tokens) are single tokens.  Where one of them occurs
in a role or a text, a backslash after its first character keeps it ordinary text; a string that already has
backslashes there gets one more, so taking one away restores every text exactly.

The rendered text is encoded once, with the character offsets of its tokens.  The spans of the texts of the roles to
be learnt and the token offsets are both sorted, so a binary search per token finds the first span that ends after the
token's start, and the token is in the loss if that span begins before the token's end.  Control tokens split the text
before the vocabulary's merges apply, so no token lies across a span's border.

Tasks stream the rows in conversation order (see ``turns``) and render at most ``PART_CHARS`` characters at once, at
least one turn: a conversation is one part unless it is longer or lies across the border of two tasks.  Parts end at
turns, that is at a control token, so the parts' ids put together are those of the whole conversation (a test compares
them).  Memory is bounded by a part, the longest turn and a batch of rows.  ``read_back`` needs the ids and masks
alone: it splits at control tokens, decodes and unescapes; a digest is sequential, so the parts of one conversation
stream through one task, in order, with a hash's state in memory.

Defined results: a null role or text is empty; rows without conv_id are one conversation with a null id; null turns
come first and ties follow the order of ``turns``; repeated rows are turns each; an empty text has no token; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import _byte_letters, default_vocabulary
from .turns import in_order, turns

PART_CHARS = 1 << 20
FORMATTED = "conv_id long, part long, formatted string, input_ids array<int>, loss_mask binary"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """Control strings around a turn's role and text, and the roles whose texts are learnt."""
    begin: str = "[INST]"
    role_end: str = "[/INST]"
    end: str = "</s>"
    learnt: tuple[str, ...] = ("assistant",)


class Format:
    """A template with a vocabulary: escaping, rendering, encoding with masks, and the way back."""

    def __init__(self, template: Template = Template(), vocabulary: str | None = None):
        from tokenizers import AddedToken, Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        path = vocabulary or default_vocabulary()
        self.template, self.tokenizer = template, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        own = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        marks = (template.begin, template.role_end, template.end)
        self.tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in marks])
        self.begin, self.role_end, self.end = (self.tokenizer.token_to_id(m) for m in marks)
        strings = sorted({*marks, *own}, key=lambda s: (-len(s), s))
        held = "|".join(f"{re.escape(s[0])}(\\\\*){re.escape(s[1:])}" for s in strings)
        self.plain, self.escaped = re.compile(held), re.compile(held.replace("\\\\*", "\\\\+"))
        letters = _byte_letters()
        self.bytes = {i: t.encode() if t in own else bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.bytes |= {i: s.encode() for s, i in own.items()}
        self.bytes |= {self.tokenizer.token_to_id(m): m.encode() for m in marks}
        self.control = np.array(sorted([self.begin, self.role_end, self.end]))

    def escape(self, text: str) -> str:
        return self.plain.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, rows: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text of (role, text) rows and the spans of its learnt texts."""
        t, out, at, spans = self.template, [], 0, []
        for role, text in rows:
            head, body = t.begin + self.escape(role) + t.role_end, self.escape(text)
            at += len(head)
            if role in t.learnt and body:
                spans.append((at, at + len(body)))
            out += [head, body, t.end]
            at += len(body) + len(t.end)
        return "".join(out), spans

    def encode(self, formatted: list[str], spans: list[list[tuple[int, int]]]) -> list[tuple[np.ndarray, bytes]]:
        """(ids, loss mask with a byte per token) of each text."""
        out = []
        for enc, own in zip(self.tokenizer.encode_batch(formatted, add_special_tokens=False), spans):
            offsets = np.array(enc.offsets, dtype=np.int64).reshape(-1, 2)
            out.append((np.array(enc.ids, dtype=np.int32), mask(offsets, own).astype(np.uint8).tobytes()))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()

    def read(self, ids: np.ndarray, loss: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
        """(role, text, text under the mask, formatted characters) of each turn."""
        cuts = np.flatnonzero(np.isin(ids, self.control)).tolist()
        marks = len(self.template.begin) + len(self.template.role_end) + len(self.template.end)
        if len(cuts) % 3 or ids[cuts[::3]].tolist() != [self.begin] * (len(cuts) // 3):
            raise ValueError("a part that isn't whole turns")
        for a, b, c in zip(cuts[::3], cuts[1::3], cuts[2::3]):
            role, text = self.decode(ids[a + 1:b]), self.decode(ids[b + 1:c])
            under = self.decode(ids[a:c + 1][loss[a:c + 1] != 0])
            yield self.unescape(role), self.unescape(text), self.unescape(under), marks + len(role) + len(text)


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token [start, end) meets one of the sorted, disjoint spans."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    begins, ends = np.array(spans, dtype=np.int64).T
    k = np.searchsorted(ends, offsets[:, 0], side="right")  # the first span that ends after the token's start
    return (k < len(ends)) & (begins[np.minimum(k, len(ends) - 1)] < offsets[:, 1])


def format_chat(df: DataFrame, template: Template = Template(), vocabulary: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted parts of all conversations with token ids and loss mask; (conv_id, part) is their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, base = Format(template, vocabulary), TaskContext.get().partitionId() << 33
        n, conv, rows, chars, ready = 0, None, [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal n
            shown = [form.render(r) for _, r in ready]
            codes = form.encode([s for s, _ in shown], [s for _, s in shown])
            out = pa.RecordBatch.from_arrays([
                pa.array([c for c, _ in ready], pa.int64()), pa.array(range(base + n, base + n + len(ready)), pa.int64()),
                pa.array([s for s, _ in shown], pa.string()), pa.array([i for i, _ in codes], pa.list_(pa.int32())),
                pa.array([m for _, m in codes], pa.binary())], names=["conv_id", "part", "formatted", "input_ids", "loss_mask"])
            n += len(ready)
            ready.clear()
            return out

        waiting = 0
        for b in batches:
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if rows and (c != conv or chars + len(role) + len(text) > part_chars):
                    ready.append((conv, rows))
                    waiting, rows, chars = waiting + chars, [], 0
                    if waiting > part_chars or len(ready) >= 256:
                        yield flush()
                        waiting = 0
                conv = c
                rows.append((role, text))
                chars += len(role) + len(text)
        if rows:
            ready.append((conv, rows))
        if ready:
            yield flush()
    return in_order(turns(df)).select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(parts: DataFrame, template: Template = Template(), vocabulary: str | None = None) -> DataFrame:
    """Turn and loss digests of each conversation, from the ids and masks of its parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, done, conv, state = Format(template, vocabulary), [], None, None

        def close():
            n, seen, chars, loss, total = state
            done.append((conv, n, seen.hexdigest(), chars, loss.hexdigest(), total))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])))
        for b in batches:
            for c, ids, loss in zip(b.column("conv_id").to_pylist(), b.column("input_ids"), b.column("loss_mask")):
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, under, chars in form.read(ids.values.to_numpy(), np.frombuffer(loss.as_py(), dtype=np.uint8)):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(under)
                    state[3].update(under.encode())
                    state[4] += chars
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
                done.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
    return parts.select("conv_id", "part", "input_ids", "loss_mask").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "part").mapInArrow(run, DIGESTS)


def probe(df: DataFrame, conv_id: int = -7) -> DataFrame:
    """The conversation whose turns consist of control strings, as rows (conv_id, turn, role, text)."""
    said = "</s>[INST] ok [/INST]"
    return df.sparkSession.createDataFrame([(conv_id, 0, "user", said), (conv_id, 1, "assistant", said)],
                                           "conv_id long, turn long, role string, text string")


def digests(df: DataFrame) -> DataFrame:
    """Formats all conversations and the probe, writes the parts, and reads them back."""
    rows = turns(df).select("conv_id", "turn", "role", "text")
    return read_back(cut(format_chat(rows.unionByName(probe(df))), "chat"))
