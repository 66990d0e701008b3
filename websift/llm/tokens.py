"""Token ids of whole texts with a public byte-level BPE vocabulary, inside tasks.

The vocabulary file (JSON: token -> id, ids in merge order) and the pre-tokenizer's pattern are parameters.  The ids
are those that the ``tokenizers`` library gives with this file (tests compare them); they are computed with
``tiktoken`` from the same vocabulary, which takes a quarter of the time.  Its pattern matcher gives up, with an
error, on runs of several hundred thousand blanks, so such a text is encoded by ``tokenizers`` itself: the same ids by
the slower way.
"""

from __future__ import annotations

import json

END_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 stands for itself, others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


class Encoder:
    """``encode(text)`` gives the ids of a text (null: none) as little-endian bytes of ``dtype``.  The strings of the
    file's added tokens in a text get their ids with ``special``, as in the library's default setting; else they are
    ordinary text (the library's ``encode_special_tokens``)."""

    def __init__(self, vocabulary: str | None = None, dtype: str = "<u4", pattern: str | None = None, special: bool = False):
        import tiktoken
        with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.dtype, self.path, self.special, self.slow = dtype, vocabulary or default_vocabulary(), special, None
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=pattern or default_pattern(), mergeable_ranks=ranks,
                                     special_tokens=added if special else {})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            ids = self.bpe.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError as ex:
            if "stack size" not in str(ex):
                raise
            return self._by_library(text)
        return ids.astype(self.dtype).tobytes()

    def _by_library(self, text: str) -> bytes:
        import numpy as np
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = not self.special
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
