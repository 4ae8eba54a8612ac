"""Ids of a byte-level BPE file of the tokenizers library.

Vocabulary, merges and special tokens are read from the file. The merges are run by tiktoken, which
takes under half the time and gives the same ids where, as in such files, merges are listed by the
id they make; tests compare the two for every code point and for texts of all kinds. A very long
text is cut into windows first, at places where no piece reaches across.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

WINDOW = 256 * 1024     # characters

# The pattern that such files cut texts by; a fixed value.
_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Before a space that something else than white space follows, between letters and digits, and
# before a sign other than an apostrophe.
_GAP = re.compile(r"(?= \S)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
                  r"|(?<=[A-Za-z0-9])(?=[.,;:!?()/-])")


def windows(text: str, size: int = WINDOW) -> list[str]:
    """Parts of a text, of about `size` characters where it can be cut, whose ids behind one another
    are the text's."""
    parts, at = [], 0
    while len(text) - at > size:
        # The last gap in reach, or else the next one.
        last = at
        for gap in _GAP.finditer(text, at + size // 2, at + size):
            last = gap.start()
        if last == at:
            gap = _GAP.search(text, at + size)
            if gap is None:
                break
            last = gap.start()
        parts.append(text[at:last])
        at = last
    parts.append(text[at:])
    return parts


def letter_bytes() -> dict[str, int]:
    """The byte that each letter of such files stands for: printable ones for themselves, those from
    256 on for the others, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes batches of texts by the file at `path`."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cutter, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or spec["post_processor"] or cutter.get("type") != "ByteLevel" \
                or not cutter["use_regex"] or cutter["add_prefix_space"] or model["type"] != "BPE" \
                or model.get("ignore_merges"):
            raise ValueError("a byte-level vocabulary that cuts texts in the known way is needed")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = letter_bytes()
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items()
                 if token not in special}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)]
                for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("merges must be listed by the id they make")
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=_PATTERN,
                                          mergeable_ranks=ranks, special_tokens=special)
        self.dtype = np.dtype("<u2" if self.encoding.max_token_value < 1 << 16 else "<u4")

    def encode(self, texts: pa.StringArray, end_id: int | None = None
               ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, each text's followed by `end_id` if given, and
        where each text's begin and the last one's end."""
        end = [] if end_id is None else [np.array([end_id], np.uint32)]
        found, sizes = [np.zeros(0, np.uint32)], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts.to_pylist()):
            parts = [self.encoding.encode_to_numpy(part, allowed_special="all")
                     for part in (windows(text) if len(text) > WINDOW else (text,))] + end
            found += parts
            sizes[i + 1] = sum(map(len, parts))
        return np.concatenate(found).astype(self.dtype), np.cumsum(sizes)


_made: dict[tuple, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker. Workers are reused."""
    key = (path, os.getpid())
    if key not in _made:
        _made[key] = Encoder(path)
    return _made[key]
