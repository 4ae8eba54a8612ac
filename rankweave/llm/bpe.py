"""BPE ids by the tokenizers library, with every distinct piece encoded once per worker.

The vocabulary file given by its path parts texts at white space and between letters, digits and
signs before any merge, so a text's ids are those of its pieces behind one another. Texts of Latin
letters, ASCII digits and signs are cut into such pieces here (lowered, as the file does); of other
texts whole words go to the library. The file's merges are run on the pieces by tiktoken, which gives
the same ids: a byte that no piece has stands for the end of a word, which merges with the last
letter before all else, and merges are listed by the id they make. Where decoded forms are asked for
as well, both are looked up in a table of bounded size, as the library's words always are.

A very long text is worked on window by window, cut at white space. A word longer than a window is
cut beside digits and before signs that follow a letter or digit, where the file parts it too; only
a longer run of letters reaches the library in one piece.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .byte_bpe import letter_bytes


# Entries a worker keeps before it starts again, and their bytes; bounds memory, not results.
KEPT = 400_000
KEPT_BYTES = 32 * 1024 * 1024
# Bytes of text worked on at a time.
WINDOW = 1024 * 1024

# Characters that may stand in a text that is cut here: no ' (contractions), no < (special tokens),
# and of letters beyond ASCII those that Unicode normalization leaves as they are.
_PLAIN = bytes(x for x in range(9, 127) if x not in b"'<" and (x < 14 or x > 31))
_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
# Where a word may be cut: no merge reaches across, and no special token or contraction is split.
_GAP = re.compile(r"(?=[0-9])|(?<=[0-9])(?=[^\W\d_])|(?<=[^\W_])(?=[.,;:!?()/。，、！？；：])")
_WHITE = re.compile(rb"[ \t\n\x0b\x0c\r]")

# What the cutting relies on; fixed values of the vocabulary file.
_STEPS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END_MARK = "</w>"
_END = b"\x01"   # stands for it


def windows(raw: bytes, size: int = WINDOW) -> list[bytes]:
    """Parts of a text of about `size` bytes at most whose ids behind one another are the text's."""
    parts, at = [], 0
    while len(raw) - at > size:
        end = max(raw.rfind(mark, at + 1, at + size) for mark in (b" ", b"\n", b"\t"))
        if end > at:
            parts.append(raw[at:end])
        else:
            white = _WHITE.search(raw, at + 1)
            end = white.start() if white else len(raw)
            parts += _word_parts(raw[at:end].decode(), size)
        at = end
    parts.append(raw[at:])
    return parts


def _word_parts(word: str, size: int) -> list[bytes]:
    parts, at, last = [], 0, 0
    for gap in _GAP.finditer(word):
        if gap.start() - at > size // 4 and last > at:  # four bytes a character at most
            parts.append(word[at:last].encode())
            at = last
        last = gap.start()
    if last > at and len(word) - at > size // 4:
        parts.append(word[at:last].encode())
        at = last
    return [*parts, word[at:].encode()]


def is_plain(raw: bytes) -> bool:
    """Whether a text is cut here."""
    rest = raw.translate(None, _PLAIN)
    return not rest or _LATIN.fullmatch(rest) is not None


class Pieces:
    """Ids, and if asked for decoded forms, of pieces and words."""

    def __init__(self, path: str, spelled: bool = False, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        spec = json.loads(self.full.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex")
                  for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        model = spec["model"]
        made = [model["vocab"]["".join(m)] for m in model["merges"]]
        if steps != _STEPS or splits[:1] != [_PATTERN] or made != sorted(made) \
                or model["end_of_word_suffix"] != _END_MARK:
            raise ValueError("a vocabulary that splits texts in the known way is needed")
        special = {t["content"] for t in spec["added_tokens"]}
        byte_of, ranks = letter_bytes(), {}
        for token, i in model["vocab"].items():
            if token not in special:
                letters = token.removesuffix(_END_MARK)
                ranks[bytes(map(byte_of.__getitem__, letters))
                      + (_END if letters != token else b"")] = i
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks,
                                        special_tokens={})
        del spec, model, made
        size = self.full.get_vocab_size(with_added_tokens=True)
        self.tokens = [(self.full.id_to_token(i) or "").encode() for i in range(size)] \
            if spelled else []
        self.spelled, self.kept = spelled, kept
        # Pieces are strings, whole words are bytes, so one table holds both.
        self.ids: dict[str | bytes, bytes] = {}
        self.texts: dict[str | bytes, bytes] = {}
        self.held = 0

    def cut(self, raw: bytes) -> list[str] | list[bytes]:
        if not is_plain(raw):
            return raw.split()
        return _PIECE.findall(raw.decode().lower())

    def merged(self, raw: bytes) -> bytes:
        """Ids of a plain text, without the table."""
        pieces = _PIECE.findall(raw.decode().lower())
        text = "\x01".join([*pieces, ""])
        return self.merges.encode_to_numpy(text).astype("<u4", copy=False).tobytes()

    def learn(self, keys: set[str | bytes]) -> None:
        new = [k for k in keys if k not in self.ids]
        if len(self.ids) + len(new) > self.kept or self.held > KEPT_BYTES:
            self.ids.clear()
            self.texts.clear()
            self.held = 0
            new = list(keys)
        merge = self.merges._core_bpe.encode_single_piece
        cut = [k for k in new if isinstance(k, str)]
        self._keep(cut, (merge(k.encode() + _END) for k in cut))
        words = [k for k in new if isinstance(k, bytes)]
        if words:
            found = self.full.encode_batch_fast([w.decode() for w in words],
                                                add_special_tokens=False)
            self._keep(words, (e.ids for e in found))

    def _keep(self, keys, ids) -> None:
        tokens = self.tokens
        for key, found in zip(keys, ids):
            self.ids[key] = array("I", found).tobytes()
            self.held += len(key) + 4 * len(found)
            if self.spelled:
                self.texts[key] = b" ".join([tokens[i] for i in found])

    def encode(self, raws: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text, as little-endian unsigned 32-bit integers behind one another, and the
        decoded texts (tokens with spaces between, as the library decodes for such a file)."""
        ids: list[list[bytes]] = [[] for _ in raws]
        spelled: list[list[bytes]] = [[] for _ in raws]
        held, size = [], 0

        def flush() -> None:
            cuts = [self.cut(part) for _, part in held]
            wanted: set = set()
            for keys in cuts:
                wanted.update(keys)
            self.learn(wanted)
            for (owner, _), keys in zip(held, cuts):
                ids[owner].append(b"".join(map(self.ids.__getitem__, keys)))
                if self.spelled:
                    spelled[owner].append(
                        b" ".join(filter(None, map(self.texts.__getitem__, keys))))

        for owner, raw in enumerate(raws):
            for part in windows(raw) if len(raw) > WINDOW else (raw,):
                if not self.spelled and is_plain(part):
                    # Parts for the table that stand before it come first.
                    if held and held[-1][0] == owner:
                        flush()
                        held, size = [], 0
                    ids[owner].append(self.merged(part))
                    continue
                held.append((owner, part))
                size += len(part)
                if size >= WINDOW:
                    flush()
                    held, size = [], 0
        flush()
        return ([b"".join(x) for x in ids],
                [b" ".join(filter(None, x)) for x in spelled] if self.spelled else [])


_made: dict[tuple, Pieces] = {}


def pieces(path: str, spelled: bool = False) -> Pieces:
    """The table of this worker. Workers are reused, so later tasks find it filled."""
    key = (path, spelled, os.getpid())
    if key not in _made:
        _made[key] = Pieces(path, spelled)
    return _made[key]
