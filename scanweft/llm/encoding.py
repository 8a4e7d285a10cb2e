"""Encoding with the tokenizers library, each distinct stretch once.

Both kinds of tokenizer split text before any merge, and no split ever spans the place before a single
space between two non-spaces. So a text is cut at such spaces, a worker remembers the ids of every piece,
and the ids of a text are the joined ids of its pieces. A new piece is split by the tokenizer's own
pattern, and its words are merged by the library's model. Pieces with characters beyond Latin-1, and
texts in which spaces meet other white space, go through the library as a whole, as does every text of a
tokenizer of another kind. A text that holds an added token (such as <|endoftext|>) goes through the library
too, so that its ids are those of the tokenizer as it is loaded. Workers load the tokenizer from its file; nothing is sent to them.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

#: Entries of each kind that a worker remembers, so memory is bounded.
REMEMBERED = 500_000
#: Characters that are their own NFC form and whose lower case depends on no neighbour.
PLAIN = re.compile(r"[\t\n\x20-\x7eÀ-ÿ]*")
#: White space other than the space and the line feed: of ASCII, and beyond.
RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
RARE_WIDE = "".join(chr(c) for c in range(0x80, 0x10000) if chr(c).isspace())
#: The split of byte-level tokenizers that name none.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[tuple[str, str], Encoder] = {}


def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in visible else chr(next(hidden)) for b in range(256))


class _Pieces(dict):
    """piece -> its ids as bytes, filled on demand until full. After many misses it forgets all, so that it follows
    a change of language."""

    def __init__(self, make):
        super().__init__()
        self.make, self.misses = make, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(self) < REMEMBERED:
            self[piece] = ids
        else:
            self.misses += 1
            if self.misses > 4 * REMEMBERED:
                self.clear()
                self.misses = 0
        return ids


class Encoder:
    """Ids of texts as little-endian bytes of `dtype`, 16 bits only where every id of the vocabulary has room.

    special: whether special tokens in a text get their own ids, the library's default, or are encoded as plain text.
    """

    def __init__(self, path: str, dtype: str = "<u4", special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        if np.dtype(dtype).itemsize == 2 and max(self.library.get_vocab().values(), default=0) >= 1 << 16:
            dtype = "<u4"
        self.dtype, self.code, self.model, self.table = np.dtype(dtype), {2: "H", 4: "I"}[np.dtype(dtype).itemsize], self.library.model, {c: "".join(byte_letters()[b] for b in chr(c).encode()) for c in range(256)}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, split = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = [s["type"] for s in (normal or {}).get("normalizers", [])]
        stages = split.get("pretokenizers", [])
        self.kind = ""
        if normal is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
            self.kind, self.split = "spaced", regex.compile(BYTE_LEVEL)
        elif steps == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in stages] == ["Split", "ByteLevel"] and stages[0]["behavior"] == "Removed" and stages[0]["invert"] and not stages[1]["use_regex"] and not stages[1]["add_prefix_space"]:
            self.kind, self.split = "unspaced", regex.compile(stages[0]["pattern"]["Regex"])
        own = [t for t in spec.get("added_tokens") or [] if special or not t["special"]]
        if normal is not None and any(t["normalized"] for t in own):  # these can be met in other writings
            self.kind = ""
        self.added = tuple(t["content"] for t in own)
        self.words = _Pieces(self._merge)
        self.first = _Pieces(lambda p: self._piece(p, "", self.first))
        self.later = self.first if self.kind == "unspaced" else _Pieces(lambda p: self._piece(p, " ", self.later))
        self.odd = re.compile(r"(?:^|\s) | (?:\s|$)")

    def _merge(self, word: str) -> bytes:
        if word.isascii() and (word.isalpha() or word[1:].isalpha() and word[0] == " "):
            letters = word if word[0] != " " else self.table[32] + word[1:]
        else:
            letters = word.translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: str, lead: str, alike: _Pieces) -> bytes:
        """The ids of a piece with `lead` before it, new to the memory `alike`."""
        if not (piece.isascii() or PLAIN.fullmatch(piece)):
            return self.whole(lead + piece)
        low = piece.lower() if self.kind == "unspaced" else piece
        if low[-1:] in (",", ".") and low[:-1].isalpha():  # as the patterns split it
            return alike[low[:-1]] + self.words[low[-1]]
        if low.isalpha():
            return self._merge(lead + low)
        found = self.split.findall(lead + low)
        if len(found) == 1:
            return self._merge(found[0])  # the piece itself is remembered
        return b"".join([self.words[w] for w in found])

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def text(self, text: str) -> bytes:
        for token in self.added:
            if token in text:
                return self.whole(text)
        if self.kind == "unspaced":
            return b"".join(map(self.first.__getitem__, text.split(" ")))
        if self.kind == "spaced" and not self._spaces_meet(text):
            first, *rest = text.split(" ")
            return self.first[first] + b"".join(map(self.later.__getitem__, rest))
        return self.whole(text)

    def _spaces_meet(self, text: str) -> bool:
        """Whether a space stands at an end or beside white space; a quick look settles most texts."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return True
        if any(c in text for c in (RARE if text.isascii() else RARE + RARE_WIDE)):
            return self.odd.search(text) is not None
        return " \n" in text or "\n " in text

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        return [self.text(t) for t in texts]


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder per worker, file and type; its ids are those of the library with add_special_tokens=False."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype, special=True)
    return _encoders[path, dtype]
