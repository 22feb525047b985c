"""Token ids of whole texts by a public tokenizer file (used by operators 5 and 9).

Both supported pre-tokenizers cut at a single space or line feed between other
characters, and between an ASCII word and the marks that end its piece (apostrophes apart).
Some megabytes of texts at a time are cut there by array operations, the pieces
(each begins with its space or line feed) become an Arrow dictionary, and each different one
is looked up once in a cache of bounded size.  Pieces that are one Latin word, with marks or
without, go straight to the tokenizer's model; every other piece goes through the whole
tokenizer.  A text in which white space is anything but single spaces and line
feeds goes through the tokenizer as a whole, unless white space is dropped
anyway.  Ids are the same as ``Tokenizer.encode(text, add_special_tokens=False)`` gives.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: ASCII marks but the apostrophe, which both pre-tokenizers may join with letters.
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
WORD = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]*)([{re.escape(MARKS)}]*)")
#: Kind of each byte: what pieces begin with, ASCII letters, marks, anything else.
BREAK, LETTER, MARK, OTHER = range(4)
KIND = np.array([BREAK if c in " \n" else LETTER if c.isascii() and c.isalpha() else MARK if c in MARKS else OTHER
                 for c in map(chr, range(256))], dtype="uint8")
#: Texts of about so many characters are cut together.
CHUNK_CHARS = 2 << 20
RARE_SPACE = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]
RARE_ASCII_SPACE = [c for c in RARE_SPACE if c.isascii()]


def odd_space(text: str) -> bool:
    """Whether white space is anything but single spaces and line feeds between other characters."""
    if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
        return True
    return any(c in text for c in (RARE_ASCII_SPACE if text.isascii() else RARE_SPACE))


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: its own character if visible Latin-1, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """Text to its ids as little-endian 32-bit bytes.

    Two generations of at most ``limit`` texts: a full one is set aside, and
    what is asked for again comes back from there.
    """

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.aside = encode, limit, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.limit:
            self.aside = dict(self)
            self.clear()
        ids = self.aside.get(text)
        if ids is None:
            ids = self.encode(text)
        self[text] = ids
        return ids


class TextEncoder:
    """Encodes texts with one tokenizer file; made once per worker."""

    def __init__(self, path: str, cache_pieces: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        #: Whether white space yields no tokens, and letters are lower-cased.
        self.drops_space = shape.get("normalizer") is not None
        self.alphabet = byte_alphabet()
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces = _Cache(self._piece, cache_pieces)
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _shown(self, word: str) -> str:
        return word if word.isascii() else "".join([self.alphabet[b] for b in word.encode("utf-8")])

    def _word(self, word: str) -> bytes:
        return b"".join([self.raw[t.id] for t in self.model.tokenize(word)])

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece with the space or line feed that it begins with."""
        before, bare = (piece[0], piece[1:]) if piece[0] in " \n" else ("", piece)
        m = WORD.fullmatch(bare)
        if self.drops_space:
            if not bare:
                return b""
            word, ids = m and self._shown(m[1].lower()), b""
        elif before == " ":
            if m is None or not m[1]:
                return self._whole(piece)
            word, ids = self.alphabet[32] + self._shown(m[1]), b""
        else:
            word, ids = m and self._shown(m[1]), self.newline if before else b""
        if m is None:
            return ids + self._whole(bare)
        if word:
            ids += self._word(word)
        return ids + self._word(m[2]) if m[2] else ids

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are not empty, by pieces."""
        raw = [t.encode("utf-8") for t in texts]
        data, after = np.frombuffer(b"".join(raw), dtype="uint8"), np.cumsum([len(x) for x in raw])
        kind = KIND[data]
        begins = kind == BREAK
        begins[0] = True
        begins[after[:-1]] = True
        earlier = np.concatenate([[np.uint8(BREAK)], kind[:-1]])
        earlier[after[:-1]] = BREAK
        # Pieces that are no ASCII word with marks after it stay whole.
        other = (kind == OTHER) | ((kind == LETTER) & (earlier == MARK)) | ((kind == MARK) & (earlier == BREAK))
        at = np.flatnonzero(begins)
        other = np.logical_or.reduceat(other, at)
        marks = np.flatnonzero((kind == MARK) & (earlier == LETTER))
        begins[marks[~other[np.searchsorted(at, marks, "right") - 1]]] = True
        at = np.flatnonzero(begins)
        pieces = pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(np.append(at, len(data)).astype("int64")), pa.py_buffer(data)).dictionary_encode()
        ids = [self.pieces[p] for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, ids), dtype="int64", count=len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(sizes) - sizes
        codes = pieces.indices.to_numpy()
        n = sizes[codes]
        ends = np.cumsum(n)
        out = flat[np.repeat(first[codes] - ends + n, n) + np.arange(ends[-1])]
        return np.split(out, ends[np.searchsorted(at, after[:-1]) - 1])

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text (null: none) as ``uint32``, in order."""

        def flush() -> Iterator[np.ndarray]:
            cut = iter(self._cut([t for t, whole in held if not whole]) if any(not whole for _, whole in held) else ())
            for t, whole in held:
                yield np.frombuffer(self._whole(t) if t else b"", dtype="<u4") if whole else next(cut)

        held: list[tuple[str, bool]] = []
        chars = 0
        for text in texts:
            text = text or ""
            held.append((text, not text or (not self.drops_space and odd_space(text))))
            chars += len(text)
            if chars >= CHUNK_CHARS:
                yield from flush()
                held, chars = [], 0
        yield from flush()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of ``text`` (null: none) as ``uint32``."""
        return next(self.encode_all([text]))


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """This worker's encoder for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
