"""Token ids of whole texts by the `tokenizers` library, remembering the ids of text pieces that recur.

Both vocabularies cut a text into pieces before merging inside each piece, so a text's ids are those of its
pieces in a row. Cutting at ASCII blanks (with a leading space kept where the vocabulary keeps it) is never
finer than that, so each distinct piece goes to the tokenizer once and is looked up afterwards. A plain word
of Latin letters is one piece of the vocabulary's own cut and goes to its merge model directly. Texts where
the cut could differ (other kinds of blank, special tokens spelled out) go to the tokenizer whole.
"""

import functools
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

_SPACED = re.compile(r" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]")
_PLAIN = re.compile(r"[^ \t\n\r]+")
#: Blanks beyond ASCII's, and separators that engines class differently.
_OTHER_BLANKS = re.compile(
    "[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]"
)
_WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*$%&#]*)")
#: Bound of what a worker remembers, in bytes, and what an entry takes beside its own. It stays from task to task:
#: frequent pieces come early, and filling the store anew costs each task a third of its time.
REMEMBERED_BYTES = 96 << 20
ENTRY_BYTES = 200


def _byte_letters():
    """Byte -> the character that byte-level vocabularies write for it: printable ones stay, others follow 255."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(stays))}
    return {b: chr(moved.get(b, b)) for b in range(256)}


_LETTERS = _byte_letters()


class Pieces(dict):
    """Piece -> its ids as little-endian bytes, filled on demand up to REMEMBERED_BYTES; a full store keeps what it has."""

    def __init__(self, tokenizer, dtype, lower):
        self.tokenizer, self.code, self.lower = tokenizer, dtype.char, lower
        self.model = tokenizer.model
        self.room = REMEMBERED_BYTES

    def __missing__(self, piece):
        ids = self._ids(piece)
        size = len(piece) + len(ids) + ENTRY_BYTES
        if size <= self.room:
            self[piece] = ids
            self.room -= size
        return ids

    def _ids(self, piece):
        word = _WORD.fullmatch(piece)
        if not word:
            ids = self.whole(piece)
        elif word[2]:
            ids = self[word[1]] + self[word[2]]
        else:
            letters = piece.lower() if self.lower else piece
            letters = letters.replace(" ", _LETTERS[32]) if letters.isascii() else letters.encode().decode("latin-1").translate(_LETTERS)
            ids = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids

    def whole(self, text):
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Encode texts to little-endian ids of `width` bytes (2 where all ids fit), ended by `end_id`."""

    def __init__(self, path, end_id=2, width=None):
        tokenizer = Tokenizer.from_file(path)
        self.width = width or (2 if max(tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4)
        self.dtype = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.dtype).tobytes()
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None

        def ids(text):
            return tokenizer.encode(text, add_special_tokens=False).ids

        # a vocabulary that keeps blanks has ids for them; one that drops them has none
        self.spaced = ids("a  b") != ids("a b")
        self.pieces = Pieces(tokenizer, self.dtype, lower=ids("A") == ids("a"))

    def encode(self, text):
        """Ids of a text and the end id, as bytes; None counts as empty."""
        text = text or ""
        if self.special and self.special.search(text) or self.spaced and _OTHER_BLANKS.search(text):
            return self.pieces.whole(text) + self.end
        return b"".join(map(self.pieces.__getitem__, (_SPACED if self.spaced else _PLAIN).findall(text))) + self.end


@functools.cache
def encoder(path, end_id=2, width=None):
    """One encoder per worker process, whose pieces serve all its tasks."""
    return Encoder(path, end_id, width)
