"""Token ids of whole texts as little-endian unsigned 32-bit bytes, word by word through a cache.

The vocabulary drops white space and never joins across it, so the ids of a text are those of its
pieces between ASCII blanks, one after the other. Pieces recur, so a dictionary lookup and one join
per text replace most of the encoding.
"""

from __future__ import annotations

import os
import re
import unicodedata

from tarmac.llm.batches import trim

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Pieces in the younger half of a worker's cache (some 200 bytes each), and the longest kept.
CACHE_PIECES, CACHE_CHARS = 320_000, 40

_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)\Z")
_workers: dict[str, "Pieces"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """piece -> its ids as bytes; what is missing is encoded."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self._older: dict[str, bytes] = {}
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        trim()
        self._model = self._tokenizer.model
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self._letters = {b: n + 256 for n, b in enumerate(b for b in range(256) if b not in set(plain))}

    def _encode(self, piece: str) -> bytes:
        import numpy as np

        return np.array(self._tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
        return b"".join(t.id.to_bytes(4, "little") for t in self._model.tokenize(spelled))

    def __missing__(self, piece: str) -> bytes:
        if (ids := self._older.get(piece)) is not None:
            pass
        elif piece.isascii() and piece.isalpha() and piece.islower():
            ids = self._word(piece)
        elif (m := _MARKED.match(piece)) and m[1].lower().isalpha():
            # letters, then marks: the vocabulary splits between them
            ids = self[m[1]] + self[m[2]]
        elif (low := piece.lower()).isalpha() and len(low) == len(piece) and "Σ" not in piece and unicodedata.is_normalized("NFC", piece):
            # one word of letters: the model alone, without the normaliser and splitter
            ids = self[low] if low != piece else self._word(piece)
        else:
            ids = self._encode(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self._older = dict(self)
                self.clear()
                self[""] = b""
            self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, pieces))


def pieces(path: str) -> Pieces:
    """The cache of this worker process for a vocabulary file."""
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]
