"""Token ids by the tokenizers library, where every distinct pre-token is encoded once per worker.

Byte-level BPE encodes pre-tokens one by one.  In texts of Latin letters without doubled blanks and apostrophes the cuts
between pre-tokens are plain: before a space, and between letters and other characters.  Such texts are cut there, and the
ids of each piece come from the library once and are remembered.  All other texts are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: Pieces remembered per worker process; a full memory is emptied.
REMEMBERED = 800_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PIECE = re.compile(f" ?[{_LETTERS}]+| ?[^{_LETTERS} ]+")
#: Blanks in a row or at the end, apostrophes (contractions) and characters that may be letters beyond Latin.
_UNSURE = re.compile(r"\s\s| $|['ªµº]|[^\x00-ɏ]")
_UNSURE_ASCII = ("'", "  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f")


class Encoder:
    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the strings of special tokens are ordinary text
        self.ids: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of new pieces."""
        for a in range(0, len(pieces), 20_000):
            part = pieces[a:a + 20_000]
            # Pieces that begin with a space stay apart in one text; lengths of tokens in bytes tell where each ends.
            spaced, other = [x for x in part if x[0] == " "], [x for x in part if x[0] != " "]
            if spaced:
                ids = np.array(self.tokenizer.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0].ids, dtype="<u4")
                stops = np.cumsum([len(x.encode()) for x in spaced])
                self._keep(spaced, ids, np.searchsorted(np.cumsum(self.sizes[ids]), stops) + 1)
            if other:
                e = self.tokenizer.encode(other, is_pretokenized=True, add_special_tokens=False)
                self._keep(other, np.array(e.ids, dtype="<u4"), np.searchsorted(np.array(e.word_ids), np.arange(len(other)), side="right"))

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, at = ids.tobytes(), 0
        for piece, end in zip(pieces, (ends * 4).tolist()):
            self.ids[piece] = raw[at:end]
            at = end

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for null."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        known = self.ids
        cut, new = [], set()
        for text in texts:
            if not text or not self._plain(text):
                cut.append((None, None))
                continue
            pieces = _PIECE.findall(text)
            found = list(map(known.get, pieces))
            if None in found:
                new.update(x for x, ids in zip(pieces, found) if ids is None)
                cut.append((pieces, found))
            else:
                cut.append((None, b"".join(found)))
        self._learn(list(new))
        for text, (pieces, found) in zip(texts, cut):
            if pieces is not None:
                yield b"".join([known[x] if ids is None else ids for x, ids in zip(pieces, found)])
            elif found is not None:
                yield found
            else:
                yield self.whole(text) if text else b""

    @staticmethod
    def _plain(text: str) -> bool:
        """Whether the cuts between pre-tokens are sure."""
        if text.isascii():  # substring searches are much faster than the pattern
            if text[-1] != " " and not any(x in text for x in _UNSURE_ASCII):
                return True
        return not _UNSURE.search(text)
