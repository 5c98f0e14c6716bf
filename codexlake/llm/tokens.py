"""Token ids through the tokenizers library, each distinct piece of text encoded once.

Texts are cut where no pre-token of the vocabulary can cross: at single spaces and line ends between other characters, and before a comma or
full stop that follows a letter and ends a word. The ids of the pieces, joined, are therefore the ids of the text; ``tests/llm/test_tokens.py`` holds this against encoding
whole texts. Pieces are told apart by 64-bit hashes, computed for a whole batch at once; the table of known pieces is bounded by KNOWN_PIECES.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np

#: Pieces kept; beyond, the table starts anew with those of the batch.
KNOWN_PIECES = 1_000_000
#: Bytes of text taken at once; longer texts are taken in parts, cut at a space between ASCII letters.
TAKEN = 2 << 20
SPACE, LINE, COMMA, STOP = 32, 10, 44, 46

_FACTOR = 0x9E3779B97F4A7C13
_BYTES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full((1 << 12) - 1, _FACTOR, dtype=np.uint64)]))
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PieceTokenizer:
    """ids(texts): an array of unsigned 32-bit ids for each text, without special tokens.

    spaces_kept: the vocabulary's pre-tokens take one leading space (byte-level); otherwise white space only separates and case is dropped.
    """

    def __init__(self, path: str, spaces_kept: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._spaces_kept = spaces_kept
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, dtype=np.uint64)  # sorted
        self._starts = self._sizes = np.zeros(0, dtype=np.int64)  # of their ids in _flat
        self._flat = np.zeros(0, dtype=np.uint32)

    def cuts(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of joined texts; begins: the texts' places."""
        n = len(raw)
        white = np.ones(n + 2, dtype=bool)
        white[1:-1] = _WHITE[raw]
        letter = np.zeros(n + 2, dtype=bool)
        letter[1:-1] = _LETTER[raw]
        last = np.zeros(n + 2, dtype=bool)  # at a text's last byte
        last[begins[1:]] = True
        last[n] = True
        first = np.zeros(n + 2, dtype=bool)
        first[begins + 1] = True
        alone = last.copy()
        alone[:-1] |= white[1:]  # ends a word
        mark = np.zeros(n + 2, dtype=bool)
        mark[1:-1] = ((raw == COMMA) | (raw == STOP)) & letter[:-2] & ~first[1:-1] & alone[1:-1]
        cut = first | mark
        if self._spaces_kept:
            inner = np.zeros(n + 2, dtype=bool)
            inner[1:-1] = ~white[:-2] & ~white[2:] & ~first[1:-1] & ~last[1:-1]
            line = np.zeros(n + 2, dtype=bool)
            line[1:-1] = (raw == LINE) & inner[1:-1]
            blank = np.zeros(n + 2, dtype=bool)
            blank[1:-1] = (raw == SPACE) & inner[1:-1]
            cut |= line | blank
            cut[1:] |= line[:-1]
            starts = np.flatnonzero(cut[1:-1])
            return starts, np.append(starts[1:], n)
        gap = np.zeros(n + 2, dtype=bool)
        gap[0] = gap[-1] = True
        gap[1:-1] = (raw == SPACE) | (raw == LINE)
        starts = np.flatnonzero(~gap[1:-1] & (gap[:-2] | cut[1:-1]))
        ends = np.flatnonzero(~gap[1:-1] & (gap[2:] | cut[2:])) + 1
        return starts, ends

    def _parts(self, texts: Sequence[str]) -> Iterator[tuple[bytes, int]]:
        """Encoded texts, long ones in parts, with the text's number."""
        for k, text in enumerate(texts):
            raw = text.encode("utf-8", "replace")
            if not self._spaces_kept:
                raw = raw.lower()
            while len(raw) > TAKEN:
                at = TAKEN
                while at > TAKEN // 2 and not (raw[at] == SPACE and _LETTER[raw[at - 1]] and _LETTER[raw[at + 1 if at + 1 < len(raw) else at]]):
                    at -= 1
                if at == TAKEN // 2:
                    break
                yield raw[:at], k
                raw = raw[at:]
            yield raw, k

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[bytes] = []
        of: list[int] = []
        size = 0
        for raw, k in chain(self._parts(texts), [(b"", -1)]):
            if held and (k < 0 or size + len(raw) > TAKEN):
                for t, x in zip(of, self._taken(held), strict=True):
                    found[t].append(x)
                held, of, size = [], [], 0
            if raw and k >= 0:
                held.append(raw)
                of.append(k)
                size += len(raw)
        none = np.zeros(0, dtype=np.uint32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in found]

    def _taken(self, parts: list[bytes]) -> list[np.ndarray]:
        joined = b"".join(parts)
        raw = np.frombuffer(joined, dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]).astype(np.int64)
        starts, ends = self.cuts(raw, begins)
        if len(starts) == 0:
            return [np.zeros(0, dtype=np.uint32)] * len(parts)
        sizes = ends - starts
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # a byte's place in its piece
        values = _BYTES[raw[at + np.repeat(starts, sizes)]] * (_POWERS[at & 0xFFF] + (at >> 12).astype(np.uint64))
        h = _mixed(np.add.reduceat(values, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self._hashes) + len(distinct) > KNOWN_PIECES:
            self._forget()
        place = np.searchsorted(self._hashes, distinct)
        new = np.flatnonzero((self._hashes[np.minimum(place, len(self._hashes) - 1)] != distinct) if len(self._hashes) else np.ones(len(distinct), dtype=bool))
        if len(new):
            self._learn(distinct[new], place[new], [joined[a:b].decode("utf-8", "replace") for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            place = np.searchsorted(self._hashes, distinct)
        entry = place[back]
        n = self._sizes[entry]
        upto = np.cumsum(n)
        out = self._flat[np.arange(upto[-1]) + np.repeat(self._starts[entry] - (upto - n), n)]
        edge = np.concatenate([[0], upto])[np.searchsorted(starts, np.append(begins, len(raw)))]
        return [out[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def _learn(self, hashes: np.ndarray, place: np.ndarray, pieces: list[str]) -> None:
        got = [e.ids for k in range(0, len(pieces), 4096) for e in self._tokenizer.encode_batch_fast(pieces[k : k + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        flat = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(sizes.sum()))
        starts = len(self._flat) + np.cumsum(sizes) - sizes
        self._flat = np.concatenate([self._flat, flat])
        self._hashes, self._starts, self._sizes = (np.insert(a, place, b) for a, b in ((self._hashes, hashes), (self._starts, starts), (self._sizes, sizes)))

    def token_strings(self) -> list[str]:
        n = self._tokenizer.get_vocab_size(with_added_tokens=True)
        return [self._tokenizer.id_to_token(i) or "" for i in range(n)]


_loaded: dict[tuple[str, bool], PieceTokenizer] = {}


def tokenizer(path: str, spaces_kept: bool) -> PieceTokenizer:
    """One for each worker process, kept with what it knows."""
    if (path, spaces_kept) not in _loaded:
        _loaded[path, spaces_kept] = PieceTokenizer(path, spaces_kept)
    return _loaded[path, spaces_kept]
