"""Words of texts as 63-bit hashes, made for many texts at once."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 17
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
START, END = np.uint64(1), np.uint64(2)  # no word has these hashes

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * MIX
    x = (x ^ x >> np.uint64(32)) * BASE
    return x ^ x >> np.uint64(29)


class Words:
    """Hashes of the words of texts, A-Z in lower case, by sums of powers over pieces of their bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.grow(PIECE)

    def grow(self, n: int) -> None:
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b)]), dtype=np.uint64) for b in (BASE, inverse))

    def piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of every word."""
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~_SPACE[data]
        turns = np.flatnonzero(np.diff(inside))
        first, last = turns[::2], turns[1::2]
        if len(data) > len(self.up):
            self.grow(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * self.up[: len(data)], dtype=np.uint64)])
        h = mixed((sums[last] - sums[first]) * self.down[first]) >> np.uint64(1)
        return first, np.where(h <= END, h + np.uint64(3), h)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all tokens, the end of each text included, and the number of tokens of each text."""
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        blob = b" ".join([*raw, b""])
        firsts, hashes, at = [], [], 0
        while at < len(blob):
            to = min(len(blob), at + PIECE)
            if to < len(blob):  # cut at white space; a longer word is a piece of its own
                spaces = np.flatnonzero(_SPACE[np.frombuffer(blob, np.uint8, to - at, at)])
                while not len(spaces):
                    lo, to = to, min(len(blob), to + PIECE)
                    spaces = np.flatnonzero(_SPACE[np.frombuffer(blob, np.uint8, to - lo, lo)]) + lo - at
                to = at + int(spaces[-1]) + 1
            first, h = self.piece(np.frombuffer(blob, np.uint8, to - at, at))
            firsts.append(first + at)
            hashes.append(h)
            at = to
        ends = np.cumsum([len(r) + 1 for r in raw])
        upto = np.searchsorted(np.concatenate([np.zeros(0, np.int64), *firsts]), ends)
        n = np.diff(upto, prepend=0)
        out = np.full(int(upto[-1]) + len(raw), END, np.uint64)
        words = np.ones(len(out), bool)
        words[upto + np.arange(len(raw))] = False
        out[words] = np.concatenate(hashes)
        return out, n + 1
