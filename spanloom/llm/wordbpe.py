"""Word-level BPE ids by the tokenizers library, with a bounded table of known word pieces in each worker.

For texts below U+0100 the tokenizer's normaliser is lower-casing and its splitter a plain pattern, so a text's ids are the ids of
the pattern's pieces one after another. numpy finds the pieces of many texts at once, tells them apart by a 64-bit hash of
their characters, and looks them up in the table; the library is asked once for each unknown piece. Other texts, and texts with a special
token's mark, go to the library whole. Every id comes from the library; the table only saves asking again.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from spanloom.llm.common import quiet_threads

_ABOVE = re.compile("[^\x00-\xff]|<\\|")
#: Pieces that a worker remembers, about 40 bytes each; beyond them it starts anew.
PIECES_KEPT = 1_500_000
_LOADED: dict[str, "WordBpe"] = {}

#: Classes of characters below U+0100, lower case, as the splitter's pattern has them: white space, letters, digits, others.
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_LOWER = bytes(ord(chr(i).lower()) if len(chr(i).lower()) == 1 and ord(chr(i).lower()) < 256 else i for i in range(256))
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
_CLASS[[*range(ord("a"), ord("z") + 1), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_CLASS[[*range(ord("0"), ord("9") + 1), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
_VALUES = np.random.RandomState(7).randint(1, 2**62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a constant and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        both = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def pieces_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's pieces in lower-case characters below U+0100; the last one must be white space."""
    kind = _CLASS[buf]
    before = np.empty_like(kind)
    before[0] = _SPACE
    before[1:] = kind[:-1]
    start = (kind != before) | (kind == _DIGIT)
    start &= kind != _SPACE
    # contractions: an apostrophe that begins a piece takes 's 't 'm 'd 're 've 'll along
    quote = np.flatnonzero(start & (buf == ord("'")))
    if len(quote):
        one, two = buf[quote + 1], buf[np.minimum(quote + 2, len(buf) - 1)]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        taken = quote[short | long]
        start[taken + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        start[after] = kind[after] != _SPACE
    edge = np.flatnonzero(start | (kind == _SPACE) & (before != _SPACE))
    first = start[edge]
    nexts = np.append(edge[1:], len(buf))
    return edge[first], nexts[first]


class WordBpe:
    def __init__(self, path: str):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    @staticmethod
    def get(path: str) -> "WordBpe":
        if path not in _LOADED:
            _LOADED[path] = WordBpe(path)
        return _LOADED[path]

    def _ask(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 5_000):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 5_000], add_special_tokens=False)]
        return out

    def _ask_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces one after another, and how many each has: a piece's last id is one that closes a word."""
        lines = [" ".join(pieces[i : i + 64]) for i in range(0, len(pieces), 64)]
        ids = np.frombuffer(b"".join(self._ask(lines)), np.uint32)
        ends = np.flatnonzero(self.closes[ids])
        if len(ends) == len(pieces):
            return ids, np.diff(ends, prepend=-1)
        one = self._ask(pieces)  # some piece isn't closed as expected: ask for each
        return np.frombuffer(b"".join(one), np.uint32), np.array([len(x) // 4 for x in one], np.int64)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """hashes are sorted."""
        if len(self.known) + len(hashes) > PIECES_KEPT:
            self._forget()
        ids, size = self._ask_pieces(pieces)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        where = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size = np.insert(self.known, where, hashes), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def _lookup(self, hashes: np.ndarray, missing) -> np.ndarray:
        where = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        unknown = np.flatnonzero(self.known[where] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(unknown):
            if len(self.known) + len(unknown) > PIECES_KEPT:
                self._forget()
                unknown = np.arange(len(hashes))
            self._learn(hashes[unknown], missing(unknown))
            where = np.searchsorted(self.known, hashes)
        return where

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts below U+0100."""
        data = "\n".join(texts).encode("latin-1").translate(_LOWER) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        starts, ends = pieces_of(buf)
        if not len(starts):
            return [b""] * len(texts)
        up, down = _powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_VALUES[buf] * down[: len(buf)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(31)
        unique, first, which = np.unique(h, return_index=True, return_inverse=True)
        where = self._lookup(unique, lambda k: [data[a:b].decode("latin-1") for a, b in zip(starts[first[k]].tolist(), ends[first[k]].tolist())])
        size = self.size[where][which]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[where][which] - (total - size), size) + np.arange(total[-1])].tobytes()
        bounds = np.cumsum([len(t) + 1 for t in texts])
        upto = np.concatenate([[0], total])[np.searchsorted(starts, bounds)].tolist()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *upto[:-1]], upto)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        whole = [bool(_ABOVE.search(t)) for t in texts]
        rare = iter(self._ask([t for t, w in zip(texts, whole) if w]))
        plain = [t for t, w in zip(texts, whole) if not w]
        rest = iter(self._plain(plain) if plain else [])
        return [next(rare) if w else next(rest) for w in whole]
