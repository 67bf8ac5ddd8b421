"""Hashes of words, for many texts at a time: 64-bit polynomials over the bytes of a word, from prefix sums over a chunk of texts; or 128 bits of BLAKE2b, for words that are deleted if they are equal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text on its own).
CHUNK = 2_000_000
#: What a row counts in a chunk besides its text.
PER_ROW = 100
#: Odd bases of the polynomials; two hashes with different bases and letter values are 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.full(n + 1, x, np.uint64) for x in (self.base, pow(self.base, -1, 1 << 64)))
                self.up[0] = self.down[0] = 1
                np.cumprod(self.up, out=self.up)
                np.cumprod(self.down, out=self.down)
        return self.up[: n + 1], self.down[: n + 1]

    def ranges(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of values[begin:end] for each range: equal for equal content, wherever it stands."""
        up, down = self.of(len(values))
        total = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[:-1], out=total[1:])
            return mix((total[end] - total[begin]) * down[begin])


class WordHasher:
    """Words (between spaces, tabs and line breaks of ASCII) of encoded texts and their hashes."""

    def __init__(self, which: int = 0) -> None:
        self.powers = Powers(BASES[which])
        with np.errstate(over="ignore"):
            self.letter = mix(np.arange(1 + 256 * which, 257 + 256 * which, dtype=np.uint64))
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True

    def split(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all texts, index of a word's text, its first byte, the byte behind it), in order."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        gap = self.space[data]
        begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
        return data, text, begin, end

    def names(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.powers.ranges(self.letter[data], begin, end)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of its text, hash) of every word, in order."""
        data, text, begin, end = self.split(texts)
        return text, self.names(data, begin, end)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one number, zeros behind the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        out[k::8] = padded[k : k + 8 * len(range(k, n, 8))].view("<u8")
    return out


class WordDigests(WordHasher):
    """Words by 128 bits, no two words by the same as far as is known: up to 8 bytes a word is its own name (its bytes and its length, mixed one to one), longer ones have BLAKE2b, once for a distinct word in a chunk."""

    def names(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(words, 2): the first and the second 64 bits of each."""
        size, out = end - begin, np.empty((len(begin), 2), np.uint64)
        short = np.flatnonzero(size <= 8)
        n = size[short].astype(np.uint64)
        block = eights(data)[begin[short]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * n))
        with np.errstate(over="ignore"):
            out[short, 0], out[short, 1] = mix(block), mix(block + n * np.uint64(0x9E3779B97F4A7C15))
        long = np.flatnonzero(size > 8)
        if len(long):
            edge = np.zeros(len(data) + 1, np.int8)
            edge[begin[long]], edge[end[long]] = 1, -1
            letters = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
            ends = np.concatenate([[0], np.cumsum(size[long])])
            words = pa.Array.from_buffers(pa.large_binary(), len(long), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
            _, at, held = words.dictionary.buffers()
            at, held = np.frombuffer(at, np.int64)[: len(words.dictionary) + 1].tolist(), held.to_pybytes()
            digests = b"".join([hashlib.blake2b(held[i:j], digest_size=16).digest() for i, j in zip(at, at[1:])])
            out[long] = np.frombuffer(digests, np.uint64).reshape(-1, 2)[words.indices.to_numpy()]
        return out


def folded(names: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit value for names[s : s + size] of each start s: the names are taken in one by one, each mixed with all before it."""
    out = np.full(len(start), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ names[start + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return mix(out)


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def chunks(rows: list, texts: list[str | None]) -> Iterator[tuple[list, list[bytes]]]:
    """(rows, encoded texts) in chunks of bounded size."""
    own, held, size = [], [], 0
    for row, text in zip(rows, texts):
        data = encode(text)
        if own and size + len(data) > CHUNK:
            yield own, held
            own, held, size = [], [], 0
        own.append(row)
        held.append(data)
        size += len(data) + PER_ROW
    if own:
        yield own, held
