"""Words and their 64-bit hashes from UTF-8 bytes, a few numpy passes per block.

Works on blocks of whole documents of about a megabyte; a longer document
is cut at white space into several blocks, so memory does not grow with a text.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
#: Bytes whose hashes are summed up at once, so that their numbers stay in a processor's cache.
STRETCH = 1 << 14
#: A word's hash is two polynomials over its bytes modulo a prime (a power of two would let patterns such as
#: Thue-Morse words cancel out); the bases are fixed and arbitrary.
PRIME = (1 << 31) - 1
BASES = (0x3779B97F, 0x1CE4E5B9)
#: Odd multipliers of the mixing steps (fixed, arbitrary).
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Fixed value: [\x20\x09-\x0D]
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers whose bits look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def fold(x: np.ndarray) -> np.ndarray:
    """A number alike modulo PRIME: below 2^32 for ``x`` below 2^62, at most a few above PRIME if done twice."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo PRIME, by doubling."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
        done += more
    return out


class WordHasher:
    """Hashes of the words of texts, A-Z in lower case unless ``fold`` is false; ``separator`` marks the bytes between words."""

    def __init__(self, separator: np.ndarray | None = None, fold: bool = True):
        if separator is None:
            separator = np.zeros(256, bool)
            separator[list(WHITE)] = True
        self.separator = separator
        folded = np.arange(256, dtype=np.uint64)
        if fold:
            folded[65:91] += np.uint64(32)
        self.value = mix64(folded + np.uint64(1)) % np.uint64(PRIME)
        self._grow(BLOCK + 1)

    def _grow(self, n: int) -> None:
        self.up = [powers(base, n) for base in BASES]
        self.down = [powers(pow(base, -1, PRIME), n) for base in BASES]

    def words(self, buf: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of the words in ``buf``; a document starts at each of ``doc_start``."""
        n = len(buf)
        if n == 0:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64)
        inside = ~self.separator[buf]
        first = np.zeros(n + 1, bool)
        first[doc_start] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:n]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | first[1:n]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return start, end, self.between(buf, start, end)

    def between(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes between each start and end."""
        n = len(buf)
        if n >= len(self.up[0]):
            self._grow(n + 1)
        totals = [np.zeros(n + 1, np.uint64) for _ in BASES]
        for a in range(0, n, STRETCH):
            values = self.value[buf[a:a + STRETCH]]
            for total, up in zip(totals, self.up):
                upto = total[a + 1:a + 1 + len(values)]
                np.cumsum(fold(values * up[a:a + len(values)]), out=upto)
                upto += total[a]  # below 2^63 for texts under 2 GB
        parts = [fold(fold(total[end] - total[start])) * down[start] % np.uint64(PRIME) for total, down in zip(totals, self.down)]
        return self._mixed(parts, end - start)

    def prefix_hash(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the first ``length`` bytes of each word (of the whole word where it is shorter)."""
        parts = [np.zeros(len(start), np.uint64) for _ in BASES]
        for j in range(length):
            at = start + j
            ok = np.flatnonzero(at < end)
            values = self.value[buf[at[ok]]]
            for h, base in zip(parts, BASES):
                h[ok] = fold(fold(h[ok] * np.uint64(base) + values))
        return self._mixed([h % np.uint64(PRIME) for h in parts], length)

    @staticmethod
    def _mixed(parts: list[np.ndarray], length: np.ndarray | int) -> np.ndarray:
        """One 64-bit hash; the length goes in last, so that words of one sum but other lengths differ."""
        with np.errstate(over="ignore"):
            return mix64(mix64(parts[0] << np.uint64(31) | parts[1]) + np.asarray(length).astype(np.uint64))


def small_batches(batches, rows: int = 256):
    """Arrow batches cut to so many rows: texts become Python strings a block or so at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(texts: list[bytes], separator: np.ndarray):
    """Yield (buf, doc_start, doc_no): whole documents together, or one piece of a long one.

    ``doc_no`` numbers the documents of ``texts`` that the block holds, in order;
    a long document comes in several blocks that are cut between words.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > BLOCK:
            yield _joined(texts, held)
            held, size = [], 0
        if len(text) <= BLOCK:
            held.append(i)
            size += len(text)
            continue
        buf, at = np.frombuffer(text, np.uint8), 0
        while at < len(buf):
            to = min(len(buf), at + BLOCK)
            while to < len(buf):  # go on to the next separator after a word
                gap = separator[buf[to - 1:to + BLOCK]]
                gap = np.flatnonzero(gap[1:] & ~gap[:-1])
                if len(gap):
                    to += int(gap[0])
                    break
                to = min(len(buf), to + BLOCK)
            yield buf[at:to], np.zeros(1, np.int64), [i]
            at = to
    if held:
        yield _joined(texts, held)


def _joined(texts, held):
    sizes = np.array([len(texts[i]) for i in held], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.frombuffer(b"".join(texts[i] for i in held), np.uint8), start, held


def word_stream(texts: list[bytes], hasher: WordHasher):
    """Yield (doc_no, word hashes) for each document that has words, in order of ``texts``; one entry a document."""
    rest: dict[int, list[np.ndarray]] = {}
    for buf, doc_start, docs in blocks(texts, hasher.separator):
        start, _, h = hasher.words(buf, doc_start)
        cut = np.searchsorted(start, np.append(doc_start, len(buf)))
        for k, doc in enumerate(docs):
            if len(texts[doc]) > BLOCK:
                rest.setdefault(doc, []).append(h[cut[k]:cut[k + 1]])
            else:
                yield doc, h[cut[k]:cut[k + 1]]
    for doc, parts in rest.items():
        yield doc, np.concatenate(parts)
