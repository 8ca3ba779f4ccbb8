"""Plain, quadratic versions of the operators for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def twin_words(n: int = 1024) -> tuple[str, str]:
    """A Thue-Morse word and its complement: alike under every polynomial hash modulo a power of two."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def shingle_set(text: str | None, size: int) -> set:
    words = WORD.findall(lower_az(text or ""))
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def near_components(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable, all pairs that share a shingle compared."""
    sets = {d: shingle_set(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    seen = set()
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in sets}


def repeated_bytes(docs: list[tuple[int, str | None]], length: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes) per row, in order."""
    raw = [(t or "").encode() for _, t in docs]
    places: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            k = hash(b[i:i + length])
            places[k] = places.get(k, 0) + 1
    out = []
    for (d, _), b in zip(docs, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if places[hash(b[i:i + length])] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out
