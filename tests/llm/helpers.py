"""Small tables with the awkward cases that every operator must handle, and brute-force counterparts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} the of {i}" for i in range(4000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and the cat sits on the mat of the house", "en", "a", 10, "x"),
    (2, "The quick brown fox jumps over the lazy dog and the cat sits on the mat of the house", "en", "a", 10, "x"),
    (3, None, "en", "a", None, None),
    (4, "", None, None, 0, "y"),
    (5, "  ", "de", "b", 2, None),
    (6, LONG, "en", "a", len(LONG), "z"),
    (7, "a  b\n\n c\td  <|endoftext|> don't été 🙂", "fr", "b", 40, "z"),
    (8, "Released under the MIT License.\nfooter line\nText of page eight about nothing.", "en", "c", 70, "z"),
    (9, "footer line\nanother", "en", "c", 19, None),
    (9, "footer line\nanother", "en", "c", 19, None),
    (None, "a row without an id", "en", "a", 19, None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


def documents(spark):
    """`score` is an extra column whose name clashes with a result's."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text: str | None) -> int:
    """By definition, bit by bit."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text: str) -> set[tuple[str, ...]]:
    """Runs of five words, without ASCII case."""
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def near_groups(docs: list[tuple[int, str]]) -> dict[int, int]:
    fps = {i: fingerprint(t) for i, t in docs}
    ids = sorted(fps)
    return components([(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 3], ids)


def rng():
    return np.random.default_rng(5)
