"""Byte-level BPE encoding and decoding (operator 10).

Each pre-token is merged with a segment tree over the ranks of its adjacent symbol pairs: the root holds the
smallest (rank, position), which is the leftmost pair of lowest rank; a merge changes at most three leaves, each
updated in logarithmic time, until no pair has a rank. The trees of a batch's new pre-tokens are
processed in step. Texts are cut at single spaces into chunks that no pre-token crosses, and the results of chunks
and pre-tokens are kept in bounded per-worker caches, since words repeat.

A null text is read as the empty text (no ids). Texts of any length are encoded whole. Repeated rows and ties give repeated
results, an empty table an empty one. Other columns pass through encode() and decode() untouched unless they clash with a
result column, in which case the result wins; digests() returns the key and its results only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship

#: The pre-token pattern and byte alphabet of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 62
CACHE_ENTRIES = 500_000
LONG_WORD = 64
BATCH_TEXTS = 1_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte: visible Latin-1 characters stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Merges the symbols of one pre-token by a segment tree over adjacent pair ranks."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs  # (left id, right id) -> (rank, merged id)

    def __call__(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        if n < 2:
            return ids
        if n == 2:
            found = pairs.get((ids[0], ids[1]))
            return [found[1]] if found else ids
        size = 1 << (n - 2).bit_length()
        # a node holds rank * size + position: its minimum is the leftmost pair of the lowest rank
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            found = pairs.get((ids[i], ids[i + 1]))
            if found:
                tree[size + i] = found[0] * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        ids = list(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low

        while tree[1] != NONE:
            i = tree[1] % size
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get((ids[i], ids[k]))
                put(i, found[0] * size + i if found else NONE)
            else:
                put(i, NONE)
            if j < n - 1:
                put(j, NONE)
            h = before[i]
            if h >= 0:
                found = pairs.get((ids[h], ids[i]))
                put(h, found[0] * size + h if found else NONE)
        return [x for x in ids if x >= 0]


class BatchMerger:
    """The same segment trees for many pre-tokens at once: one row of leaves per pre-token, all rows in step."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        found = sorted((a << 32 | b, rank, merged) for (a, b), (rank, merged) in pairs.items())
        self.keys = np.array([x[0] for x in found] or [-1], np.int64)
        self.ranks = np.array([x[1] for x in found] or [NONE], np.int64)
        self.merged = np.zeros(int(self.ranks.max()) + 1 if found else 1, np.int64)
        for _, rank, merged in found:
            self.merged[rank] = merged

    def leaf(self, left: np.ndarray, right: np.ndarray, position: np.ndarray, size: int) -> np.ndarray:
        """rank * size + position of each pair, NONE where the pair has no rank or a side is missing (-1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.ranks[at] * size + position, NONE)

    def __call__(self, words: list[bytes], first: np.ndarray) -> list[list[int]]:
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(max(1, 1 << (len(w) - 2).bit_length()) if len(w) > 2 else 1, []).append(i)
        for size, members in groups.items():
            for start in range(0, len(members), max(1, (1 << 18) // size)):
                part = members[start : start + max(1, (1 << 18) // size)]
                for i, ids in zip(part, self._merge([words[i] for i in part], first, size)):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], first: np.ndarray, size: int) -> list[list[int]]:
        n, width = len(words), size + 1
        lengths = np.fromiter(map(len, words), np.int64, n)
        symbols = np.full((n, width + 1), -1, np.int64)
        mask = np.arange(width)[None, :] < lengths[:, None]
        symbols[:, :width][mask] = first[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        spot = np.arange(size)[None, :]
        tree[:, size:] = self.leaf(symbols[:, :size], symbols[:, 1 : size + 1], spot, size)
        s = size // 2
        while s >= 1:
            tree[:, s : 2 * s] = np.minimum(tree[:, 2 * s : 4 * s : 2], tree[:, 2 * s + 1 : 4 * s : 2])
            s //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root % size
            j = after[rows, i]
            symbols[rows, i] = self.merged[root // size]
            symbols[rows, j] = -1
            k = np.minimum(after[rows, j], width)  # the column `width` is always empty
            after[rows, i] = k
            before[rows, k] = i
            h = before[rows, i]
            here = symbols[rows, i]
            left = np.where(h >= 0, symbols[rows, np.maximum(h, 0)], -1)
            tree[rows, size + i] = self.leaf(here, symbols[rows, k], i, size)
            inner = j < size
            tree[rows[inner], size + j[inner]] = NONE
            inner = h >= 0
            tree[rows[inner], size + h[inner]] = self.leaf(left[inner], here[inner], h[inner], size)
            at, r = np.concatenate([i, np.minimum(j, size - 1), np.maximum(h, 0)]) + size, np.concatenate([rows] * 3)
            for _ in range(size.bit_length() - 1):
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])
            rows = rows[tree[rows, 1] != NONE]
        keep = symbols >= 0
        flat, ends = symbols[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class ByteBpe:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.token_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = vocab[c]
        pairs = {}
        for rank, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.merge, self.merge_all = Merger(pairs), BatchMerger(pairs)
        self.first_array = np.array(self.first, np.int64)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token: short ones in step, long ones on a tree of their own."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list = [None] * len(raw)
        short = [i for i, w in enumerate(raw) if len(w) <= LONG_WORD]
        for i, ids in zip(short, self.merge_all([raw[i] for i in short], self.first_array)):
            out[i] = ids
        for i, w in enumerate(raw):
            if out[i] is None:
                out[i] = self.merge([self.first[b] for b in w])
        return out

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        if self.cut is None or not any(s in text for s in self.special):
            yield False, text
            return
        for part in self.cut.split(text):
            if part:
                yield part in self.special, part

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, part in self.segments(text):
            if special:
                out.append(self.special[part])
            else:
                for ids in self.words(self.pattern.findall(part)):
                    out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8", "replace")


#: White space other than the plain space.
OTHER_SPACE = [chr(c) for c in (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def chunks(text: str) -> list[str] | None:
    """The text cut before each space, or None where a run of white space makes the pre-tokens depend on more
    than their chunk. The first piece has no space; the space before every other piece is left out."""
    if "  " in text or text[-1:].isspace():
        return None
    for c in OTHER_SPACE[:9] if text.isascii() else OTHER_SPACE:
        if c in text and c + " " in text:
            return None
    return text.split(" ")


class Words:
    """What is known of chunks and pre-tokens, kept per worker and bounded; `entry` makes it from the ids."""

    def __init__(self, bpe: ByteBpe, entry: Callable[[list[int]], tuple], join: Callable[[list[tuple]], tuple]):
        self.bpe, self.entry, self.join = bpe, entry, join
        self.word: dict[str, tuple] = {}
        self.spaced: dict[str, tuple] = {}
        self.bare: dict[str, tuple] = {}

    def learn(self, texts: list[str]) -> list[list[tuple]]:
        """The entries that each text (without special tokens) consists of, in order."""
        for known in (self.word, self.spaced, self.bare):
            if len(known) > CACHE_ENTRIES:
                known.clear()
        cut = [chunks(t) for t in texts]
        new: set[str] = set()
        first: set[str] = set()
        for pieces in cut:
            if pieces:
                new.update(pieces[1:])
                first.add(pieces[0])
        find = self.bpe.pattern.findall
        plan = [(self.spaced, p, find(" " + p)) for p in new.difference(self.spaced)] + [(self.bare, p, find(p)) for p in first.difference(self.bare)]
        whole = {i: find(t) for i, (t, pieces) in enumerate(zip(texts, cut)) if pieces is None}
        missing = set()
        for _, _, words in plan:
            missing.update(words)
        for words in whole.values():
            missing.update(words)
        missing = list(missing.difference(self.word))
        entry, word = self.entry, self.word
        for w, ids in zip(missing, self.bpe.words(missing)):
            word[w] = entry(ids)
        for known, piece, words in plan:
            known[piece] = word[words[0]] if len(words) == 1 else self.join([word[w] for w in words])
        get = self.spaced.__getitem__
        return [[word[w] for w in whole[i]] if pieces is None else [self.bare[pieces[0]], *map(get, pieces[1:])] for i, pieces in enumerate(cut)]

    def entries(self, texts: list[str | None]) -> list[list[tuple]]:
        """As learn(), with special tokens."""
        parts = [list(self.bpe.segments(t or "")) for t in texts]
        found = iter(self.learn([p for own in parts for special, p in own if not special]))
        out = []
        for own in parts:
            row: list[tuple] = []
            for special, p in own:
                row += [self.entry([self.bpe.special[p]])] if special else next(found)
            out.append(row)
        return out


class Digester:
    """Per text: number of ids, hash of the decimal ids, hash of the decoded text."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        token = self.bpe.token_bytes
        self.words = Words(
            self.bpe,
            lambda ids: (len(ids), ",".join(map(str, ids)), b"".join([token[i] for i in ids])),
            lambda found: (sum(x[0] for x in found), ",".join(x[1] for x in found), b"".join(x[2] for x in found)),
        )

    def __call__(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        out = []
        for row in self.words.entries(texts):
            n, ids, raw = zip(*row) if row else ((0,), ("",), (b"",))
            shown = b"".join(raw)
            try:
                shown.decode()
            except UnicodeDecodeError:
                shown = shown.decode("utf-8", "replace").encode()
            out.append((sum(n), hashlib.sha256(",".join(filter(None, ids)).encode()).hexdigest(), hashlib.sha256(shown).hexdigest()))
        return out


_made: dict[tuple[type, str], object] = {}


def worker_object(kind: type, path: str):
    """One object per Python worker and vocabulary."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]


def encode(df: DataFrame, text: str = "text", vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """`df` with an array column of the ids of each whole text."""
    ship(df.sparkSession)
    path = vocabulary or default_vocabulary()
    kept = [c for c in df.columns if c != ids]

    def run(batches):
        bpe = worker_object(ByteBpe, path)
        for batch in batches:
            found = [bpe.encode(x or "") for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.list_(pa.int32()))], [*kept, ids])

    return df.select(*kept).mapInArrow(run, df.select(*kept).withColumn(ids, F.lit(None).cast("array<int>")).schema)


def decode(df: DataFrame, ids: str = "ids", vocabulary: str | None = None, text: str = "decoded") -> DataFrame:
    """`df` with the text that each array of ids stands for; null ids give a null text."""
    ship(df.sparkSession)
    path = vocabulary or default_vocabulary()
    kept = [c for c in df.columns if c != text]

    def run(batches):
        bpe = worker_object(ByteBpe, path)
        for batch in batches:
            found = [None if x is None else bpe.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string())], [*kept, text])

    return df.select(*kept).mapInArrow(run, df.select(*kept).withColumn(text, F.lit(None).cast("string")).schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row: the number of ids, the SHA-256 of the decimal ids joined by commas, and of the decoded text."""
    ship(df.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        digest = worker_object(Digester, path)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(start, BATCH_TEXTS)
                n, a, b = zip(*digest(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir):
    from plumbline.session import table

    return digests(table(spark, sf_dir, "documents"))
