"""Byte-level BPE by speculation and verification.

A pre-token ("word") is first cut greedily into the longest vocabulary entries. A sequence of entries is what
the merges would make if no merge crosses a border, which can be said of each adjacent pair alone: undo the
pair's merges from the last to the first and look whether, while both border parts exist, a rule would have
joined them sooner. That check runs over all pairs of all new words of a batch at once; only words with a
failing pair are merged exactly. Words' results are kept in a bounded cache of the worker.

Edge cases: null counts as the empty text and has no tokens; a very long word costs n log n; special tokens of the
file are found in the text as the file's library does; repeated rows are encoded alike; other columns pass by.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, tidy

#: Unicode's White_Space; Python's \s has four control characters more.
_WS = r"\t-\r \x85\xa0" + "".join(f"\\u{c:04x}" for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: The pre-token pattern of byte-level BPE files, a fixed value of the format.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Words of a cache's generation, and the longest word kept.
CACHE_WORDS, CACHE_LONGEST = 250_000, 64


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level file: printable bytes themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBPE:
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.check(spec)
        back = {c: b for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        self.id_of: dict[bytes, int] = {}
        for text, i in vocab.items():
            if all(c in back for c in text):
                self.bytes_of[i] = bytes(back[c] for c in text)
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.specials.items():
            self.bytes_of[i] = text.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        #: rank of the merge that makes an entry (-1: none), and its two parts
        self.born = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        keys, ranks = [], []
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), (r, z))
            if self.born[z] < 0:
                self.born[z], self.left[z], self.right[z] = r, x, y
            keys.append((x << 32) | y)
            ranks.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        # greedy proposals use entries that merging their own bytes gives back
        self.id_of = {self.bytes_of[i]: i for t, i in vocab.items() if len(self.bytes_of[i]) == 1 or self.born[i] >= 0}
        self.id_of = {b: i for b, i in self.id_of.items() if len(b) == 1 or self.merge(b) == [i]}
        #: length of the longest entry by its first three bytes
        self.reach: dict[bytes, int] = {}
        for b in self.id_of:
            self.reach[b[:3]] = max(len(b), self.reach.get(b[:3], 2))
        self.word = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        #: words of late and, behind them, of a generation ago
        self.cache_words = CACHE_WORDS
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def check(spec: dict) -> None:
        m, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = m["type"] == "BPE" and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, leftmost first among equals."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n, rank, none = len(ids), self.rank, (1 << 40, 0)
        if n <= 24:  # a few passes over so short a list beat a heap
            while n > 1 and (low := min(ranked := [rank.get(p, none) for p in zip(ids, ids[1:])])) is not none:
                k = ranked.index(low)
                ids[k : k + 2] = [low[1]]
                n -= 1
            return ids
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = z, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if p := self.rank.get((z, ids[after[j]])):
                    heapq.heappush(heap, (p[0], i, z, ids[after[j]], p[1]))
            if (k := before[i]) >= 0 and (p := self.rank.get((ids[k], z))):
                heapq.heappush(heap, (p[0], k, ids[k], z, p[1]))
        return [t for t in ids if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy cut into the longest entries."""
        out, i, n, known, reach = [], 0, len(word), self.id_of, self.reach
        while i < n:
            for j in range(min(n, i + reach.get(word[i : i + 3], 2)), i, -1):
                if (t := known.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of entries side by side, whether merging leaves the border between them."""
        fine = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        end = np.iinfo(np.int64).max
        gone_x, gone_y = np.full(len(a), end), np.full(len(a), end)
        while len(at):
            key = (x << 32) | y
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[k] == key, self.pair_ranks[k], end)
            # of two uses of one rule the left one comes first: at equal rank the left part is gone already
            cross = (rank < gone_x) & (rank <= gone_y) & (rank < end)
            fine[at[cross]] = False
            bx, by = self.born[x], self.born[y]
            go = ~cross & ((bx >= 0) | (by >= 0))
            at, x, y, gone_x, gone_y, bx, by = (v[go] for v in (at, x, y, gone_x, gone_y, bx, by))
            undo = bx > by  # the later of the two; the right one where one rule made both
            gone_x, x = np.where(undo, bx, gone_x), np.where(undo, self.right[x], x)
            gone_y, y = np.where(undo, gone_y, by), np.where(undo, y, self.left[y])
        return fine

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Packed ids of words not in the cache."""
        raw = [w.encode() for w in new]
        tried = [self.propose(b) for b in raw]
        sizes = np.fromiter(map(len, tried), np.int64, len(tried))
        flat = np.fromiter((t for ids in tried for t in ids), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(new)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        failed = set(word[inner[~good]].tolist())
        return {
            w: pack(self.merge(raw[i]) if i in failed else tried[i]) for i, w in enumerate(new)
        }

    def split(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and ids of special tokens between them."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield self.word.findall(text[at : m.start()])
            yield self.specials[m[0]]
            at = m.end()
        yield self.word.findall(text[at:] if at else text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [[*self.split(t)] if t else [] for t in texts]
        if len(self.cache) > self.cache_words:
            self.cache, self.older = {}, self.cache
        known, older = self.cache, self.older
        need: set[str] = set()
        for p in parts:
            for ws in p:
                if isinstance(ws, list):
                    need.update(ws)
        need.difference_update(known)
        for w in [*need & older.keys()]:
            known[w] = older[w]
            need.discard(w)
        new = self.learn(sorted(need))
        known.update((w, v) for w, v in new.items() if len(w) <= CACHE_LONGEST)
        out = []
        for p in parts:
            pieces = []
            for ws in p:
                if not isinstance(ws, list):
                    pieces.append(pack([ws]))
                elif new:
                    pieces += [known.get(w) or new[w] for w in ws]
                else:
                    pieces += [known[w] for w in ws]
            out.append(b"".join(pieces))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def _chunks(texts: list, most: int = 1_000_000) -> Iterator[list]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _run(docs: DataFrame, path: str, kept: list[str], columns: dict[str, str], cache_words: int) -> DataFrame:
    """The columns ``kept`` and some of ids, decoded, n_tokens, ids_sha256 and decoded_sha256 (name to type), made in one pass over the texts."""
    small_batches(docs.sparkSession)
    made = {
        "ids": lambda packed, at, texts: pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(packed), "<i4"))),
        "decoded": lambda packed, at, texts: pa.array(texts, pa.string()), "n_tokens": lambda packed, at, texts: pa.array(np.diff(at).astype(np.int64)),
        "ids_sha256": lambda packed, at, texts: pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
        "decoded_sha256": lambda packed, at, texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        bpe.cache_words = cache_words
        for b in batches:
            row = 0
            for texts in _chunks(b.column(len(kept)).to_pylist()):
                packed = bpe.encode_batch(texts)
                at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                decoded = [bpe.decode(p) for p in packed] if {"decoded", "decoded_sha256"} & columns.keys() else []
                same = [b.column(k).slice(row, len(texts)) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*same, *(made[c](packed, at, decoded) for c in columns)], [*kept, *columns])
                row += len(texts)

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {t}" for c, t in columns.items()]
    return docs.select(*kept, "text").mapInArrow(run, ", ".join(kinds))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, the token ids and the text decoded from them, of every row."""
    return _run(docs, path, ["doc_id"], {"ids": "array<int>", "decoded": "string"}, CACHE_WORDS)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, digested where the ids are made."""
    return _run(docs, path, ["doc_id"], {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, CACHE_WORDS)


def tokens(docs: DataFrame, path: str, cache_words: int = 90_000) -> DataFrame:
    """doc_id, source and lang with the ids, their number and the digests, from one pass. The cache is smaller than by default, as
    workers still hold memory from the stages before."""
    kept = [c for c in docs.columns if c in ("doc_id", "source", "lang")]
    return _run(docs, path, kept, {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, cache_words)


def op9(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
