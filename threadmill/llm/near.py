"""Exact n-gram Jaccard join by T-occurrence search.

A document's set holds the hashes of its distinct k-word shingles; documents with equal sets are one node from the
start. Two nodes link when ``den * intersection >= num * union``.

1. Candidates. At that similarity two sets of at most U shingles differ in at most d = 2U (1 - t) / (1 + t) places. Cutting the
   hash space into d + 1 + slack buckets leaves at least 1 + slack of them equal in both sets. Each node emits the
   hash of each of its buckets for the size level of its own and for the next (a partner's sizes reach no further).
   Buckets with fewer than two shingles that are not corpus-wide commonplaces are weak and stay out as long as a node has no
   more of them than the slack, so one shared line does not make candidates. This loses no pair, whatever counts as commonplace: of two
   such nodes' equal buckets, 1 + slack or more, at most slack are weak. A node with more weak buckets emits all that are not empty, and
   if these are no more than d, so many empty ones that d + 1 are out, in one order for all nodes. Of the 1 + slack
   buckets or more that it shares with a partner with few weak ones, one at least is strong; a partner with many, which also holds back only the end of that order and at most m - d - 1
   buckets, shares at least one of the m - d equal buckets among those that both emit. How many signatures a node must share at least
   (``need``) follows from the same count, and is never more than any partner of its grants. Nodes that meet in a bucket are tied into
   candidate groups by connected components where parity sketches allow the similarity; a bucket in which very many
   nodes meet ties them all without a look, by a join that Spark splits.
2. Search. Each group's sets are dealt to tasks, large groups as pairs of blocks, by documents and by shingles. A task builds inverted lists of one block
   and searches them with each set of the other: the longest lists are set aside (DivideSkip), the short ones are
   merged, and nodes that reach the required overlap less the lists set aside are looked up in the long ones by binary search.
3. Links found are counted for both ends and joined into components.

Exact copies never meet as pairs; a task holds at most COMPARED nodes of a bucket and two blocks of sets.

Edge cases: null and empty texts have no shingles and link with nothing; a text of fewer than k words is one
shingle; repeated rows are copies of each other; a null doc_id takes part but is no component's id unless the component
has no other; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import arrow_rows, bitmap, by_bytes, discard, in_bitmap, small_batches, staged, tidy, utf8
from .components import components

#: Documents of a block, and their shingles; commonplaces kept at most, and their least share of a batch; postings merged by a heap at most;
#: nodes that meet in one bucket and are compared by sketch (more are tied without a look, which only makes groups larger); rows broadcast at most.
BLOCK, BLOCK_SHINGLES, COMMON, COMMON_SHARE, HEAP, COMPARED, BROADCAST_ROWS = 256, 1 << 20, 20_000, 0.01, 2048, 4096, 100_000
_MU = 0.0085  # weight of a probe against a merge step in DivideSkip


@dataclass
class Rule:
    k: int
    num: int
    den: int

    def __post_init__(self) -> None:
        #: least size of each level: a set's partner is of its level, the next or the one before
        sizes = [1, 2]
        while sizes[-1] < 1 << 40:
            sizes.append(max(sizes[-1] + 1, (sizes[-1] - 1) * self.den // self.num + 1))
        self.levels = np.array(sizes, np.int64)

    def level(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.levels, n, "right") - 1

    def differ(self, level: np.ndarray) -> np.ndarray:
        """Values in which two sets of a level and similar enough differ at most."""
        return 2 * (self.levels[level + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    @property
    def least_strong(self) -> int:
        """Values, commonplaces not counted, that a bucket must hold: two, where buckets are full enough for that."""
        return 2 if (self.num / self.den) ** 2 * (self.den + self.num) >= 8 * (self.den - self.num) else 1

    def buckets(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of buckets and slack of a level: a tenth more than has to be, so that partners share several."""
        most = self.levels[level + 1] - 1
        differ = self.differ(level)
        load = most * (self.num / self.den) ** 2 / (differ + 1.0)
        share = np.zeros(len(load))
        for _ in range(8):  # share of buckets that are too empty, at the least load
            at = load * (1 - share)
            share = np.minimum(0.6, 1.4 * np.exp(-at) * (1 + at * (self.least_strong - 1)))
        m = np.ceil((1.1 * differ + 5) / (1 - share)).astype(np.int64)
        return m, m - differ - 1

    def links(self, both: np.ndarray, n: int, others: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (n + others - both)

    def apart(self, n: int, others: np.ndarray) -> np.ndarray:
        """Values in which sets of these sizes differ at most if they link."""
        return (n + others) * (self.den - self.num) // (self.den + self.num)

    def least_overlap(self, n: int, smallest: int) -> int:
        other = max(smallest, -(-self.num * n // self.den))
        return max(1, -(-self.num * (n + other) // (self.num + self.den)))


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _short(digests: list[bytes | None]) -> list[int | None]:
    return [None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in digests]


def _sets(b: pa.RecordBatch, column: int, k: int, keep: np.ndarray | None = None):
    """Per slice of a batch: first row, values, offsets."""
    texts = b.column(column)
    if keep is not None:
        texts = texts.filter(pa.array(keep))
    data, at = utf8(texts)
    for i, j in by_bytes(at):
        values, offs = hashing.shingle_sets(data, at[i : j + 1], "plain", k)
        yield i, values, offs


def sketches(values: np.ndarray, offs: np.ndarray, rule: Rule) -> list[bytes]:
    """Parity sketch of each set: a power of two of bits, at least 64, and enough that those of unlike sets, which differ in
    nearly half of their bits, differ in more than linked sets may in values."""
    n = np.diff(offs)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(3.5 * rule.apart(n, n), 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    rows = np.repeat(np.arange(len(n)), n)
    place = (hashing.mix(values) & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(base[rows] + place, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[base[i] // 8 : base[i + 1] // 8] for i in range(len(n))]


def documents(docs: DataFrame, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n and the set's digest (null: empty) of every row, and the sorted commonplaces."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, values, offs in _sets(b, 1, rule.k):
                n = np.diff(offs)
                digests = [_digest(values[offs[r] : offs[r + 1]]) if n[r] else None for r in range(len(n))]
                nulls = [None] * len(n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(n)), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(_short(digests), pa.int64()), pa.array(sketches(values, offs, rule), pa.binary()), pa.array(nulls, pa.int64()), pa.array(nulls, pa.int64())], names)
                v, c = np.unique(values, return_counts=True)
                often = c >= max(4, COMMON_SHARE * len(n))
                v, c = v[often], c[often]
                if len(v):
                    ids = pa.nulls(len(v), b.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array([None] * len(v), pa.int64()), pa.array([None] * len(v), pa.binary()), pa.array([None] * len(v), pa.int64()), pa.array([None] * len(v), pa.binary()), pa.array(v.view(np.int64)), pa.array(c, pa.int64())], names)

    names = ["doc_id", "n", "digest", "node", "sketch", "common", "times"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, digest binary, node bigint, sketch binary, common bigint, times bigint")
    rows = staged(rows, "near-docs")
    top = rows.where("common is not null").groupBy("common").agg(F.sum("times").alias("t")).orderBy(F.desc("t"), "common").limit(COMMON)
    common = np.sort(np.array([r["common"] for r in top.collect()], np.int64).view(np.uint64))
    return rows.where("n is not null").select("doc_id", "n", "digest", "node", "sketch"), common


def signatures(values: np.ndarray, offs: np.ndarray, rule: Rule, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, need) of the sets' buckets. need: twice the number of the row's signatures of this level and need that a
    partner shares at least, plus the step of the level, so that it also tells the two levels of a row apart. The weak
    signatures of a row with too many of them are counted on their own: they matter only to partners that share no strong one."""
    n = np.diff(offs)
    rows = np.repeat(np.arange(len(n)), n)
    plain = np.ones(len(values), bool)
    if len(common):
        k = np.minimum(np.searchsorted(common, values), len(common) - 1)
        plain = common[k] != values
    scrambled = hashing.mix(values ^ np.uint64(0x5851F42D4C957F2D))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in (0, 1):
        level = rule.level(np.maximum(n, 1)) + step
        m, slack = rule.buckets(level)
        # values are sorted within a row, so a bucket's values stand together
        bucket = ((values >> np.uint64(32)) * m[rows].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        first = np.ones(len(values), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (bucket[1:] != bucket[:-1])
        start = np.flatnonzero(first)
        if not len(start):
            continue
        row, place = rows[start], bucket[start]
        strong = np.add.reduceat(plain.astype(np.int64), start) >= rule.least_strong
        total = np.add.reduceat(scrambled, start)
        weak = m - np.bincount(row, weights=strong, minlength=len(n)).astype(np.int64)
        everything = weak > slack
        differ = rule.differ(level)
        filled = np.bincount(row, minlength=len(n))
        # a partner that is just below that border shares its strong buckets only, as few as equal - slack; one beyond it
        # has at least filled - differ buckets that are not empty, and emits d + 1 at least
        need = 2 * (m - differ - np.minimum(weak, slack)) + step
        alone = 2 * np.maximum(1, filled - 2 * differ) + step
        salt = hashing.mix((level[row].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64))
        keep = strong | everything[row]
        out.append((row[keep], hashing.mix(total[keep] + salt[keep]), np.where(strong, need[row], alone[row])[keep]))
        for r in np.flatnonzero(everything & (n > 0) & (filled <= differ)):
            empty = np.setdiff1d(np.arange(m[r]), place[row == r], assume_unique=True)
            sig = hashing.mix(hashing.mix((np.uint64(level[r]) << np.uint64(40)) + empty.astype(np.uint64)) + np.uint64(1))
            sig = np.sort(sig)[: int(differ[r] + 1 - filled[r])]
            out.append((np.full(len(sig), r), sig, np.full(len(sig), alone[r])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def candidate_groups(docs: DataFrame, nodes: DataFrame, rule: Rule, common: np.ndarray) -> DataFrame:
    """(node, root): nodes (short digests) that may link, by group."""
    spark = docs.sparkSession

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, values, offs in _sets(b, 0, rule.k):
                n = np.diff(offs)
                own = np.array(_short([_digest(values[offs[r] : offs[r + 1]]) if n[r] else b"\0" * 8 for r in range(len(n))]), np.int64)
                # copies within a task emit once
                new = np.array([x not in seen and n[r] > 0 and not seen.add(x) for r, x in enumerate(own.tolist())], bool)
                if len(seen) > 250_000:
                    seen.clear()
                row, sig, need = signatures(values, offs, rule, common)
                keep = new[row]
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(own[row[keep]]), pa.array(need[keep], pa.int32())], ["sig", "node", "need"])

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, in the order of sig and node, whose sig more than one node has; each node once."""
        held: list[np.ndarray] | None = None  # the last row of the batch before, and whether it has been let through
        through = False
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            sig, node, _ = cols
            if not len(sig):
                continue
            same = np.zeros(len(sig) + 1, bool)
            same[1:-1] = sig[1:] == sig[:-1]
            copy = np.zeros(len(sig), bool)
            copy[1:] = same[1:-1] & (node[1:] == node[:-1])
            other = same[1:-1] & ~copy[1:]  # a row that meets the one before it
            meets = np.zeros(len(sig), bool)
            group = np.cumsum(~same[:-1])
            met = np.zeros(group[-1] + 1, bool)
            met[group[1:][other]] = True
            if through and held is not None:
                met[group[0]] = True
            meets = met[group] & ~copy
            if through and held is not None:
                meets[0] = False
            # the last group may go on in the next batch: hold back its first row if it stands alone so far
            through = bool(met[group[-1]])
            held = [c[-1:] for c in cols]
            if meets.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[meets]) for c in cols], ["sig", "node", "need"])

    @tidy
    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, held = None, []
        for b in batches:
            edges: list[tuple[int, int]] = []
            for s, *x in zip(*(c.to_pylist() for c in b.columns)):
                if s != sig:
                    edges += ties(held, rule)
                    sig, held = s, []
                held.append(x)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])
        if edges := ties(held, rule):
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    sigs = docs.select("text").mapInArrow(emit, "sig bigint, node bigint, need int")
    met = sigs.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(meet, "sig bigint, node bigint, need int")
    # texts are scanned in small batches; the stream of signatures could take larger ones
    met = staged(met, "near-met")
    enough = met.groupBy("node", "need").agg(F.count("*").alias("c")).where(F.col("c") >= F.shiftright("need", 1)).select("node", "need")
    # a bitmap lets some more through, which the sketches drop, and spares a shuffle of all that met
    enough = staged(enough.select(F.xxhash64("node", "need").alias("h")), "near-enough")
    seen = bitmap(enough, "h", int(np.clip(np.ceil(np.log2(64 * enough.count() + 1)), 16, 26)))

    @tidy
    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = in_bitmap(seen, b.column(0).to_numpy())
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(b.column(c).to_numpy()[keep]) for c in (1, 2)], ["sig", "node"])

    kept = met.select(F.xxhash64("node", "need").alias("h"), "sig", "node").mapInArrow(stay, "sig bigint, node bigint")
    hot = staged(met.groupBy("sig").agg(F.count("*").alias("c"), F.min("node").alias("least")).where(F.col("c") > COMPARED).select("sig", "least"), "near-hot")
    n_hot, stars = hot.count(), None
    if n_hot:
        few = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        stars = kept.join(few, "sig").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
        kept = kept.join(few, "sig", "left_anti")
    sketch = nodes.groupBy("node").agg(F.max("n").alias("n"), F.min("sketch").alias("sketch"))
    kept = kept.join(sketch.hint("merge"), "node").select("sig", "node", "n", "sketch")
    edges = kept.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(tie, "a bigint, b bigint")
    edges = staged((edges.unionAll(stars) if stars is not None else edges).distinct(), "near-edges")
    discard(met, enough, hot)
    groups = staged(components(edges), "near-groups")
    discard(edges)
    return groups


def ties(rows: list[list], rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the nodes (node, n, sketch) whose sketches differ in no more bits than linked sets in values."""
    if len(rows) < 2:
        return []
    rows = sorted(rows, key=lambda x: (len(x[2]), x[1], x[0]))
    sizes = np.array([x[1] for x in rows])
    words = [np.frombuffer(x[2], np.uint64) for x in rows]
    width = np.array([len(w) for w in words])
    free, out = np.ones(len(rows), bool), []
    # grow one tree after the other: what a node ties to leaves the pool
    for root in range(len(rows)):
        if not free[root]:
            continue
        free[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            pool = np.flatnonzero(free)
            for w in np.unique(width[pool]):
                at = pool[width[pool] == w]
                mine, theirs = words[i], np.stack([words[j] for j in at])
                # the longer sketch folds onto the shorter: halves are added modulo two
                while len(mine) > theirs.shape[1]:
                    mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]
                while theirs.shape[1] > len(mine):
                    theirs = theirs[:, : theirs.shape[1] // 2] ^ theirs[:, theirs.shape[1] // 2 :]
                differ = np.bitwise_count(theirs ^ mine).sum(1)
                near = at[differ <= rule.apart(int(sizes[i]), sizes[at])]
                free[near] = False
                todo += near.tolist()
                out += [(rows[i][0], rows[j][0]) for j in near.tolist()]
    return out


class Lists:
    """Inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, values))
        self.owner = owner[order]
        self.keys, self.start = np.unique(values[order], return_index=True)
        self.length = np.diff(np.append(self.start, len(values)))

    def search(self, query: np.ndarray, rule: Rule) -> np.ndarray:
        """Indices of the block's sets that link with ``query``."""
        m = len(self.sizes)
        k = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        k = k[self.keys[k] == query]
        need = rule.least_overlap(len(query), int(self.sizes.min()))
        if len(k) < need:
            return np.zeros(0, np.int64)
        k = k[np.argsort(self.length[k], kind="stable")]
        aside = int(need / (_MU * np.log2(m + 1) + 1)) if m > 1 else 0
        aside = min(aside, need - 1, len(k))
        short, long = k[: len(k) - aside], k[len(k) - aside :]
        count = self.merge(short, m)
        candidates = np.flatnonzero(count >= need - aside)
        count = count[candidates]
        for x in long.tolist():
            own = self.owner[self.start[x] : self.start[x] + self.length[x]]
            at = np.searchsorted(own, candidates)
            count += own[np.minimum(at, len(own) - 1)] == candidates
        return candidates[rule.links(count, len(query), self.sizes[candidates])]

    def merge(self, lists: np.ndarray, m: int) -> np.ndarray:
        """Occurrences of each set in the lists: a heap merge of few postings, a counting merge of many."""
        total = int(self.length[lists].sum())
        if total <= HEAP:
            runs = [self.owner[self.start[x] : self.start[x] + self.length[x]].tolist() for x in lists.tolist()]
            heap = [(r[0], i, 0) for i, r in enumerate(runs)]
            heapq.heapify(heap)
            count = np.zeros(m, np.int64)
            while heap:
                doc, i, at = heap[0]
                count[doc] += 1
                if at + 1 < len(runs[i]):
                    heapq.heapreplace(heap, (runs[i][at + 1], i, at + 1))
                else:
                    heapq.heappop(heap)
            return count
        at = np.repeat(self.start[lists] - np.cumsum(self.length[lists]) + self.length[lists], self.length[lists]) + np.arange(total)
        return np.bincount(self.owner[at], minlength=m)


def search_task(nodes: list[bytes], sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, rule: Rule):
    """Links and a spanning forest of a task. side 0: search among themselves; 1: search 2's lists."""
    alike = bool((side == 0).all())
    queries, index = (np.arange(len(nodes)),) * 2 if alike else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    links, parent, forest = np.zeros(len(nodes), np.int64), list(range(len(nodes))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(queries) and len(index):
        lists = Lists([sets[i] for i in index])
        for q in queries.tolist():
            for r in index[lists.search(sets[q], rule)].tolist():
                if r == q:
                    continue
                links[q] += copies[r]
                if not alike:
                    links[r] += copies[q]
                if (x := find(q)) != (y := find(r)):
                    parent[x] = y
                    forest.append((nodes[q], nodes[r]))
    return links, forest


def join(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, digest, component_id and n_links (documents it links with, copies included) of every row."""
    spark = docs.sparkSession
    with arrow_rows(spark, 512):
        rows, common = documents(docs, rule)
        nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("node").alias("node"), F.min("sketch").alias("sketch"))
        nodes = staged(nodes, "near-nodes")
        groups = candidate_groups(docs, nodes, rule, common)
        found = staged(nodes.join(groups, "node").select("digest", "first", "copies", "n", "root"), "near-found")

        # one task for a small group, pairs of blocks for a large one
        level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(rule.den / rule.num)) + 1e-9).cast("int")
        met = found.withColumn("level", level)
        # no block has more than BLOCK sets or BLOCK_SHINGLES shingles or so; a longer set stands alone
        share = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
        whole = staged(met.groupBy("root").agg((share <= 1).alias("small")), "near-sizes")
        parts = staged(met.groupBy("root", "level").agg(share.cast("int").alias("blocks")), "near-levels")
        dealt = met.join(whole, "root").join(parts, ["root", "level"])
        dealt = dealt.withColumn("blocks", F.when(F.col("small"), 1).otherwise(F.col("blocks"))).withColumn("level", F.when(F.col("small"), -1).otherwise(F.col("level")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
        dealt = staged(dealt.select("digest", "first", "copies", "root", "level", "block"), "near-dealt")
        many = dealt.where("level >= 0").select("root", "level", "block").distinct()
        other = many.select("root", F.col("level").alias("l2"), F.col("block").alias("b2"))
        near = (F.col("l2") - F.col("level")).between(0, 2) & ((F.col("l2") > F.col("level")) | (F.col("b2") >= F.col("block")))
        meets = staged(many.join(other, "root").where(near), "near-meets")
        task = F.xxhash64("root", "level", "block", "l2", "b2")
        same = (F.col("level") == F.col("l2")) & (F.col("block") == F.col("b2"))
        ends = meets.select("root", "level", "block", task.alias("task"), F.when(same, 0).otherwise(1).alias("side")).unionAll(
            meets.where(~same).select("root", F.col("l2").alias("level"), F.col("b2").alias("block"), task.alias("task"), F.lit(2).alias("side")))
        jobs = dealt.where("level >= 0").join(ends, ["root", "level", "block"]).select("digest", "copies", "task", "side").unionAll(
            dealt.where("level < 0").select("digest", "copies", F.xxhash64("root").alias("task"), F.lit(0).alias("side")))

        sets = candidate_sets(docs, dealt, rule)
        jobs = jobs.join(sets, "digest").repartition("task").sortWithinPartitions("task", "side", "digest")
        links = staged(jobs.select("task", "digest", "copies", "side", "set").mapInArrow(_searcher(rule), "a binary, b binary, links bigint"), "near-links")
        discard(groups, found, whole, parts, dealt, meets)

    roots = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "digest")
    roots = staged(roots, "near-roots")
    counts = staged(links.where("links > 0").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("others")), "near-counts")
    named = staged(nodes.join(roots, "digest").select("digest", "root", "first"), "near-named")
    ids = staged(named.groupBy("root").agg(F.min("first").alias("component_id")), "near-ids")
    linked = staged(named.join(ids, "root").join(counts, "digest", "left").select("digest", "component_id", F.coalesce("others", F.lit(0)).alias("others")), "near-linked")
    # only nodes with copies or links need to be looked up
    known = staged(nodes.join(linked, "digest", "left").where("copies > 1 or component_id is not null").select(
        "digest", F.coalesce("component_id", "first").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-known")
    discard(links, roots, counts, named, ids, linked, nodes)
    return rows.join(known, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "digest")


def candidate_sets(docs: DataFrame, dealt: DataFrame, rule: Rule) -> DataFrame:
    """digest and set of the nodes in groups, and of a few more. A bitmap of their first documents' ids spares the other texts the hashing."""
    marked = dealt.select(F.xxhash64("first").alias("h"))
    bits = int(np.clip(np.ceil(np.log2(256 * marked.count() + 1)), 16, 26))
    seen = bitmap(marked, "h", bits)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = in_bitmap(seen, b.column(0).to_numpy())
            if keep.any():
                for _, values, offs in _sets(b, 1, rule.k, keep):
                    some = [values[offs[r] : offs[r + 1]] for r in np.flatnonzero(np.diff(offs))]
                    yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in some], pa.binary()), pa.array([s.tobytes() for s in some], pa.binary())], ["digest", "set"])

    sets = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "digest binary, set binary")
    return sets.groupBy("digest").agg(F.min("set").alias("set"))


def _searcher(rule: Rule):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def flush() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            nodes = [x[0] for x in held]
            links, forest = search_task(nodes, [np.frombuffer(x[3], np.uint64) for x in held], np.array([x[1] for x in held]), np.array([x[2] for x in held]), rule)
            some = np.flatnonzero(links).tolist()
            a = [nodes[i] for i in some] + [x for x, _ in forest]
            b = [None] * len(some) + [y for _, y in forest]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([int(links[i]) for i in some] + [0] * len(forest), pa.int64())], ["a", "b", "links"])

        for b in batches:
            for t, *row in zip(*(c.to_pylist() for c in b.columns)):
                if t != task:
                    if (out := flush()) is not None:
                        yield out
                    task, held = t, []
                held.append(row)
        if (out := flush()) is not None:
            yield out

    return run


def with_digest(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` with the digest of each text's set (null: empty)."""
    small_batches(docs.sparkSession)  # the plan runs when its caller writes it
    names, text = [*docs.columns, "digest"], docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests: list[bytes | None] = []
            for _, values, offs in _sets(b, text, rule.k):
                digests += [_digest(values[offs[r] : offs[r + 1]]) if offs[r + 1] > offs[r] else None for r in range(len(offs) - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.binary())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, digest binary")


def op6(docs: DataFrame) -> DataFrame:
    return join(docs, Rule(4, 85, 100)).select("doc_id", "n_shingles", "component_id", "n_links")


OP6_SQL = """
WITH RECURSIVE base AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS s
       FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM base WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
met AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY 1, 2),
link AS (SELECT x, y FROM met JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT rid, rid FROM base UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
comp AS (SELECT r.x AS rid, min(doc_id) AS component_id FROM reach r JOIN base ON base.rid = r.y GROUP BY 1),
deg AS (SELECT x AS rid, count(*) AS d FROM link GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(d, 0)::BIGINT AS n_links
FROM base JOIN comp USING (rid) LEFT JOIN n USING (rid) LEFT JOIN deg USING (rid)
"""
