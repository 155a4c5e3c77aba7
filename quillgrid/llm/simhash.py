"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64 majority bits over XXH64 hashes of word shingles.
Distinct fingerprints are dealt into buckets: with at most ``RADIUS`` = 2
differing bits, two of the four 16-bit quarters agree, so each pair of
quarters is a bucket key and no link is missed. Within a bucket fingerprints
are stored as vertical bit planes (64 fingerprints to a word); a query's
distances to a block are counted by carry-save bitwise counters, plane by
plane, and a block is abandoned once all its lanes exceed the radius. Buckets
that hold more than their share of all fingerprints are dealt again by Spark,
by pairs of bytes of the bits not yet fixed, before any task gets them;
buckets beyond ``SPLIT`` are dealt again within a task in the same manner.
Neither misses a link. Links leave a bucket as stars, never as all pairs.

Null and empty texts have fingerprint zero and link like any other. Equal
texts have equal fingerprints and meet before any comparison, as do repeated
rows, of which each keeps its row; very long texts are read whole. A null doc_id
keeps its row; a group has the smallest id that is not null. An empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import HOT, join_hot, materialise
from quillgrid.llm.components import components
from quillgrid.llm.kernels import TO_LOWER

SHINGLE = 3
RADIUS = 2
SPLIT = 4096
#: Rows that are compared in one go, and (query, block) tasks held at once.
GATHER, TASKS = 16_384, 1 << 18


def fingerprint(raw: bytes | None, width: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingle hashes."""
    words = (raw or b"").translate(TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :][:k]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:k].tolist(), last.tolist(), strict=True)), np.uint64, k)
    ones = np.zeros(64, np.int64)
    for at in range(0, k, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's 64 bits as a signed long. With ``keyed`` text_key, the text's hash, as well."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1).cast(pa.large_binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found.view(np.int64))], names=["doc_id", *batch.schema.names[2:], "fp"])

    text = F.col("text").cast("string")
    key = [F.xxhash64(text).alias("text_key")] if keyed else []
    return docs.select(F.col("doc_id").cast("long"), text, *key).mapInArrow(work, "doc_id long, text_key long, fp long" if keyed else "doc_id long, fp long")


def _planes(values: np.ndarray) -> np.ndarray:
    """(blocks, 64) words: bit i of word b of a block is bit b of its i-th value. The length is a multiple of 64."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    words = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(words).view("<u8").reshape(-1, 64)


def _near(planes: np.ndarray, queries: np.ndarray, blocks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For tasks (query value, block): the tasks with lanes within the radius, and the masks of those lanes."""
    alive = np.arange(len(queries))
    digits = [np.zeros(len(queries), np.uint64) for _ in range(max(1, int(radius + 1).bit_length()))]
    over = np.zeros(len(queries), np.uint64)
    for bit in range(64):
        # All ones where the query's bit is set: the word then holds the lanes that differ.
        carry = planes[blocks, bit] ^ (np.uint64(0) - ((queries >> np.uint64(bit)) & np.uint64(1)))
        for d in digits:
            d ^= carry
            carry &= ~d
        over |= carry
        if bit % 4 == 3:
            beyond = over.copy()
            high, equal = np.zeros(len(over), np.uint64), ~np.zeros(len(over), np.uint64)
            for k in range(len(digits) - 1, -1, -1):  # counter > radius, lane by lane
                if radius >> k & 1:
                    equal &= digits[k]
                else:
                    high |= equal & digits[k]
                    equal &= ~digits[k]
            over = beyond | high
            keep = over != ~np.uint64(0)
            if not keep.all():
                alive, queries, blocks, over = alive[keep], queries[keep], blocks[keep], over[keep]
                digits = [d[keep] for d in digits]
            if not len(alive):
                break
    return alive, ~over


class _Forest:
    """Union by smallest index, vectorised."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            far = a != b
            a, b = a[far], b[far]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def root(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while (y := self.up[x]).tobytes() != x.tobytes():
            x = y
        return x


def link_groups(values: np.ndarray, first: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For groups of distinct fingerprints laid end to end (``first`` are their starts), the index of the root of each value's component within its group."""
    sizes = np.diff(np.append(first, len(values)))
    blocks_of = -(-sizes // 64)
    block_at = np.concatenate([[0], np.cumsum(blocks_of)])
    group = np.repeat(np.arange(len(first)), sizes)
    place = np.arange(len(values)) - first[group]
    lane = block_at[group] * 64 + place
    held = np.zeros(block_at[-1] * 64, np.uint64)
    held[lane] = values
    index = np.full(len(held), -1)
    index[lane] = np.arange(len(values))
    planes = _planes(held)
    forest = _Forest(len(values))
    ahead = blocks_of[group] - place // 64  # each pair once: a query meets its own block and the later ones
    ends = np.cumsum(ahead)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TASKS, "right")))
        n = ahead[at:to]
        who = np.repeat(np.arange(at, to), n)
        step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        block = block_at[group[who]] + place[who] // 64 + step
        tasks, lanes = _near(planes, values[who], block, radius)
        while len(tasks):  # peel off the lowest lane of every mask
            low = lanes & (~lanes + np.uint64(1))
            j = index[block[tasks] * 64 + np.bitwise_count(low - np.uint64(1))]
            ok = (j >= 0) & (j != who[tasks])
            forest.link(who[tasks][ok], j[ok])
            lanes = lanes & ~low
            more = lanes != 0
            tasks, lanes = tasks[more], lanes[more]
        at = to
    return forest.root(np.arange(len(values)))


def _link_large(values: np.ndarray, fixed: frozenset[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within one group: compared whole, or dealt again by 16 of the bits that are not yet fixed."""
    free = [b for b in range(64) if b not in fixed]
    if len(values) <= SPLIT or len(free) < 16:
        yield values, values[link_groups(values, np.zeros(1, np.int64), radius)]
        return
    parts = np.array_split(np.array(free), radius + 2)
    for chosen in combinations(range(radius + 2), 2):
        bits = np.concatenate([parts[c] for c in chosen])
        key = np.zeros(len(values), np.uint64)
        for i, b in enumerate(bits):
            key |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(values[order], cuts):
            if len(part) > 1:
                yield from _link_large(part, fixed | frozenset(bits.tolist()), radius)


#: The buckets: pairs of 16-bit quarters.
PAIRS = tuple(combinations(range(4), 2))
#: By pair, where the four bytes of the two other quarters begin.
_REST = tuple(tuple(16 * c + half for c in range(4) if c not in pair for half in (0, 8)) for pair in PAIRS)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Stars (u, v) that connect distinct fingerprints ``fp`` within ``radius`` <= 2 bits."""
    if radius > 2:
        raise ValueError("pairs of quarters find links of up to two bits")
    quarter = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*(F.lit(i << 32).cast("long") + F.shiftleft(quarter(a), 16) + quarter(b) for i, (a, b) in enumerate(PAIRS)))
    dealt = nodes.select("fp", F.explode(keys).alias("k"))
    # A bucket beyond its share is dealt again, before any task gets it: of the 32 bits not fixed, two of four bytes agree.
    # There are fewer than HOT such buckets, whatever the data are.
    total = nodes.count() * len(PAIRS)
    hot = materialise(dealt.groupBy("k").count().filter(F.col("count") > max(SPLIT, total / HOT)).select("k"))
    if hot.isEmpty():
        dealt = dealt.withColumn("part", F.lit(-1).cast("long"))
    else:
        byte = lambda j: F.element_at(F.array(*(F.shiftrightunsigned("fp", starts[j]).bitwiseAND(F.lit(0xFF)) for starts in _REST)), F.shiftright("k", 32).cast("int") + 1)
        parts = F.array(*(F.lit(i << 16).cast("long") + F.shiftleft(byte(a), 8) + byte(b) for i, (a, b) in enumerate(PAIRS)))
        hubs = F.broadcast(hot)
        cold = dealt.join(hubs, "k", "left_anti").withColumn("part", F.lit(-1).cast("long"))
        dealt = cold.unionByName(dealt.join(hubs, "k").withColumn("part", F.explode(parts)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)

        def compare(k: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])
            sizes = np.diff(cuts)
            large = sizes > SPLIT
            some = np.repeat((sizes > 1) & ~large, sizes)
            found = []
            if some.any():
                values, n = v[some], sizes[(sizes > 1) & ~large]
                found.append((values, values[link_groups(values, np.cumsum(n) - n, radius)]))
            for g in np.flatnonzero(large):
                pair, part = k[cuts[g]].tolist()
                fixed = frozenset(x for c in PAIRS[pair >> 32] for x in range(16 * c, 16 * c + 16))
                if part >= 0:
                    fixed |= frozenset(x for c in PAIRS[part >> 16] for x in range(_REST[pair >> 32][c], _REST[pair >> 32][c] + 8))
                found += _link_large(v[cuts[g] : cuts[g + 1]], fixed, radius)
            for u, root in found:
                far = u != root
                yield pa.RecordBatch.from_arrays([pa.array(u[far].view(np.int64)), pa.array(root[far].view(np.int64))], names=["u", "v"])

        for batch in batches:
            held_k = np.concatenate([held_k, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)], axis=1)])
            held_v = np.concatenate([held_v, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(held_k) >= GATHER:
                whole = int((held_k != held_k[-1]).any(axis=1).sum())  # the last group, which may go on, stands at the end
                if whole:
                    yield from compare(held_k[:whole], held_v[:whole])
                    held_k, held_v = held_k[whole:], held_v[whole:]
        if len(held_k):
            yield from compare(held_k, held_v)

    return dealt.select("fp", "k", "part").repartition("k", "part").sortWithinPartitions("k", "part", "fp").mapInArrow(work, "u long, v long")


def _grouped(prints: DataFrame, least: Column, radius: int) -> DataFrame:
    """``prints`` with component_id: the least ``least`` over the fingerprints reachable over links."""
    nodes = materialise(prints.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("copies")))
    roots = components(links(nodes, radius))
    placed = materialise(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = materialise(join_hot(placed, smallest, "root", placed.count()).select("fp", "component_id", F.col("copies").alias("n")))
    return join_hot(prints, named, "fp", prints.count())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable over links."""
    prints = materialise(fingerprints(docs, width))
    return _grouped(prints, F.col("doc_id"), radius).select("doc_id", "fp", "component_id")


def heads(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, head) for every row: whether it has the smallest doc_id of its component, nulls last, and of that id's texts the smallest key."""
    prints = materialise(fingerprints(docs, width, keyed=True))
    found = _grouped(prints, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"), radius)
    first = F.col("component_id")
    return found.select("doc_id", "text_key", (F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("text_key") == first["text_key"])).alias("head"))
