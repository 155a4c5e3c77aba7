"""Substring dedup by recompression (after Jez, "Recompression", 2013-2016).

Words are named by hashes. One round names short runs of equal words, two
rounds name pairs of neighbours: a pair is replaced where its left symbol
falls in one class and its right one in the other, the classes being a bit of
the symbol's name in that round. Names of these small symbols are fingerprints
of what they stand for, so every task gives equal runs and pairs the same name.
Whether two symbols are joined depends on these two only, so equal passages
are parsed alike inside:

    A run is named if it has at most ``RUN`` = 3 words, so 3 words from the
    border of a repeated passage the parse is that of every copy. A pair is
    named if it has at most 4, then 6 words, so a border can be lost 3, then
    5 words further in. From 3 + 3 + 5 = 11 words in, all copies have equal
    symbols.

The high-level symbol is a phrase: neighbouring symbols of 10 words or more,
hence of 15 at most, defined by a pair of the names below it. Of a window of
50 words, symbols start alike in all copies from word 11 on, and every 13
words hold the start of a symbol; so the least phrase that starts at words 11
to 23 of a window is the same in every copy of that window, and lies in the
part that is parsed alike (11 + 12 + 15 <= 39).

1. A Spark round names phrases globally: definitions (both names of the pair,
   128 bits) meet in a dictionary, and each one that several documents have
   gets a number. Others can't lie in a repeated window and end here.
2. A window is then the words before its phrase, the phrase's number and the
   words after it. A second Spark round gathers by this key the smallest
   doc_id. The key is verified by a second hash of all 50 words, of another
   family of hashes, so that what is removed rests on 128 bits over the words.

Texts are packed once, in shards of whole documents, as a table bucketed by
shard; they are never shuffled. Both rounds exchange packed arrays between
shards and buckets of hashes: a shard sends each distinct key once, however
often it has it, and gets back one bit a key and the answers that differ from
what it knows. A passage in a third of all documents weighs no more than one
entry a shard.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have no
words. Rows that share a doc_id don't count as repeats of each other; a null
doc_id comes after all others but the largest long, with which it ties. Texts
are read whole, a shard holds one text at least, so memory is bounded by the
longest text. An empty table gives an empty result. Columns other than doc_id
and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import bucketed, materialise, shuffle_partitions
from quillgrid.llm.kernels import NONSPACE, join_hash, mix, spark_hash, text_slices, window_hashes, word_hashes, word_spans

WINDOW = 50
RUN = 3
PAIRS = (4, 6)
MARGIN = RUN + sum(c - 1 for c in PAIRS)
LEAST_PHRASE = 10
MOST_PHRASE = LEAST_PHRASE + PAIRS[-1] - 1
SPREAD = WINDOW - 2 * MARGIN - MOST_PHRASE
SHARD = 3 << 20
#: Bytes of packed text a bucket of keys stands for.
BUCKET = 32 << 20
LAST = 2**63 - 1
#: Seed of the second family of word hashes.
OTHER = 0x5851F42D4C957F2D


def shards(docs: DataFrame) -> DataFrame:
    """Whole documents packed into rows of about ``SHARD`` bytes: (shard, ids, nulls, sizes, texts), bucketed by shard.

    Spark puts a shard into the bucket that the hash of its number says; a
    task takes numbers of one bucket only, so it writes one file.
    """
    n = shuffle_partitions(docs.sparkSession)

    def numbers(task: int) -> Iterator[int]:
        at = 0
        while True:
            tried = (np.int64(task) << 32) | np.arange(at, at + 4 * n)
            yield from tried[spark_hash(tried) % n == task % n].tolist()
            at += 4 * n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, number = zstandard.ZstdCompressor(level=1), numbers(TaskContext.get().partitionId())
        for batch in batches:
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            for a, b, data, offs in text_slices(batch, "text", SHARD):
                parts = (ids[a:b].tobytes(), np.packbits(none[a:b]).tobytes(), np.diff(offs).tobytes(), pack.compress(data.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([next(number)]), *(pa.array([x], pa.binary()) for x in parts)], names=["shard", "ids", "nulls", "sizes", "texts"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return bucketed(texts.mapInArrow(work, "shard long, ids binary, nulls binary, sizes binary, texts binary"), "shard", n)


class Shard:
    """Unpacked shard: texts, word spans and word hashes."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(texts) if texts else b""
        self.offs = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        self.data = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends, self.first = word_spans(self.data, self.offs, NONSPACE)
        self.words = word_hashes(self.data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def windows(self) -> np.ndarray:
        """First words of all windows."""
        end = self.first[self.doc + 1]
        return np.flatnonzero(np.arange(len(self.words)) + WINDOW <= end)


def parse(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the symbols after all rounds (and the end), and their names."""
    n = len(words)
    if not n:
        return np.zeros(1, np.int64), words
    # Runs of equal words.
    new = np.concatenate([[True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    short = np.repeat(size <= RUN, size)
    start = np.flatnonzero(new | ~short)
    length = np.diff(np.append(start, n))
    name = np.where(length > 1, join_hash(words[start], length.astype(np.uint64)), words[start])
    # Pairs of neighbours.
    for k, cap in enumerate(PAIRS, 1):
        side = mix(name + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) & np.uint64(1)
        joined = (side[:-1] == 0) & (side[1:] == 1) & (doc[start[:-1]] == doc[start[1:]]) & (length[:-1] + length[1:] <= cap)
        left = np.flatnonzero(joined)
        name = name.copy()
        name[left] = join_hash(name[left], name[left + 1])
        keep = np.ones(len(start), bool)
        keep[left + 1] = False
        start, name = start[keep], name[keep]
        length = np.diff(np.append(start, n))
    return np.append(start, n), name


class Phrases:
    """High-level symbols of a shard: first word, end, and definition as a pair of names of what lies below."""

    def __init__(self, s: Shard) -> None:
        n = len(s.words)
        border, name = parse(s.words, s.doc)
        first = np.arange(len(border) - 1)
        to = np.minimum(np.searchsorted(border, border[:-1] + LEAST_PHRASE), len(border) - 1)
        whole = (border[to] - border[:-1] >= LEAST_PHRASE) & (border[to] <= s.first[s.doc[border[:-1]] + 1]) if n else np.zeros(0, bool)
        first, to = first[whole], to[whole]
        self.start, self.end = border[first], border[to]
        # Two stretches of 2, 4 or 8 names cover the names of a phrase.
        count = to - first
        self.left, self.right = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
        power = name
        for k in (1, 2, 4, 8):
            at = (count >= k) & (count < 2 * k) if k < 8 else count >= k
            self.left[at], self.right[at] = power[first[at]], power[to[at] - k]
            power = join_hash(power[: max(0, len(power) - k)], power[k:])
        self.left = join_hash(self.left, count.astype(np.uint64))
        self.key = np.minimum(join_hash(self.left, self.right), np.uint64(2**64 - 2))

    def least(self, p: np.ndarray, n: int) -> np.ndarray:
        """For windows that start at words ``p`` of ``n``, the phrase of least key (the leftmost of equals) in their inner part."""
        if not len(p):
            return np.zeros(0, np.int64)
        key = np.append(self.key, np.uint64(2**64 - 1))
        best = np.full(n + SPREAD, len(self.key))
        best[self.start] = np.arange(len(self.key))
        step = 1
        while step < SPREAD:
            shift = min(step, SPREAD - step)
            best[:-shift] = np.where(key[best[shift:]] < key[best[:-shift]], best[shift:], best[:-shift])
            step += shift
        return best[p + MARGIN]


class Distinct:
    """Distinct 128-bit keys of a shard in the order in which they are sent: by bucket, then by key."""

    def __init__(self, a: np.ndarray, b: np.ndarray, owner: np.ndarray, buckets: int) -> None:
        bucket = (mix(a ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((b, a, bucket))
        new = np.ones(len(a), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        at = np.flatnonzero(new)
        self.place = np.empty(len(a), np.int64)  #: of each entry given, the distinct key it has
        self.place[order] = np.cumsum(new) - 1
        self.a, self.b, self.bucket = a[order[at]], b[order[at]], bucket[order[at]]
        owner = owner[order]
        self.low, self.high = (f.reduceat(owner, at) if len(at) else owner for f in (np.minimum, np.maximum))
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        self.cuts = np.concatenate([[0], cuts, [len(at)]]) if len(at) else np.zeros(1, np.int64)

    def parts(self) -> Iterator[tuple[int, slice]]:
        for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            yield int(self.bucket[a]), slice(a, b)

    def send(self, shard: int, owners: bool) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1)
        rows = [
            (bucket, shard, self.a[x].tobytes(), self.b[x].tobytes(), pack.compress(self.low[x].tobytes()) if owners else b"", np.packbits(self.low[x] != self.high[x]).tobytes())
            for bucket, x in self.parts()
        ]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), *(pa.binary(),) * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "shard", "a", "b", "low", "several"])

    def receive(self, back: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every distinct key, whether it was answered, and the answer."""
        known, answer = np.zeros(len(self.a), bool), np.zeros(len(self.a), np.int64)
        told = {x["bucket"]: x for x in back if x["kind"] == kind}
        unpack = zstandard.ZstdDecompressor()
        for bucket, x in self.parts():
            if bucket in told:
                ok = np.unpackbits(np.frombuffer(told[bucket]["mask"], np.uint8), count=x.stop - x.start).astype(bool)
                known[x] = ok
                answer[x.start + np.flatnonzero(ok)] = np.frombuffer(unpack.decompress(told[bucket]["answer"]), np.int64)
        return known, answer


SENT = "bucket long, shard long, a binary, b binary, low binary, several binary"
BACK = "shard long, kind int, bucket long, mask binary, answer binary"
NAMES, WINDOWS = 0, 1


def _answer(kind: int):
    """Per bucket and shard, buckets one after the other. NAMES: keys of several documents, and their numbers. WINDOWS: keys that a smaller doc_id has, and that id."""

    def close(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        a, b = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in "ab")
        size = [len(r["a"]) // 8 for r in rows]
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(new) - 1
        if kind == NAMES:
            own = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=n) for r, n in zip(rows, size, strict=True)])
            shared = np.bincount(group, 1 + own) > 1
            value = (rows[0]["bucket"] << 40) + np.cumsum(shared)
            ok, value = shared[group], value[group]
        else:
            low = np.concatenate([np.frombuffer(unpack.decompress(r["low"]), np.int64) for r in rows])
            least = np.minimum.reduceat(low[order], np.flatnonzero(new))
            value = least[group]
            ok = value < low
        at = 0
        for r, n in zip(rows, size, strict=True):
            part = slice(at, at := at + n)
            if ok[part].any():
                cells = (r["shard"], kind, r["bucket"], np.packbits(ok[part]).tobytes(), pack.compress(value[part][ok[part]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cells, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "kind", "bucket", "mask", "answer"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for row in _rows(batches):
            if rows and row["bucket"] != rows[0]["bucket"]:
                yield from close(rows)
                rows = []
            rows.append(row)
        if rows:
            yield from close(rows)

    return work


def _exchange(sent: DataFrame, kind: int, buckets: int) -> DataFrame:
    return materialise(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(kind), BACK))


def _with(packed: DataFrame, back: DataFrame, how: str) -> DataFrame:
    """Shards with their answers, which come to the shards' buckets."""
    lists = back.groupBy("shard").agg(F.collect_list(F.struct("kind", "bucket", "mask", "answer")).alias("back"))
    return packed.join(lists.hint("shuffle_hash"), "shard", how)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _stretch(half: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """Hash of words a to b, which are 8 to 8 * ``steps`` words, from hashes of 8."""
    out = (b - a).astype(np.uint64)
    for k in range(steps):
        out = join_hash(out, half[np.minimum(a + 8 * k, b - 8)])
    return out


class Named:
    """A shard's windows and phrases; with the answers about phrases, the windows that may repeat and their keys."""

    def __init__(self, row: dict, buckets: int) -> None:
        self.s = Shard(row["ids"], row["sizes"], row["texts"])
        self.buckets = buckets
        self.p = self.s.windows()
        self.phrases = Phrases(self.s)
        self.least = self.phrases.least(self.p, len(self.s.words))
        # The least phrase never moves back as windows move on, and lies in one document.
        new = np.ones(len(self.least), bool)
        new[1:] = self.least[1:] != self.least[:-1]
        used, q = self.least[new], self.phrases
        self.of = np.cumsum(new) - 1  # of each window, the entry of its phrase among those used
        self.distinct = Distinct(q.left[used], q.right[used], self.s.ids[self.s.doc[q.start[used]]], buckets)

    def candidates(self, back: list[dict]) -> tuple[np.ndarray, Distinct]:
        s, q = self.s, self.phrases
        known, number = self.distinct.receive(back, NAMES)
        place = self.distinct.place[self.of]
        shared = known[place]
        p, phrase, number = self.p[shared], self.least[shared], number[place[shared]]
        half = window_hashes(s.words, 8)
        before, after = _stretch(half, p, q.start[phrase], 3), _stretch(half, q.end[phrase], p + WINDOW, 4)
        key = join_hash(join_hash(before, number.view(np.uint64)), after)
        check = window_hashes(word_hashes(s.data, s.starts, s.ends, OTHER), WINDOW)[p] if len(p) else key
        return p, Distinct(key, check, s.ids[s.doc[p]], self.buckets)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row's words without those of windows that start in an earlier document, joined by one space."""
    packed = shards(docs)
    total = packed.agg(F.sum(F.length("texts"))).first()[0] or 0
    buckets = max(48, -(-total // BUCKET))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield Named(row, buckets).distinct.send(row["shard"], False)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield Named(row, buckets).candidates(row["back"])[1].send(row["shard"], True)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if row["back"]:
                named = Named(row, buckets)
                s = named.s
                p, found = named.candidates(row["back"])
                known, answer = found.receive(row["back"], WINDOWS)
                low = np.where(known, answer, found.low)
                p = p[low[found.place] < s.ids[s.doc[p]]]
            else:
                s, p = Shard(row["ids"], row["sizes"], row["texts"]), np.zeros(0, np.int64)
            edge = np.zeros(len(s.words) + 1, np.int64)
            edge[p] += 1
            edge[p + WINDOW] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            null = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(s.ids))
            out: list[list] = [[], [], [], []]
            for d, doc_id in enumerate(s.ids.tolist()):
                words = s.raw[s.offs[d] : s.offs[d + 1]].split()
                lost = gone[s.first[d] : s.first[d + 1]]
                n = int(lost.sum())
                kept = [words[i] for i in np.flatnonzero(~lost)] if n else words
                for held, x in zip(out, (None if null[d] else doc_id, len(words), n, b" ".join(kept)), strict=True):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    named = _exchange(packed.mapInArrow(names, SENT), NAMES, buckets)
    lowest = _exchange(_with(packed, named, "inner").mapInArrow(windows, SENT), WINDOWS, buckets)
    return _with(packed, named.unionByName(lowest), "left").mapInArrow(removed, "doc_id long, n_words long, n_removed long, kept string")


#: What the query returns, in DuckDB's SQL.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, doc_id, i, array_to_string(w[i : i + 49], ' ') AS passage
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)
), earliest AS (SELECT passage, min(doc_id) AS least FROM windows GROUP BY passage HAVING count(DISTINCT doc_id) > 1),
gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 50)) AS j FROM windows JOIN earliest USING (passage) WHERE least < doc_id
), lists AS (SELECT rid, list(j) AS js FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(js, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN lists USING (rid)
"""
