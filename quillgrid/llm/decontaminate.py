"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the corpus into shards of whole documents and stores, for
each shard, every token's postings: term hashes, counts, and delta-coded
positions. Positions run through the shard with one unused place between
documents, so no phrase can cross a border. ``matches`` ranks each window's
terms by their corpus-wide counts, starts from the postings of the rarest
term, and intersects offset-adjusted lists in order of rarity; with ``slop``
a term may stand that many places from its own (proximity). All lists of a
document are in one shard, so searching moves no postings between machines,
and a common word costs no more than its own list.

The benchmark is a query set: it is read by the driver as a stream and sent to
executors in blocks of about ``BLOCK`` windows, one after the other, so that
neither holds more than one block; what a block finds is written before the
next is read. Within a shard windows are searched in pieces of at most
``PIECE`` postings of their rarest terms (or one term's).

Texts are indexed whole, however long. Columns other than doc_id and text (of
items: item_id and text) are not read, whatever their names. Null and empty texts have no words and are never contaminated. Repeated rows
are judged each on their own. Items without words are no items; repeated
items count once; a null item_id counts as the empty string. An empty corpus
gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import broadcast_if_small, materialise
from quillgrid.llm.kernels import ALNUM, LOWER_BYTES, text_slices, word_hashes, word_spans

WINDOW = 13
SHARD = 2 << 20
BLOCK = 200_000
PIECE = 1 << 20

INDEX = "shard long, doc_ids array<long>, text_keys array<long>, n_words array<int>, terms binary, counts binary, postings binary"


def build_index(docs: DataFrame) -> DataFrame:
    """One row a shard; written to the shared folder. ``text_keys`` tells apart rows that share a doc_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, task, shard = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, offs in text_slices(batch, "text", SHARD):
                shard += 1
                data = LOWER_BYTES[data]
                starts, ends, first = word_spans(data, offs, ALNUM)
                h = word_hashes(data, starts, ends)
                n = np.diff(first)
                place = (np.arange(len(h)) + np.repeat(np.arange(b - a), n)).astype(np.int32)
                order = np.argsort(h, kind="stable")
                h = h[order]
                cut = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
                at = np.flatnonzero(cut)
                place = place[order]
                step = np.diff(place, prepend=np.int32(0))
                step[at] = place[at]
                yield pa.RecordBatch.from_arrays([
                    pa.array([(task << 32) | shard]), pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())), pa.array([batch.column(2).slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                    pa.array([n.astype(np.int32)], pa.list_(pa.int32())), pa.array([h[at].tobytes()], pa.binary()),
                    pa.array([pack.compress(np.diff(np.append(at, len(h))).astype("<i4").tobytes())], pa.binary()), pa.array([pack.compress(step.tobytes())], pa.binary()),
                ], names=["shard", "doc_ids", "text_keys", "n_words", "terms", "counts", "postings"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    return materialise(texts.mapInArrow(work, INDEX))


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i4")


class Windows:
    """Distinct windows of query items: term hashes by place, length, and the items that hold each."""

    def __init__(self, rows: list[tuple[str, bytes]], width: int = WINDOW) -> None:
        held: dict[tuple, set[str]] = {}
        for item, text in rows:
            data = LOWER_BYTES[np.frombuffer(text, np.uint8)]
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
            h = word_hashes(data, starts, ends).tolist()
            for i in range(max(1, len(h) - width + 1) if h else 0):
                held.setdefault(tuple(h[i : i + width]), set()).add(item)
        self.size = np.array([len(k) for k in held], np.int64)
        self.terms = np.zeros((len(held), width), np.uint64)
        for i, k in enumerate(held):
            self.terms[i, : len(k)] = k
        self.items = [sorted(v) for v in held.values()]
        self.vocabulary = np.unique(np.concatenate([self.terms[i, :s] for i, s in enumerate(self.size)])) if held else np.zeros(0, np.uint64)
        self.ids = np.searchsorted(self.vocabulary, self.terms)

    def rank(self, counts: np.ndarray) -> None:
        """Order each window's places by the counts of their terms, rarest first; unused places last."""
        used = np.arange(self.terms.shape[1]) < self.size[:, None]
        weight = np.where(used, counts[np.minimum(self.ids, max(0, len(counts) - 1))], np.iinfo(np.int64).max) if len(counts) else np.zeros(self.terms.shape, np.int64)
        self.order = np.argsort(weight, axis=1, kind="stable")


class query_blocks:  # noqa: N801
    """Blocks of windows of rows of (item_id, text); every loop over them reads the rows as a stream and holds one block."""

    def __init__(self, items: DataFrame, width: int = WINDOW) -> None:
        self.items, self.width = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))), width

    def __iter__(self) -> Iterator[Windows]:
        rows, words = [], 0
        for item, text in self.items.toLocalIterator():
            rows.append((item, text.encode()))
            words += len(text) // 2
            if words > BLOCK:
                yield Windows(rows, self.width)
                rows, words = [], 0
        if rows:
            yield Windows(rows, self.width)


def _rarity(index: DataFrame, block: Windows) -> np.ndarray:
    """Corpus-wide counts of the block's terms."""
    vocabulary = index.sparkSession.sparkContext.broadcast(block.vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = vocabulary.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                have = np.frombuffer(terms.as_py(), "<u8")
                if len(have) and len(wanted):
                    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
                    total += np.where(have[at] == wanted, _unpack(counts.as_py())[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(block.vocabulary), np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n")).toLocalIterator():
        out[term] = n
    return out


def _search(block: Windows, terms: np.ndarray, counts: np.ndarray, postings: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of every match in a shard, in pieces. ``postings`` holds term index << 32 | position, ascending."""
    if not len(terms) or not len(block.size):
        return
    at = np.minimum(np.searchsorted(terms, block.vocabulary), len(terms) - 1)
    here = np.append(np.where(terms[at] == block.vocabulary, at, -1), -1)
    used = np.arange(block.terms.shape[1]) < block.size[:, None]
    local = here[np.minimum(block.ids, len(here) - 1)]
    viable = np.flatnonzero(((local >= 0) | ~used).all(axis=1))
    begin = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    ends = np.cumsum(counts[local[viable, block.order[viable, 0]]], dtype=np.int64)
    a = 0
    while a < len(viable):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
        some = viable[a:b]
        a = b
        place = block.order[some, 0]
        term = local[some, place]
        n = counts[term].astype(np.int64)
        window = np.repeat(some, n)
        step = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        start = (postings[np.repeat(begin[term], n) + step] & 0xFFFFFFFF) - np.repeat(place, n)
        for k in range(1, block.terms.shape[1]):
            going = block.size[window] > k
            if not going.any():
                break
            place = block.order[window, k]
            target = (local[window, place].astype(np.int64) << 32) + start + place
            low = np.searchsorted(postings, target - slop)
            found = (low < len(postings)) & (postings[np.minimum(low, len(postings) - 1)] <= target + slop) & (start + place >= 0)
            keep = found | ~going
            window, start = window[keep], start[keep]
        yield window, start


def _stretches(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint stretches that cover the same words, with their documents."""
    order = np.argsort(start, kind="stable")
    start, end, doc = start[order], end[order], doc[order]
    reach = np.maximum.accumulate(end)  # documents lie one after the other, so a later one never reaches back
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)], doc[new]


HITS = "shard long, doc int, n_matches long, starts array<int>, ends array<int>, items array<string>"


def _hits(index: DataFrame, block: Windows, slop: int) -> DataFrame:
    """What one block finds: a row per document with a match."""
    block.rank(_rarity(index, block))
    sent = index.sparkSession.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n_words"], np.int64)
                terms, counts, steps = np.frombuffer(row["terms"], "<u8"), _unpack(row["counts"]), _unpack(row["postings"])
                begin = np.cumsum(counts, dtype=np.int64) - counts
                run = np.cumsum(steps, dtype=np.int64)
                base = np.repeat(run[begin] - steps[begin], counts) if len(counts) else run
                postings = (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32) | (run - base)
                first = np.concatenate([[0], np.cumsum(n + 1)])
                n_matches = np.zeros(len(n), np.int64)
                spans: list[tuple[np.ndarray, ...]] = []
                items: dict[int, set[str]] = {}
                for window, start in _search(block, terms, counts, postings, slop):
                    if not len(window):
                        continue
                    doc = np.searchsorted(first, start, "right") - 1
                    spans.append(_stretches(np.maximum(start, first[doc]), np.minimum(start + block.size[window], first[doc + 1] - 1), doc))
                    np.add.at(n_matches, doc, 1)
                    pair = np.unique(doc * len(block.size) + window)
                    for d, w in zip((pair // len(block.size)).tolist(), (pair % len(block.size)).tolist(), strict=True):
                        items.setdefault(d, set()).update(block.items[w])
                if not spans:
                    continue
                start, end, doc = _stretches(*(np.concatenate(x) for x in zip(*spans, strict=True)))
                hit, at = np.unique(doc, return_index=True)
                cut = lambda x: np.split(x.astype(np.int32), at[1:])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(hit), pa.int64()), pa.array(hit, pa.int32()), pa.array(n_matches[hit]), pa.array(cut(start), pa.list_(pa.int32())), pa.array(cut(end), pa.list_(pa.int32())),
                    pa.array([sorted(items[d]) for d in hit.tolist()], pa.list_(pa.string())),
                ], names=["shard", "doc", "n_matches", "starts", "ends", "items"])

    found = materialise(index.drop("doc_ids", "text_keys").mapInArrow(work, HITS))
    sent.destroy()
    return found


def matches(index: DataFrame, blocks: Iterable[Windows], slop: int = 0) -> DataFrame:
    """One row per indexed row: words inside a match, matches, and the items matched, in string order.

    With ``slop`` > 0 these are proximity matches, anchored on each window's
    rarest term. Then ``n_hit`` counts the window's nominal span.
    """
    found = None
    for block in blocks:
        hits = _hits(index, block, slop)
        found = hits if found is None else found.unionByName(hits)
    docs = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "n_words")).alias("doc", "x"))
    docs = docs.select("shard", "doc", F.col("x.doc_ids").alias("doc_id"), F.col("x.text_keys").alias("text_key"), F.col("x.n_words").cast("long").alias("n_words"))
    if found is None:
        return docs.select("doc_id", "text_key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_matches"), F.array().cast("array<string>").alias("items"))
    # Stretches of one block are disjoint, those of several may overlap; a document has one row a block.
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    state = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["reach"], x["ends"]).alias("reach"), (s["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(s["reach"], x["starts"]))).alias("n"))
    merged = found.groupBy("shard", "doc").agg(F.aggregate(spans, state, step, lambda s: s["n"]).alias("n_hit"), F.sum("n_matches").alias("n_matches"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = docs.join(broadcast_if_small(materialise(merged)), ["shard", "doc"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "text_key", "n_words", zero("n_hit"), zero("n_matches"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``matches`` with the verdict: a document is contaminated if hits cover a twentieth of its words or more."""
    found = matches(build_index(docs), query_blocks(items, width))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


#: What the query returns, in DuckDB's SQL.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), hits AS (SELECT rid, p.n, i, item FROM places p JOIN windows USING (n, phrase)),
covered AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
