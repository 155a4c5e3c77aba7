"""Line dedup by content-defined chunks of lines.

Every line of a text is hashed; a rolling hash over the last ``ROLL`` line
hashes ends a chunk where it falls on one in ``EVERY`` values, once the chunk
has ``LEAST`` lines, and at ``MOST`` lines at the latest (which also cuts a run
of one line). Borders depend on nearby lines, so equal passages are soon cut
alike wherever they stand. A passage too short to hold a whole chunk of that
cut is met by the finest one, in which every hash ends a chunk: ``LEAST``
lines from each line on. Whatever has ``LEAST`` lines or more is a union of
these, so a repeated passage goes whole, however long or short.

1. Chunks of ``LEAST`` lines or more are counted by 128-bit hashes of their
   bytes; no text leaves its place.
2. Those that occur again come with their bytes and are grouped by them, which
   is the comparison; one hash may stand for several texts. A group is kept at
   its first place: smallest doc_id, nulls last, then smallest hash of the
   text, then earliest line.
3. Every other place is removed; within one text never a line of the first
   place itself. A line that goes equals one at an earlier place in this order,
   so one copy always stays.

Counts, groups and owners are aggregations with partial sums, and a chunk that
a large share of all texts has is joined where its rows are, so a chunk in
a third of all documents is never one task's work. Lines end with ``\\n``;
chunks without a letter or digit are no reason for removal.

Null texts stay null and have no lines; empty texts have one empty line,
which is never removed; very long texts are cut whole, one at a time. Rows
that share a doc_id are told apart by their texts; exact repeats of a row are
one document and share its verdict. Rows with a null doc_id are never a first
place unless all are. An empty table gives an empty result. All columns are
passed on; those added start with ``__qg_``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import broadcast_if_small, join_hot, materialise
from quillgrid.llm.kernels import join_hash, mix

ROLL, EVERY, LEAST, MOST = 2, 2, 2, 32
#: Lists of places (one a text) that may be broadcast.
SMALL_LISTS = 300_000
_WORDY = re.compile(rb"[0-9A-Za-z\x80-\xff]")


class Lines:
    """A text's lines: where they begin, and their hashes."""

    def __init__(self, raw: bytes) -> None:
        lines = raw.split(b"\n")
        self.raw, self.n = raw, len(lines)
        self.at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, self.n) + 1)]).tolist()
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, self.n)

    def body(self, a: int, b: int) -> bytes:
        return self.raw[self.at[a] : self.at[b] - 1]

    def wordy(self, a: int, b: int) -> bool:
        return _WORDY.search(self.raw, self.at[a], self.at[b] - 1) is not None

    def chunks(self) -> list[tuple[int, int]]:
        """(first line, line after the last) of the distinct chunks of both cuts."""
        rolled = self.hash.copy()
        for k in range(1, min(ROLL, self.n)):
            rolled[k:] = join_hash(rolled[k:], self.hash[:-k])
        found = {(at, at + LEAST): None for at in range(self.n - LEAST + 1)}
        at = 0
        for end in [*(np.flatnonzero(mix(rolled) % np.uint64(EVERY) == 0) + 1).tolist(), self.n]:
            while end - at > MOST:
                found[at, at + MOST] = None
                at += MOST
            if end - at >= LEAST or end == self.n > at:
                found[at, end] = None
                at = end
        return list(found)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(body: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(body)
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


_PLACES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32()), ("lines", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())])
_DETAIL = pa.schema([*_PLACES, ("chunk", pa.binary())])
_PLACES_DDL = "doc_id long, text_key long, place int, lines int, k1 long, k2 long"
_DETAIL_DDL = f"{_PLACES_DDL}, chunk binary"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True) if held else [()] * len(schema), schema, strict=True)], schema=schema)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every chunk of two lines or more that has a letter or digit."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc, text, key in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                raw = text.as_py()
                if raw is None or b"\n" not in raw:
                    continue
                lines, doc_id, text_key = Lines(raw), doc.as_py(), key.as_py()
                for a, b in lines.chunks():
                    if b - a >= LEAST and lines.wordy(a, b):
                        yield (doc_id, text_key, a, b - a, *_key(lines.body(a, b)))

    return _batches(rows(), _PLACES)


def _detail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the places given, the bytes."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc, text, key, places in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), batch.column(2), batch.column(3), strict=True):
                lines, doc_id, text_key = Lines(text.as_py()), doc.as_py(), key.as_py()
                for x in places.as_py():
                    a, b = x["place"], x["place"] + x["lines"]
                    body = lines.body(a, b)
                    yield (doc_id, text_key, a, b - a, *_key(body), body)

    return _batches(rows(), _DETAIL, 2048)


def _join_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` with the lists of their texts (doc_id, text_key, list) as __qg_list. Lists are broadcast if they are few."""
    sided = broadcast_if_small(lists, SMALL_LISTS).select(F.col("doc_id").alias("__qg_doc"), F.col("text_key").alias("__qg_key"), F.col("list").alias("__qg_list"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__qg_doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__qg_key"))
    return docs.join(sided, same, how).drop("__qg_doc", "__qg_key")


def met_again(detail: DataFrame) -> DataFrame:
    """(doc_id, text_key, place, lines, first) of all places of chunks that occur again; ``first`` is where the chunk's bytes occur first.

    Grouping by bytes is the comparison. A key that stands for one text meets
    its rows by itself; should it stand for several, the bytes join.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "place", "lines")
    groups = detail.groupBy("key", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    keys = materialise(groups.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first")))
    met = join_hot(detail.drop("chunk"), keys.filter("texts = 1 AND n > 1").select("key", "first", "n"), "key", detail.count())
    clashes = keys.filter("texts > 1").select("key")
    if clashes.isEmpty():
        return met
    told = groups.join(clashes, "key", "left_semi").filter("n > 1").select("key", "chunk", "first")
    return met.unionByName(detail.join(told, ["key", "chunk"]).drop("chunk"))


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, list): the stretches of lines (start, end) to remove from each text that loses any."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    key = F.struct("k1", "k2").alias("key")
    places = materialise(texts.mapInArrow(_places, _PLACES_DDL))
    again = materialise(places.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select(key, "n"))
    met = join_hot(places.select("doc_id", "text_key", "place", "lines", key), again, "key", places.count())
    lists = materialise(met.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("place", "lines")).alias("list")))
    listed = _join_lists(texts.select("doc_id", "text"), lists, "inner").select("doc_id", "text", F.xxhash64("text").alias("text_key"), "__qg_list")
    detail = materialise(listed.mapInArrow(_detail, _DETAIL_DDL).select("doc_id", "text_key", "place", "lines", key, "chunk"))
    first = F.col("first")
    same_text = F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("text_key") == first["text_key"])
    start = F.when(same_text, F.greatest("place", first["place"] + first["lines"])).otherwise(F.col("place"))
    gone = met_again(detail).select("doc_id", "text_key", start.alias("start"), (F.col("place") + F.col("lines")).alias("end")).filter("start < end")
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("list"))


def kept_text(raw: bytes | None, gone: list[dict] | None) -> tuple[bytes | None, int, int]:
    """The text without the stretches of lines ``gone``, its lines, and how many were removed."""
    if raw is None:
        return None, 0, 0
    lines = raw.split(b"\n")
    if not gone:
        return raw, len(lines), 0
    lost = np.zeros(len(lines) + 1, np.int64)
    for x in gone:
        lost[x["start"]] += 1
        lost[x["end"]] -= 1
    kept = [lines[i] for i in np.flatnonzero(np.cumsum(lost[:-1]) == 0)]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` replaced, and n_lines and n_removed added as __qg_n_lines and _n_removed."""
    joined = _join_lists(docs, materialise(removals(docs)), "left")
    names = docs.columns
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kept_text(t.as_py(), p.as_py()) for t, p in zip(batch.column(at).cast(pa.large_binary()), batch.column(len(names)), strict=True)]
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array([x[0] for x in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names=[*names, "__qg_n_lines", "__qg_n_removed"])

    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields]
    return joined.mapInArrow(work, T.StructType([*fields, T.StructField("__qg_n_lines", T.LongType()), T.StructField("__qg_n_removed", T.LongType())]))
