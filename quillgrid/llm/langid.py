"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the most frequent letter n-grams (one to three letters, words
padded with a border mark) in order of frequency, ties in order of the n-gram.
A document's profile is held against each language's: every n-gram adds the
distance between its two ranks, or the whole depth where the language lacks
it. The nearest language wins, ties in favour of the smaller name.

``train`` counts the n-grams of every training text, on executors, and brings
``depth`` rows a language to the driver. Scores are 1 - distance / largest
possible distance.

Texts are read whole, however long. Null texts and texts without letters are ``und`` with score 0, as is every
text when nothing was learned. Null labels are not learned. Repeated rows
count and are judged each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 300
#: Counts that training holds before it adds them up, whatever the number of texts or languages.
GATHER = 1 << 21
UND = "und"
_BITS = 18
_TABLE = 0x20000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased letter by code point, 0 for anything else."""
    out = np.zeros(_TABLE, np.int64)
    for c in range(_TABLE):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and their counts."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    far = points >= _TABLE  # beyond the table letters are ideographs, which have no case
    kept = _letters()[np.where(far, 0, points)]
    if far.any():
        kept = np.where(far & (points < 1 << _BITS), points, kept)
    padded = np.concatenate([[0], kept, [0]])
    full = padded > 0
    padded = padded[full | np.concatenate([[True], full[:-1]])]
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    two = (2 << 3 * _BITS) | (padded[:-1] << _BITS) | padded[1:]
    three = (3 << 3 * _BITS) | (a << 2 * _BITS) | (b << _BITS) | c
    keys = np.concatenate([(1 << 3 * _BITS) | padded[padded > 0], two, three[b > 0]]) if len(padded) > 1 else np.zeros(0, np.int64)
    keys.sort()
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def top(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The most frequent n-grams by rank."""
    return keys[np.argsort(-counts, kind="stable")[:depth]]


@dataclass(frozen=True)
class Profiles:
    """Entries (n-gram, language, rank), at most ``depth`` a language, by n-gram: nothing is as large as languages times n-grams."""

    names: tuple[str, ...]
    keys: np.ndarray  #: distinct n-grams, ascending
    first: np.ndarray  #: of each n-gram its first entry, and the end
    langs: np.ndarray
    ranks: np.ndarray
    depth: int

    def distances(self, ranked: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a ranked profile to each language."""
        out = np.full(len(self.names), self.depth * len(ranked), np.int64)
        at = np.minimum(np.searchsorted(self.keys, ranked), len(self.keys) - 1)
        own = np.flatnonzero(self.keys[at] == ranked)
        at = at[own]
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        # What a language has is nearer than what it lacks, which counts the whole depth.
        np.add.at(out, self.langs[entry], np.abs(self.ranks[entry] - np.repeat(own, n)) - self.depth)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = grams(text)
        if not len(keys) or not self.names:
            return UND, 0.0
        ranked = top(keys, counts, self.depth)
        d = self.distances(ranked)
        best = int(np.argmin(d))
        return self.names[best], float(max(0.0, 1 - d[best] / (self.depth * len(ranked))))


def train(docs: DataFrame, depth: int = DEPTH) -> Profiles:
    """Profiles of every non-null ``lang`` of rows of (text, lang)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush(name: str) -> pa.RecordBatch:
            keys, counts = (np.concatenate(x) for x in zip(*held.pop(name), strict=True))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(keys[at]), pa.array(np.add.reduceat(counts, at))], names=["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                found = grams(text.as_py())
                if len(found[0]):
                    held.setdefault(lang.as_py(), []).append(found)
                    size += len(found[0])
                if size > GATHER:
                    for name in list(held):
                        yield flush(name)
                    size = 0
        for name in list(held):
            yield flush(name)

    counted = docs.filter("lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(work, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A filter on the rank itself lets every task keep its own first ``depth`` before the shuffle.
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= depth)
    rows = sorted((gram, lang, rank - 1) for lang, gram, rank in ranked.select("lang", "gram", "rank").toLocalIterator())
    names = tuple(sorted({r[1] for r in rows}))
    place = {name: i for i, name in enumerate(names)}
    keys, first = np.unique(np.array([r[0] for r in rows], np.int64), return_index=True)
    langs, ranks = np.array([place[r[1]] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    return Profiles(names, keys, np.append(first, len(rows)), langs, ranks, depth)


def identify(docs: DataFrame, profiles: Profiles, least: float | None = None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score; with ``least`` only the rows that are not rejected, without those two.

    A row is rejected if it is ``und`` or its score is below ``least``. Columns
    of these two names that ``docs`` has already are replaced.
    """
    if least is None:
        docs = docs.drop("lang_pred", "score")
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] if least is None else []
    text_at = docs.columns.index("text")
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t.as_py()) for t in batch.column(text_at)]
            if least is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
            else:
                yield batch.filter(pa.array([x[0] != UND and x[1] >= least for x in found], pa.bool_()))

    return docs.mapInArrow(work, T.StructType([*fields, *added]))


def remainder(doc_id, mod: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def learn_from(docs: DataFrame) -> DataFrame:
    """The rows that models of this corpus may learn a language from."""
    return docs.filter(remainder(F.col("doc_id"), 4) != 2)
