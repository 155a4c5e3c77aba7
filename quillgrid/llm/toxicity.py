"""Toxicity: noisy-channel deobfuscation before scoring.

1. A character model: trigrams of words, counted over every text on executors
   and added up by Spark. Symbols are the letters a to z, a word border, and
   ``OTHER`` classes of all characters beyond ASCII, so the table has one
   bound whatever the corpus.
2. Spans that may be disguised are found by their bytes: chunks between white
   space with digits or marks among letters, or with a letter repeated, and
   runs of single characters with one space between them. All other words
   have but one reading. A span becomes a lattice: a digit or mark may stand
   for letters, be a border, or be nothing; a repeated letter may be one or
   two; the gap between single characters may be nothing. Viterbi finds the
   path of least cost under the channel's costs and the character model; its
   state is the last two symbols, so the path is the best of all.
3. A linear model scores the restored words. Words and their beginnings are
   hashed; those that mark toxic texts by a likelihood ratio that chance would
   reach in less than one of all features tested are kept, with two values each:
   whether a text has them, and how densely. The fit adds copies of its rows with
   few of their features, so that little evidence is enough.

The linear model is fitted on at most ``SAMPLE`` labelled rows, those with the
smallest id digests; the character model is fitted on all texts, and scoring
covers every row and reads every text whole, however long. Null and empty texts have no
words and get the score of a text without evidence. Repeated rows and ids count each on
their own. Without labels, or with only one class, scores are the class's
share (0.5 without labels). An empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import materialise, release
from quillgrid.llm.kernels import LOWER_BYTES, NONSPACE, text_slices, word_hashes, word_spans

SAMPLE = 30_000
#: Symbols of the character model: 0 a border, 1 to 26 the letters, the rest classes of other characters.
SYMBOLS = 64
OTHER = SYMBOLS - 27
#: Pseudo-counts that a shorter context gives a longer one.
PRIOR = 5.0

#: Letters that a digit or mark may stand for. Fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "*": "abcdefghijklmnopqrstuvwxyz",
}
#: Costs of the channel, as negative logarithms: a mark for a letter, a mask for any letter, a mark as itself among
#: letters and as punctuation at the end.
SWAP, MASK, ITSELF, AT_END = 1.0, 2.5, 4.5, 0.5
#: A gap left out, and kept as a border, between single characters; left out elsewhere, where borders are free.
JOIN_ONE, KEEP_ONE, JOIN = 0.3, 4.0, 5.0
#: A letter doubled, in a span with one double letter and in one with more; a letter thrice or more as one and as two.
DOUBLED, DOUBLED_AGAIN, MANY_ONE, MANY_TWO = 5.0, 2.0, 0.3, 1.5
#: Restored spans that a task remembers.
MEMORY = 200_000

#: Bytes of the beginnings of words that are features, how many features are kept, and in how many toxic texts they must be.
BEGINNINGS = (4, 5, 6, 7, 8)
KEPT, LEAST_TEXTS = 4096, 3
DENSITY = 50.0
#: Thinned copies of a labelled row that the fit adds, and the share of its features that each keeps.
THINNED, THIN_SHARE = 3, 0.25

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in STANDS_FOR]] = True
#: At the end of a chunk, these are punctuation.
_TRAIL = _LEET.copy()
_TRAIL[[ord(c) for c in "!*+|"]] = False


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbol of each lower-cased code point, -1 for what is no letter."""
    out = np.full(len(points), -1, np.int64)
    low = np.where((points >= 65) & (points <= 90), points + 32, points)
    letter = (low >= 97) & (low <= 122)
    out[letter] = low[letter] - 96
    out[low >= 128] = 27 + low[low >= 128] % OTHER
    return out


def trigram_counts(text: str) -> np.ndarray:
    """Counts of trigrams of the text's words, two borders before and one after each."""
    s = symbols(np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64))
    word = s >= 0
    ends = ~word & np.concatenate([[False], word[:-1]])
    spread = np.repeat(np.where(word, s, 0), np.where(word, 1, np.where(ends, 2, 0)))
    spread = np.concatenate([[0, 0], spread])
    a, b, c = spread[:-2], spread[1:-1], spread[2:]
    code = ((a * SYMBOLS + b) * SYMBOLS + c)[(b > 0) | (c > 0)]
    # After a word's first border comes its second, which no context predicts.
    return np.bincount(code, minlength=SYMBOLS**3)


def count_characters(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts. Tasks hold one table each; at most ``SYMBOLS`` cubed rows reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, data, offs in text_slices(batch, "text"):
                # A border between texts; UTF-8 has no zero byte inside a character.
                gaps = np.insert(data, offs[1:-1], 32)
                held += trigram_counts(gaps.tobytes().decode("utf-8", "replace"))
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], names=["code", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[counted.column("code").to_numpy()] = counted.column("n").to_numpy()
    return out


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative logarithms of P(third | first, second); shorter contexts fill in for longer ones."""
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
    p2 = (n2 + PRIOR * p1) / (n2.sum(1, keepdims=True) + PRIOR)
    p3 = (n3 + PRIOR * p2) / (n3.sum(2, keepdims=True) + PRIOR)
    return -np.log(p3).ravel()


def _symbol(c: str) -> int:
    return ord(c) - 96 if c < "\x80" else 27 + ord(c) % OTHER


def _is_letter(c: str) -> bool:
    return "a" <= c <= "z" or c >= "\x80"


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """By run of equal characters what it may have been, and at which cost; a border is a space."""
    runs: list[list] = []
    for c in span:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    doubled = DOUBLED_AGAIN if sum(n > 1 and _is_letter(c) for c, n in runs) > 1 else DOUBLED
    tail = max((i for i, (c, _) in enumerate(runs) if _is_letter(c) or c.isdigit()), default=-1)
    single = [n == 1 and (_is_letter(c) or c in STANDS_FOR) for c, n in runs]
    out = []
    for i, (c, n) in enumerate(runs):
        if _is_letter(c):
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, doubled)] if n == 2 else [(c, MANY_ONE), (c * 2, MANY_TWO)])
            continue
        # A gap has single characters on both sides if these are alone between gaps.
        lone = lambda k: 0 <= k < len(runs) and single[k] and all(not (0 <= j < len(runs)) or not _is_letter(runs[j][0]) for j in (k - 1, k + 1))
        between = n == 1 and lone(i - 1) and lone(i + 1)
        if c in STANDS_FOR:
            swap = MASK if c == "*" else SWAP
            options = [(x, swap + (0 if n == 1 else MANY_ONE)) for x in STANDS_FOR[c]]
            if n > 1:
                options += [(x * 2, swap + MANY_TWO) for x in STANDS_FOR[c]]
            out.append([*options, (" ", AT_END if i > tail and c in "!*+|" else ITSELF), *([("", JOIN_ONE)] if between and not c.isdigit() else [])])
        else:
            out.append([(" ", KEEP_ONE), ("", JOIN_ONE)] if between else [(" ", 0.0)] if c == " " else [(" ", 0.0), ("", JOIN)])
    return out


def decode(span: str, cost: list[float]) -> tuple[str, float]:
    """The cheapest reading of a lower-cased span, its words with one space between them, and its cost. Ties go to the option named first."""
    now: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in lattice(span):
        then: dict[int, tuple[float, tuple | None]] = {}
        for state, (paid, path) in now.items():
            for text, extra in options:
                s, total, back = state, paid + extra, path
                for c in text:
                    if c == " ":
                        if s:
                            total += cost[s * SYMBOLS]
                            back = (c, back)
                        s = 0
                    else:
                        x = _symbol(c)
                        total += cost[s * SYMBOLS + x]
                        s, back = s % SYMBOLS * SYMBOLS + x, (c, back)
                held = then.get(s)
                if held is None or total < held[0]:
                    then[s] = (total, back)
        now = then
    paid, path = min(((p + (cost[s * SYMBOLS] if s else 0.0), b) for s, (p, b) in now.items()), key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip(), paid


def disguised(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chunks of lower-cased bytes: which may be disguised, and which chunk begins the span that each belongs to (itself, or a run's first)."""
    letter = _LETTER[low]
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    at = np.flatnonzero(letter)
    held = sums(letter)
    n_letters = held[ends] - held[starts]
    has = n_letters > 0
    if not len(at):
        return has, np.arange(len(starts))
    head = np.where(has, at[np.minimum(held[starts], len(at) - 1)], starts)
    tail = np.where(has, at[np.maximum(held[ends] - 1, 0)] + 1, ends)
    twice = np.concatenate([[False], (low[1:] == low[:-1]) & letter[1:] & (low[1:] < 128)])
    doubles, leet, trail = sums(twice), sums(_LEET[low]), sums(_TRAIL[low])
    odd = has & ((tail - head > n_letters) | (doubles[ends] - doubles[starts] > 0) | (leet[head] - leet[starts] > 0) | (trail[ends] - trail[tail] > 0))
    # Runs of three or more single characters, one space between each and the next, none across texts.
    one = (ends - starts == 1) & (has | _LEET[low[starts]])
    follows = np.concatenate([[False], one[1:] & one[:-1] & (starts[1:] - starts[:-1] == 2)])
    follows[first[1:-1][first[1:-1] < len(follows)]] = False
    lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(follows))))
    size = np.bincount(lead, minlength=len(lead))
    run = size[lead] >= 3
    return odd | run, np.where(run, lead, np.arange(len(lead)))


class Restorer:
    """Restores the texts of a task's slices; remembers what it has decoded."""

    def __init__(self, cost: np.ndarray) -> None:
        self.cost = cost.tolist()
        self.seen: dict[bytes, bytes] = {}

    def span(self, raw: bytes) -> bytes:
        out = self.seen.get(raw)
        if out is None:
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            out = self.seen[raw] = decode(raw.decode("utf-8", "replace").replace("\t", " ").replace("\n", " "), self.cost)[0].encode()
        return out

    def restore(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased bytes with every disguised span restored, and the texts' offsets. Words are what counts: white space around them may differ."""
        low = LOWER_BYTES[data]
        starts, ends, first = word_spans(low, offs, NONSPACE)
        if not len(starts):
            return low, offs
        odd, lead = disguised(low, starts, ends, first)
        picked = np.flatnonzero(odd)
        if not len(picked):
            return low, offs
        of, begin = np.unique(lead[picked], return_index=True)
        last = picked[np.concatenate([begin[1:], [len(picked)]]) - 1]
        raw, parts, sizes, at = low.tobytes(), [], [], 0
        a, b = starts[of], ends[last]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            new = self.span(raw[x:y])
            parts += (raw[at:x], new)
            sizes.append(len(new))
            at = y
        parts.append(raw[at:])
        grown = np.concatenate([[0], np.cumsum(np.array(sizes) - (b - a))])
        return np.frombuffer(b"".join(parts), np.uint8), offs + grown[np.searchsorted(a, offs, "left")]

    def text(self, text: str | None) -> str:
        """One restored text."""
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        return self.restore(data, np.array([0, len(data)]))[0].tobytes().decode("utf-8", "replace")


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of every word and beginning of restored bytes, and the words of each text."""
    starts, ends, first = word_spans(data, offs, _LETTER)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    rows, held = [owner], [word_hashes(data, starts, ends)]
    for k in BEGINNINGS:
        long = ends - starts > k
        rows.append(owner[long])
        held.append(word_hashes(data, starts[long], starts[long] + k, k))
    return np.concatenate(rows), np.concatenate(held), n_words


@dataclass
class Model:
    cost: np.ndarray  #: of the character model
    intercept: float = 0.0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  #: kept hashes, ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  #: of presence and density

    def entries(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, key, density) of the kept features that each restored text has, once each."""
        owner, h, n_words = features(data, offs)
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        met = self.keys[at] == h
        cell, n = np.unique(owner[met] * len(self.keys) + at[met], return_counts=True)
        row = cell // len(self.keys)
        return row, cell % len(self.keys), np.log1p(DENSITY * n / n_words[row])

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        row, key, dense = self.entries(data, offs)
        z = self.intercept + np.bincount(row, self.weights[key, 0] + self.weights[key, 1] * dense, minlength=len(offs) - 1) if len(row) else np.full(len(offs) - 1, self.intercept)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def thinned(row: np.ndarray, key: np.ndarray, dense: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows and ``THINNED`` copies of each that keep a share of its features; copies without any are left out. Which features stay is drawn from a fixed seed."""
    rng, rows, keys, values, labels, n = np.random.default_rng(0), [row], [key], [dense], [y], len(y)
    for _ in range(THINNED):
        stay = rng.random(len(row)) < THIN_SHARE
        has, at = np.unique(row[stay], return_inverse=True)
        rows.append(n + at)
        keys.append(key[stay])
        values.append(dense[stay])
        labels.append(y[has])
        n += len(has)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(values), np.concatenate(labels)


def fit(row: np.ndarray, key: np.ndarray, dense: np.ndarray, y: np.ndarray, n_keys: int, steps: int = 400, rate: float = 0.5, decay: float = 5e-4) -> tuple[float, np.ndarray]:
    """Logistic regression with squared penalty by adaptive gradient steps over all rows; the same rows give the same weights."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    bias, w = float(np.log(share / (1 - share))), np.zeros((n_keys, 2))
    g_bias, g_w = 1e-8, np.full((n_keys, 2), 1e-8)
    for _ in range(steps):
        z = bias + np.bincount(row, w[key, 0] + w[key, 1] * dense, minlength=len(y))
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g0 = off.sum()
        g = np.column_stack([np.bincount(key, off[row], minlength=n_keys), np.bincount(key, off[row] * dense, minlength=n_keys)]) + decay * w
        g_bias += g0 * g0
        g_w += g * g
        bias -= rate * g0 / np.sqrt(g_bias)
        w -= rate * g / np.sqrt(g_w)
    return bias, w


def _ratio(a, b, na, nb):
    """Likelihood ratio statistic of a feature that ``a`` of ``na`` toxic and ``b`` of ``nb`` other texts have."""
    n, k = na + nb, a + b
    part = lambda seen, rows, column: F.when(seen > 0, seen * F.log(seen * n / (rows * column))).otherwise(0.0)
    return 2 * (part(a, k, na) + part(b, k, nb) + part(na - a, n - k, na) + part(nb - b, n - k, nb))


def _digest(doc_id):
    return F.xxhash64(doc_id.cast("string"), F.lit("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Character model of all ``docs``; linear model of the ``sample`` labelled rows of smallest id digest. ``labels`` has doc_id and toxic; null labels are not learned."""
    model = Model(costs(count_characters(docs)))
    cost = docs.sparkSession.sparkContext.broadcast(model.cost)
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), (F.col("toxic") > 0).cast("long").alias("_y"))
    chosen = marked.orderBy(_digest(F.col("_id")), "_y").limit(sample)  # bounded by the parameter, hence fit to be broadcast
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    learned = materialise(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("_y").alias("y"), "text"))
    # Repeated doc_ids may multiply rows, so the bound holds once more; ties go by label, then by text.
    n = {r["y"]: r["count"] for r in learned.groupBy("y").count().collect()}
    if sum(n.values()) > sample:
        before = learned
        learned = materialise(learned.orderBy(_digest(F.col("doc_id")), "y", "text").limit(sample))
        release(before)
        n = {r["y"]: r["count"] for r in learned.groupBy("y").count().collect()}
    total = sum(n.values())
    if len(n) < 2:
        share = np.clip(n.get(1, 0) / total, 1e-6, 1 - 1e-6) if total else 0.5
        model.intercept = float(np.log(share / (1 - share)))
        release(learned)
        return model

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(cost.value)
        for batch in batches:
            for a, b, data, offs in text_slices(batch, "text"):
                new, at = restorer.restore(data, offs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(new)]).cast(pa.binary())],
                    names=["doc_id", "y", "text"],
                )

    words = materialise(learned.mapInArrow(restored, "doc_id long, y long, text binary"))
    release(learned)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for a, _, data, offs in text_slices(batch, "text", 8 << 20):
                owner, h, _ = features(data, offs)
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
                key, at = np.unique(h[new], return_inverse=True)
                toxic = np.bincount(at, y[a + owner[new]], minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(key)))], names=["h", "a", "n"])

    by_feature = words.mapInArrow(counted, "h long, a long, n long").groupBy("h").agg(F.sum("a").cast("double").alias("a"), F.sum("n").cast("double").alias("n"))
    na, nb = F.lit(float(n[1])), F.lit(float(n[0]))
    a, b = F.col("a"), F.col("n") - F.col("a")
    by_feature = materialise(by_feature.filter(F.col("n") >= LEAST_TEXTS))
    least = 2 * np.log(max(by_feature.count(), 2))
    told = by_feature.filter((a >= LEAST_TEXTS) & (a * nb > b * na)).withColumn("ratio", _ratio(a, b, na, nb)).filter(F.col("ratio") >= float(least))
    best = told.orderBy(F.desc(F.round("ratio", 6)), "h").limit(KEPT).select("h").toArrow()
    release(by_feature)
    model.keys = np.sort(best.column("h").to_numpy().view(np.uint64)) if best.num_rows else np.zeros(0, np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch, "text"):
                row, key, dense = sent.value.entries(data, offs)
                cuts = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(cuts, pa.array(key)), pa.ListArray.from_arrays(cuts, pa.array(dense))], names=["doc_id", "y", "key", "dense"]
                )

    rows = words.mapInArrow(held, "doc_id long, y long, key array<long>, dense array<double>").orderBy("doc_id", "y", "key", "dense").toArrow().combine_chunks()
    release(words)
    keys, dense = (rows.column(c).combine_chunks() for c in ("key", "dense"))
    of = np.repeat(np.arange(rows.num_rows), keys.value_lengths().to_numpy())
    model.intercept, model.weights = fit(*thinned(of, keys.flatten().to_numpy(), dense.flatten().to_numpy(), rows.column("y").to_numpy().astype(float)), len(model.keys))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value.cost)
        for batch in batches:
            for a, b, data, offs in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sent.value.score(*restorer.restore(data, offs)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")


def restored_texts(docs: DataFrame, cost: np.ndarray) -> DataFrame:
    """(doc_id, restored): every text lower-cased (A-Z) with its disguised spans restored."""
    sent = docs.sparkSession.sparkContext.broadcast(cost)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for batch in batches:
            for a, b, data, offs in text_slices(batch, "text"):
                new, at = restorer.restore(data, offs)
                raw = new.tobytes()
                out = [raw[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, restored string")
