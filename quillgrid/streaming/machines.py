"""Stateful processors: the vendor state machine with timers, and the forms a corpus has seen.

State lies in RocksDB on executors, checkpointed to the query's folder, so a
micro-batch reads its own rows and the state of their keys, however large what
came before has grown.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillgrid.config import Thresholds

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Buckets that keys share. A call and its states cost a processor the same for one key and for hundreds.
BUCKETS = 1024


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which processors need."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, was)


STATES = "lab_vendor string, observed_text string, analyte_id string, confirmations long, collisions long, last_collision timestamp, status string"
#: What a machine may start from: one row a variant.
SEED = "lab_vendor string, observed_text string, analyte_id string, confirmations long, collisions long, last_collision timestamp"


class VendorMachine(StatefulProcessor):
    """States of the (lab_vendor, observed_text) of one bucket: value state for what is decided, list state for events the watermark has not passed.

    A call and its states cost the same for one variant and for hundreds, so
    variants share buckets, and a bucket's events are taken as arrays. Events
    wait, a chunk for each piece of a micro-batch, until the watermark has
    passed them; then they are taken in order of (time, id), whatever order
    they came in. A bucket's timer is set for the next thing that happens in
    it: an event to take, the day the cooldown of a collision ends, by which
    an unstable variant is recovered without any event, or the day a variant
    has been idle for ``idle_days`` and is forgotten.
    """

    def __init__(self, t: Thresholds, idle_days: int | None) -> None:
        self.t, self.idle_days = t, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.decided = handle.getValueState("decided", "vendor array<string>, text array<string>, analyte array<string>, n array<long>, hits array<long>, last_us array<long>, seen_us array<long>, status array<string>")
        self.waiting = handle.getListState("waiting", "vendor array<string>, text array<string>, us array<long>, id array<long>, analyte array<string>")
        self.timer = handle.getValueState("timer", "ms long")

    def _load(self) -> dict[tuple, list]:
        """[analyte, n, hits, last_us, seen_us, status] of each variant; a time that is not known is null."""
        if not self.decided.exists():
            return {}
        vendor, text, *rest = self.decided.get()
        return {(v, x): list(row) for v, x, *row in zip(vendor, text, *rest, strict=True)}

    def _store(self, held: dict[tuple, list]) -> None:
        if held:
            self.decided.update((*(list(c) for c in zip(*held, strict=True)), *(list(c) for c in zip(*held.values(), strict=True))))
        else:
            self.decided.clear()

    def _wake(self, ms: int) -> None:
        """Set the bucket's timer, if what is set is later."""
        if not self.timer.exists() or self.timer.get()[0] > ms:
            self.timer.update((ms,))
            self.handle.registerTimer(ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        held, now, ends = self._load(), timerValues.getCurrentWatermarkInMs(), []
        for row in initialState.itertuples(index=False):
            last = None if pd.isna(row.last_collision) else int(pd.Timestamp(row.last_collision).value // 1000)
            status = self._status(int(row.collisions), last, now)
            held[_text(row.lab_vendor), _text(row.observed_text)] = [_text(row.analyte_id), int(row.confirmations), int(row.collisions), last, last, status]
            if status == "UNSTABLE":
                ends.append(self._ends(last))
        self._store(held)
        if ends:
            self._wake(min(ends))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                us = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
                self.waiting.appendValue((_texts(pdf["lab_vendor"]), _texts(pdf["observed_text"]), us.tolist(), pdf["id"].astype("int64").tolist(), _texts(pdf["analyte_id"])))
                self._wake(int(us.min() // 1000) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._load()
        touched, waits, wakes = self._take(held, now)
        for variant, state in list(held.items()):
            _, _, hits, last, seen, told = state
            if self.idle_days is not None and seen is not None and variant not in waits:
                gone = seen // 1000 + self.idle_days * DAY_MS
                if gone < now:
                    del held[variant]
                    touched.discard(variant)
                    continue
                wakes.append(gone + 1)
            state[5] = self._status(hits, last, now)
            if state[5] != told:
                touched.add(variant)
            if state[5] == "UNSTABLE":
                wakes.append(self._ends(last))
        self._store(held)
        self.timer.clear()
        if wakes:
            self._wake(max(min(wakes), now + 1))
        if touched:
            rows = [(*v, *held[v]) for v in held if v in touched]
            vendor, text, analyte, n, hits, last, _, status = zip(*rows, strict=True)
            last = pd.to_datetime(pd.Series([pd.NaT if x is None else pd.Timestamp(x, unit="us") for x in last], dtype="datetime64[us]"))
            yield pd.DataFrame({"lab_vendor": vendor, "observed_text": text, "analyte_id": analyte, "confirmations": n, "collisions": hits, "last_collision": last, "status": status})

    def _take(self, held: dict[tuple, list], now: int) -> tuple[set, set, list[int]]:
        """Bring ``held`` up to the watermark; variants that took events, those whose events still wait, and when the first of these is due."""
        chunks = list(self.waiting.get()) if self.waiting.exists() else []
        if not chunks:
            return set(), set(), []
        vendor, text, analyte = (np.concatenate([np.array(c[i], object) for c in chunks]) for i in (0, 1, 4))
        us, ids = (np.concatenate([np.asarray(c[i], np.int64) for c in chunks]) for i in (2, 3))
        due = us < now * 1000
        self.waiting.clear()
        rest = ~due
        waits, wakes = set(zip(vendor[rest], text[rest], strict=True)), []
        if rest.any():
            self.waiting.appendValue((vendor[rest].tolist(), text[rest].tolist(), us[rest].tolist(), ids[rest].tolist(), analyte[rest].tolist()))
            wakes.append(int(us[rest].min() // 1000) + 1)
        if not due.any():
            return set(), waits, wakes
        codes: dict[tuple, int] = {}
        code = np.array([codes.setdefault(v, len(codes)) for v in zip(vendor[due], text[due], strict=True)])
        order = np.lexsort((ids[due], us[due], code))
        code, us, analyte = code[order], us[due][order], analyte[due][order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        states = [held.setdefault(v, [None, 0, 0, None, None, None]) for v in codes]  # in order of codes
        before = np.concatenate([[None], analyte[:-1]]).astype(object)
        before[starts] = np.array([s[0] for s in states], object)
        known = np.array([a is not None and b is not None for a, b in zip(before, analyte, strict=True)], bool)
        changed = known & (before != analyte)
        hits, last = np.add.reduceat(changed.astype(np.int64), starts), np.maximum.reduceat(np.where(changed, us, np.iinfo(np.int64).min), starts)
        ends = np.append(starts[1:], len(code))
        for s, a, b, h, at in zip(states, starts.tolist(), ends.tolist(), hits.tolist(), last.tolist(), strict=True):
            s[:5] = [analyte[b - 1], s[1] + b - a, s[2] + h, at if h else s[3], int(us[b - 1])]
        return set(codes), waits, wakes

    def _ends(self, last: int) -> int:
        """When the cooldown of a collision ends: whole days, as the batch form counts them."""
        return (last // 1000 // DAY_MS + self.t.cooldown_days) * DAY_MS

    def _status(self, hits: int, last: int | None, now: int) -> str:
        if not hits:
            return "STABLE"
        if hits <= self.t.max_collisions:
            return "COLLIDED"
        return "UNSTABLE" if last is not None and now < self._ends(last) else "RECOVERED"

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return None if pd.isna(value) else value


def _texts(column: pd.Series) -> list:
    return column.astype(object).where(column.notna(), None).tolist()


def _bucket(rows: DataFrame, buckets: int, *keys: str) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def vendor_machine(
    confirmations: DataFrame, late: str = "0 seconds", t: Thresholds = Thresholds(), initial: DataFrame | None = None, idle_days: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Changes of state from a stream of (lab_vendor, observed_text, analyte_id, ts, id), as ``STATES``; start it inside ``state_store``.

    ``initial`` has the columns of ``SEED``. Events later than ``late`` are
    dropped. A row is the state when the watermark passed events of the variant or its
    status changed; the last row of a variant is its state now. Variants share
    ``buckets``, whose number is fixed for a checkpoint: a micro-batch reads the states of its rows' buckets.
    """
    rows = confirmations.select("lab_vendor", "observed_text", "analyte_id", F.col("ts").cast("timestamp").alias("ts"), "id").withWatermark("ts", late)
    keys = ("lab_vendor", "observed_text")
    start = _bucket(initial, buckets, *keys).groupBy("_bucket") if initial is not None else None
    return _bucket(rows, buckets, *keys).groupBy("_bucket").transformWithStateInPandas(VendorMachine(t, idle_days), STATES, "update", "eventTime", start)


class SeenForms(StatefulProcessor):
    """Whether a (analyte_id, norm) of a bucket has come; passes the first row of each that has not, in order of (ts, id) within a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "analyte array<string>, norm array<string>")

    def _load(self) -> dict[tuple, None]:
        return dict.fromkeys(zip(*self.seen.get(), strict=True)) if self.seen.exists() else {}

    def _add(self, seen: dict[tuple, None], forms: list[tuple]) -> None:
        self.seen.update(tuple(map(list, zip(*(seen | dict.fromkeys(forms)), strict=True))))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if len(initialState):
            self._add(self._load(), list(zip(_texts(initialState["analyte_id"]), _texts(initialState["norm"]), strict=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in rows if len(pdf)]
        if not held:
            return
        first = pd.concat(held).sort_values(["ts", "id"], kind="stable").drop_duplicates(["analyte_id", "norm"])
        seen, forms = self._load(), list(zip(_texts(first["analyte_id"]), _texts(first["norm"]), strict=True))
        new = [f not in seen for f in forms]
        if any(new):
            self._add(seen, [f for f, n in zip(forms, new, strict=True) if n])
            yield first.loc[np.array(new), ["analyte_id", "norm", "ts", "id"]]

    def close(self) -> None:
        pass


def first_forms(rows: DataFrame, known: DataFrame, t: Thresholds = Thresholds(), buckets: int = BUCKETS) -> DataFrame:
    """Of a stream of decisions (id, analyte_id, norm, confirmed, margin, ts) those that pass the first two gates and are the first of their form; ``known`` (analyte_id, norm) are forms the corpus starts with. Forms share ``buckets``, a number fixed for a checkpoint."""
    open_ = F.coalesce(F.col("confirmed"), F.lit(False)) & F.coalesce(F.col("margin") >= t.dual_gate_margin, F.lit(False))
    passed = rows.filter(open_).select("analyte_id", "norm", F.col("ts").cast("timestamp").alias("ts"), "id")
    keys = ("analyte_id", "norm")
    start = _bucket(known.select(*keys).distinct(), buckets, *keys).groupBy("_bucket")
    return _bucket(passed, buckets, *keys).groupBy("_bucket").transformWithStateInPandas(SeenForms(), "analyte_id string, norm string, ts timestamp, id long", "append", "none", start)


def accrete_first(path: str, t: Thresholds = Thresholds()):
    """Body of ``run_once`` over ``first_forms``: of each day's rows as many join the corpus as the cap leaves room for.

    ``path`` holds ``added``, a folder a batch, and ``days``, how many rows a
    batch added to each of its days: the only thing read of what came before, and only for
    the batch's days. A batch that runs again writes its folder anew and does
    not count itself.
    """
    from pyspark.sql import Window

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", F.to_date("ts"))
        earlier = spark.read.schema("n long, day date, batch long").parquet(f"{path}/days").filter(F.col("batch") < batch_id)
        # Days of a batch are few beside its rows, and the counts are kept by day, so that other days are not read.
        room = rows.select("day").distinct().join(earlier, "day", "left").groupBy("day").agg((F.lit(t.daily_cap) - F.coalesce(F.sum("n"), F.lit(0))).alias("room"))
        ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("day").orderBy("ts", "id"))).filter(F.col("nth") <= t.daily_cap)
        taken = ranked.join(room, "day").filter(F.col("nth") <= F.col("room")).select("analyte_id", "norm", "ts", "id", "day")
        taken.write.mode("overwrite").parquet(f"{path}/added/batch={batch_id}")
        added = spark.read.schema("analyte_id string, norm string, ts timestamp, id long, day date").parquet(f"{path}/added/batch={batch_id}")
        counted = added.groupBy("day").agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch_id).cast("long"))
        counted.select("n", "day", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/days")

    return work


def prepare(spark: SparkSession, path: str) -> None:
    """Empty tables for ``accrete_first``."""
    spark.createDataFrame([], "n long, day date, batch long").write.mode("ignore").partitionBy("day", "batch").parquet(f"{path}/days")
