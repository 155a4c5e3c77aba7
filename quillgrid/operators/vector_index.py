"""Inverted file of vectors: centroid cells as partitioned Parquet, pruned by the triangle inequality without loss.

Vectors are taken at unit length, where cos = 1 - d² / 2 for the distance d. A
cell knows its centroid, its number of vectors and its radius, the largest
distance of a vector to the centroid. No vector of a cell is nearer to a query
than the distance of query and centroid less the radius, and none is farther
than their sum. So a search knows from the cells alone how far the k-th
nearest can be at most, reads the nearest cells first, and then only those
that may hold something nearer than the k-th found.

Centroids are fitted on a bounded sample; every vector is indexed. An append
routes rows to the cells there are, adds files to these, and adds a row of
statistics a cell, by which radii widen; nothing is written anew.

Pairs of queries and vectors meet in blocks of a grid, (cell, part of its
vectors, part of its queries), each a matrix product of bounded size, so
neither a cell with a third of all vectors nor a query set of any size lands in one
task or branches the plan.

Null, zero and non-finite vectors, and those of another length than the
index, have no direction here: they are not indexed and find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillgrid.functions.similarity import dot
from quillgrid.storage import materialise, new_path

#: Vectors that centroids are fitted on, and cells at most.
SAMPLE, CELLS = 20_000, 1024
#: Vectors and queries of a block.
BLOCK_VECTORS, BLOCK_QUERIES = 8_192, 2_048
#: Room that rounding of distances gets.
SLACK = 1e-9


def directed(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector has a direction (and the length asked for)."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(finite & (dot(vector, vector) > 0) & (F.size(vector) == dim if dim else F.lit(True)), F.lit(False))


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """k-means on unit vectors; the same rows in the same order give the same centroids."""
    if not len(x):
        return x
    at = np.unique(np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int))
    c = x[at].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), float).reshape(n, -1) if n else np.zeros((0, 0))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))


@dataclass(frozen=True)
class Index:
    """``path`` holds ``cells``, ``statistics`` and ``vectors``; the tables are read when asked."""

    spark: SparkSession
    path: str

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        return np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 0))

    def statistics(self) -> DataFrame:
        """(cell, n, radius) over all appends; one row a cell."""
        return self.spark.read.parquet(f"{self.path}/statistics").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def append(self, vectors: DataFrame) -> Index:
        """Route rows of (vector_id, analyte_id, vector) to cells and write them beside what is there."""
        c = self.centroids()
        if not len(c):
            return self
        sent = self.spark.sparkContext.broadcast(c)

        def route(batches):
            for batch in batches:
                x = _matrix(batch.column(2))
                if not len(x):
                    continue
                x = x / np.sqrt((x * x).sum(1))[:, None]
                d = _distances(x, sent.value)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64())), pa.array(d[np.arange(len(x)), near]), pa.array(near.astype(np.int32))], names=["vector_id", "analyte_id", "vector", "distance", "cell"]
                )

        kept = vectors.filter(directed(F.col("vector"), c.shape[1])).select(F.col("vector_id").cast("long"), F.col("analyte_id").cast("string"), F.col("vector").cast("array<double>"))
        routed = materialise(kept.mapInArrow(route, "vector_id long, analyte_id string, vector array<double>, distance double, cell int"))
        counts = routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
        # A cell's rows go to eight files at most, so that a large cell is not one task.
        routed.repartition("cell", F.pmod(F.xxhash64("vector_id"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")
        counts.coalesce(1).write.mode("append").parquet(f"{self.path}/statistics")
        return self

    def _bounds(self, queries: DataFrame, k: int) -> DataFrame:
        """(input_id, cell, low, first): the cells that may hold one of a query's ``k`` nearest, how near they may come, and whether they are read first."""
        held = sorted((r["cell"], r["n"], r["radius"]) for r in self.statistics().collect())  # at most CELLS rows
        c = self.centroids()
        cell, n, radius = (np.array([h[i] for h in held]) for i in range(3)) if held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        sent = self.spark.sparkContext.broadcast((c[cell] if len(cell) else c, cell, n, radius))

        def bound(batches):
            c, cell, n, radius = sent.value
            for batch in batches:
                # A query may need every cell, so a batch of queries leaves in slices, and without their vectors.
                for at in range(0, batch.num_rows if len(cell) else 0, 256):
                    part = batch.slice(at, 256)
                    x = _matrix(part.column(1))
                    d = _distances(x, c)
                    low, high = np.maximum(d - radius - SLACK, 0), d + radius + SLACK
                    order = np.argsort(high, axis=1)
                    enough = np.minimum((np.cumsum(n[order], axis=1) < k).sum(1), len(cell) - 1)
                    most = np.take_along_axis(high, order, 1)[np.arange(len(x)), enough]
                    # First the cells nearest by centroid that hold k between them.
                    by = np.argsort(d, axis=1, kind="stable")
                    before = np.cumsum(n[by], axis=1) - n[by]
                    first = np.zeros(d.shape, bool)
                    np.put_along_axis(first, by, before < k, 1)
                    row, at_ = np.nonzero((low <= most[:, None]) | first)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(cell[at_].astype(np.int32)), pa.array(low[row, at_]), pa.array(first[row, at_])], names=["input_id", "cell", "low", "first"])

        return queries.mapInArrow(bound, f"input_id {dict(queries.dtypes)['input_id']}, cell int, low double, first boolean")

    def _groups(self) -> DataFrame:
        """(cell, group): cells in groups of about a block's vectors, or of one cell that has more. A row a cell."""
        out, group, room = [], -1, 0
        for r in sorted(self.statistics().collect(), key=lambda r: r["cell"]):
            if group < 0 or r["n"] > room:
                group, room = group + 1, BLOCK_VECTORS
            room -= r["n"]
            out.append((r["cell"], group))
        return self.spark.createDataFrame(out, "cell int, group int").coalesce(1)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(input_id, vector_id, analyte_id, sim, rank): the ``k`` nearest of each query of (input_id, vector), equal to comparing all. Ties (to twelve digits) go to the smaller id."""
        return self.probe(queries, k)[0]

    def probe(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """``search``, and the (input_id, cell) pairs that it had to read.

        A query is sent to a group of small cells as a whole, not to each of
        them: a product with a block costs less than a copy of the query a
        cell, of which a query that lies far from all would need most.
        """
        c = self.centroids()
        dim = c.shape[1] if len(c) else -1
        asked = queries.filter(directed(F.col("vector"), dim)).select(F.col("input_id"), F.col("vector").cast("array<double>").alias("v"))
        asked = materialise(asked.select("input_id", F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))).alias("q")))
        groups = self._groups()
        bounds = materialise(self._bounds(asked, k).join(F.broadcast(groups), "cell"))
        rows = self.vectors() if len(c) else self.spark.createDataFrame([], "vector_id long, analyte_id string, vector array<double>, distance double, cell int")
        rows = rows.join(F.broadcast(groups), "cell").drop("cell").withColumnRenamed("group", "cell")
        sent = lambda df: asked.join(df.select("input_id", F.col("group").alias("cell")).distinct(), "input_id")
        near = materialise(best(products(sent(bounds.filter("first")), rows, k=k), k))
        # What lies within rounding of the k-th found may tie with it.
        reach = near.filter(F.col("rank") == k).select("input_id", (F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0))) + 1e-5).alias("reach"))
        met = bounds.filter("first").select("input_id", "group").distinct()
        rest = bounds.join(met, ["input_id", "group"], "left_anti").join(reach, "input_id", "left").filter("reach IS NULL OR low <= reach").drop("reach")
        rest = materialise(rest)
        found = best(near.drop("rank").unionByName(products(sent(rest), rows, k=k)), k)
        return found, bounds.filter("first").select("input_id", "cell").unionByName(rest.select("input_id", "cell"))


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("input_id").orderBy(F.desc(F.round("sim", 12)), "vector_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _grid(queries: DataFrame, vectors: DataFrame, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with the block (cell, _x, _y) that a row is in: each vector meets each query of its cell in one of them, of about ``rows`` vectors and ``columns`` queries."""
    # Both tables of counts have a row a cell.
    sizes = vectors.groupBy("cell").agg(F.count("*").alias("nv")).join(queries.groupBy("cell").agg(F.count("*").alias("nq")), "cell")
    sizes = materialise(sizes.select("cell", F.ceil(F.col("nv") / rows).cast("int").alias("_rows"), F.ceil(F.col("nq") / columns).cast("int").alias("_columns")))
    hint = F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes
    part = lambda key, n: F.pmod(F.xxhash64(key, F.lit(7)), F.col(n)).cast("int")
    along = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(hint, "cell").withColumn("_x", along("_rows")).withColumn("_y", part("input_id", "_columns"))
    v = vectors.join(hint, "cell").withColumn("_x", part("vector_id", "_rows")).withColumn("_y", along("_columns"))
    return q.drop("_rows", "_columns"), v.drop("_rows", "_columns")


def products(queries: DataFrame, vectors: DataFrame, least: float = -2.0, k: int | None = None) -> DataFrame:
    """(input_id, vector_id, analyte_id, sim) of queries (input_id, q, cell) and unit vectors (vector_id, analyte_id, vector, cell) of the same cell: those of ``least`` or more, and of each block at most ``k`` a query."""
    q, v = _grid(queries.select("input_id", "q", "cell"), vectors.select("vector_id", "analyte_id", "vector", "cell"), BLOCK_VECTORS, BLOCK_QUERIES)
    names = ["input_id", "vector_id", "analyte_id", "sim"]
    key = to_arrow_type(queries.schema["input_id"].dataType)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (key, pa.int64(), pa.string(), pa.float64()), strict=True)})
        x, ids = _matrix(right.column("vector")), right.column("vector_id").to_numpy()
        a, rows = _matrix(left.column("q")), right.select(["vector_id", "analyte_id"])
        out = []
        for at in range(0, len(a), 256):
            s = a[at : at + 256] @ x.T
            if k is not None and k < len(ids):
                # Sorting by rounded products and ids settles ties as the final ranking does.
                cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - 1e-11
                row, col = np.nonzero((s >= cut) & (s >= least))
            else:
                row, col = np.nonzero(s >= least)
            out.append(pa.table({"input_id": left.column("input_id").combine_chunks().take(pa.array(at + row)), "vector_id": pa.array(ids[col]), "analyte_id": rows.column("analyte_id").combine_chunks().take(pa.array(col)), "sim": pa.array(s[row, col])}))
        return pa.concat_tables(out)

    keys = ["cell", "_x", "_y"]
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(work, f"input_id {dict(queries.dtypes)['input_id']}, vector_id long, analyte_id string, sim double")


def best_by_group(queries: DataFrame, vectors: DataFrame, group: str) -> DataFrame:
    """(input_id, group, sim): the largest product of each group's vectors with each query, as they are, whatever their length; ``group`` may be null.

    ``queries``: (input_id, vector); ``vectors``: (vector_id, ``group``,
    vector). A block keeps one product a query and group. Null where no vector of
    the group has a product with the query: one of them is null, holds a null or is of another length.
    """
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    able = lambda df, *cols: df.filter(whole).select(*cols, F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("cell"))
    key, kind = (to_arrow_type(df.schema[c].dataType) for df, c in ((queries, "input_id"), (vectors, group)))
    q, v = _grid(able(queries, "input_id"), able(vectors, "vector_id", group), 2 * BLOCK_VECTORS, 4 * BLOCK_QUERIES)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"input_id": pa.array([], key), group: pa.array([], kind), "sim": pa.array([], pa.float64())})
        held = right.column(group).combine_chunks().dictionary_encode("encode")
        code = held.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        x, a, ids = _matrix(right.column("vector"))[order].T, _matrix(left.column("vector")), left.column("input_id").combine_chunks()
        groups, out = held.dictionary.take(pa.array(code[order][starts])), []
        for at in range(0, len(a), 256):
            most = np.maximum.reduceat(a[at : at + 256] @ x, starts, axis=1)
            row = np.repeat(np.arange(len(most)), len(starts))
            out.append(pa.table({"input_id": ids.take(pa.array(at + row)), group: groups.take(pa.array(np.tile(np.arange(len(starts)), len(most)))), "sim": pa.array(most.ravel(), from_pandas=False)}))
        return pa.concat_tables(out)

    keys, types = ["cell", "_x", "_y"], (dict(queries.dtypes)["input_id"], dict(vectors.dtypes)[group])
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(work, f"input_id {types[0]}, {group} {types[1]}, sim double")
    # A query and a group that have no product are a row all the same: the result's size either way.
    every = queries.select("input_id").join(vectors.select(group).distinct()).withColumn("sim", F.lit(None).cast("double"))
    return found.unionByName(every).groupBy("input_id", group).agg(F.max("sim").alias("sim"))


def build(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, path: str | None = None) -> Index:
    """An index of rows (vector_id, analyte_id, vector); their length is that of most of the sample."""
    spark = vectors.sparkSession
    path = path or new_path(spark)
    able = vectors.filter(directed(F.col("vector"))).select("vector_id", F.col("vector").cast("array<double>").alias("vector"))
    picked = able.orderBy(F.xxhash64("vector_id"), "vector_id").limit(sample).collect()  # bounded by the parameter
    sizes = [len(r["vector"]) for r in picked]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    x = np.array([r["vector"] for r in picked if len(r["vector"]) == dim], float).reshape(-1, dim or 1)
    x = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
    # About as many cells as vectors a cell would be best; the sample bounds what can be told apart.
    c = fit_centroids(x, max(1, min(cells, int(2 * np.sqrt(len(x))))))
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(c)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([], "cell int, n long, radius double").coalesce(1).write.parquet(f"{path}/statistics")
    spark.createDataFrame([], "vector_id long, analyte_id string, vector array<double>, distance double, cell int").write.partitionBy("cell").parquet(f"{path}/vectors")
    return Index(spark, path).append(vectors)


def gram_buckets(rows: DataFrame, key: str, text: str, dim: int = 256, n: int = 3) -> DataFrame:
    """(key, bucket, tf): signed counts of a text's hashed character n-grams, a border on each side."""
    padded = F.concat(F.lit(" "), F.col(text), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
    each = rows.filter(F.length(text) >= n - 1).select(key, F.explode(grams).alias("g"))
    h = F.conv(F.substring(F.md5(F.col("g").cast("binary")), 1, 8), 16, 10).cast("long")
    return each.select(key, F.pmod(h, F.lit(dim)).cast("int").alias("bucket"), F.when(F.floor(h / dim) % 2 == 0, 1).otherwise(-1).alias("sign")).groupBy(key, "bucket").agg(F.sum("sign").alias("tf"))


def vectorise(rows: DataFrame, key: str, text: str, idf: dict[int, float] | None = None, dim: int = 256, n: int = 3) -> DataFrame:
    """(key, vector): hashed n-grams, each bucket weighed by ``idf``. Texts too short to have one get none."""
    weights = F.lit([float((idf or {}).get(i, 1.0)) for i in range(dim)])
    held = gram_buckets(rows, key, text, dim, n).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "tf"))).alias("m"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double") * F.get(weights, i)).alias("vector"))


def document_frequencies(rows: DataFrame, key: str, text: str, dim: int = 256, n: int = 3) -> dict[int, float]:
    """Inverse document frequency of each bucket, from one aggregation; ``dim`` rows reach the driver."""
    total = rows.count()
    counted = gram_buckets(rows, key, text, dim, n).groupBy("bucket").agg(F.count("*").alias("df")).collect()
    return {r["bucket"]: float(np.log((1 + total) / (1 + r["df"])) + 1) for r in counted}
