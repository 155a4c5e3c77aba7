"""Embedding near-dedup over a robust-pruned flat graph (after DiskANN, Subramanya et al. 2019).

1. Equal vectors become one vertex with a count.
2. Centroids are fitted on a bounded sample; every vertex joins the shards of
   its ``OVERLAP`` nearest centroids. A shard beyond ``CAP`` vertices is cut
   into pieces; all of its vertices query every piece, those of other pieces
   in slices of about ``QUERIES``, so that no task holds a whole shard.
3. In every piece each vertex gets candidate neighbours and keeps those that
   robust pruning leaves. The adjacency lists that a vertex has in its shards
   are united, and each shard takes the united lists of its vertices.
4. Every vertex is searched in its shards: greedy beam search from the
   piece's medoids, then the range is expanded from everything within reach
   until nothing new is found. Cosines are those of doubles, so every link is
   verified as it is counted. A pair that shares several shards counts in the
   first of them; links leave a shard as counts and stars, never as pairs.
5. Recall is audited against brute force on a sample of vertices that grows
   until it has ``LEAST_LINKS`` links or ``MOST_AUDIT`` vertices; where these have
   too few links, on planted neighbours of them. Below ``LEAST_RECALL`` the work is done again with more overlap and width, and
   after ``TRIES`` tries exactly: every vertex against every piece of all.

Vectors that are null, empty or zero, or hold null or non-finite components,
link with nothing, and so do rows with a null vec_id, vectors of different
lengths, and finite vectors whose squares sum to zero or infinity in double
precision (their cosine has no value there). Rows that share a vec_id are one vertex of the components; where a vec_id
has several vectors, their links add up, also for rows equal to one of them. An empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import HOT, materialise, release
from quillgrid.llm.components import components

COSINE = 0.95
SLACK = 0.05  #: how far below the cosine a vertex may be and still be expanded
SAMPLE, TARGET, MOST_SHARDS, CAP, QUERIES = 8_192, 768, 4_096, 6_144, 24_576
OVERLAP, CANDIDATES, FAR, DEGREE, ALPHA, BEAM, ENTRIES = 2, 48, 12, 32, 1.2, 40, 32
AUDIT, MOST_AUDIT, LEAST_LINKS, LEAST_RECALL, TRIES = 256, 4_096, 256, 0.9, 3
_BLOCK = 256
FRONT = 1 << 19


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows; empty clusters keep their centre."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total**2).sum(axis=1))
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def prune(x: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of candidate lists (rows of ``near``, -1 for none) of vertices 0..n-1: kept neighbours, -1 beyond."""
    out = np.full((len(near), degree), -1)
    for a in range(0, len(near), _BLOCK):
        cand = near[a : a + _BLOCK]
        held = x[np.maximum(cand, 0)]
        own = np.einsum("bd,bcd->bc", x[a : a + len(cand)], held)
        own[cand < 0] = -2
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
        held = np.take_along_axis(held, order[:, :, None], 1)
        between = 1 - held @ held.transpose(0, 2, 1)
        far = 1 - own
        alive, n = cand >= 0, np.zeros(len(cand), int)
        rows = np.arange(len(cand))
        for k in range(cand.shape[1]):
            take = alive[:, k] & (n < degree)
            out[a + rows[take], n[take]] = cand[take, k]
            n += take
            alive &= ~(take[:, None] & (alpha * between[:, k, :] <= far))
    return out


def build(x: np.ndarray) -> np.ndarray:
    """Adjacency (n, DEGREE) of a shard: nearest vertices and a spread of far ones, robustly pruned."""
    n = len(x)
    near = np.full((n, min(CANDIDATES, n) + FAR), -1)
    far = np.linspace(0, n - 1, num=min(n, 64)).astype(int)
    for a in range(0, n, _BLOCK):
        s = x[a : a + _BLOCK] @ x.T
        rows = np.arange(len(s))
        s[rows, a + rows] = -3
        k = min(CANDIDATES, n)
        near[a : a + len(s), :k] = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near[a : a + len(s), k:] = far[(rows[:, None] * 7 + np.arange(FAR) * 11 + a) % len(far)]
    near[near == np.arange(n)[:, None]] = -1
    return prune(x, near)


def medoids(x: np.ndarray, k: int = ENTRIES) -> np.ndarray:
    """Vertices nearest to the shard's mean and to the centres of its clusters."""
    c = np.vstack([x.mean(axis=0)[None], centroids(x, min(k, len(x)), 3)])
    return np.unique(np.argmax(c @ x.T, axis=1))


def search(x: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], entries: np.ndarray, q: np.ndarray, cosine: float = COSINE, beam: int = BEAM) -> np.ndarray:
    """(queries, n) mask of the vertices found with a cosine of at least ``cosine`` to each query. ``lists`` are those of ``mutual``."""
    adjacency, border, ends = lists
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(x)), bool)
    found = np.zeros_like(seen)
    s = q @ x[entries].T
    seen[:, entries] = True
    found[:, entries] = s >= cosine
    wide = min(beam, len(x))
    ids = np.full((len(q), wide), -1)
    sims = np.full((len(q), wide), -2.0)
    order = np.argsort(-s, axis=1)[:, :wide]
    ids[:, : order.shape[1]] = entries[order]
    sims[:, : order.shape[1]] = np.take_along_axis(s, order, 1)
    done = ids < 0
    while not done.all():
        pick = np.argmax(np.where(done, -3.0, sims), axis=1)
        act = ~done[rows, pick]
        done[rows, pick] = True
        at = adjacency[np.maximum(ids[rows, pick], 0)]
        ok = (at >= 0) & act[:, None] & ~seen[rows[:, None], np.maximum(at, 0)]
        r, c = np.nonzero(ok)
        new = at[r, c]
        seen[r, new] = True
        sim = np.full(at.shape, -2.0)
        sim[r, c] = np.einsum("ij,ij->i", q[r], x[new])
        hit = sim[r, c] >= cosine
        found[r[hit], new[hit]] = True
        all_sims = np.concatenate([sims, sim], axis=1)
        best = np.argpartition(-all_sims, wide - 1, axis=1)[:, :wide]
        sims = np.take_along_axis(all_sims, best, 1)
        ids = np.take_along_axis(np.concatenate([ids, np.where(ok, at, -1)], axis=1), best, 1)
        done = np.take_along_axis(np.concatenate([done, ~ok], axis=1), best, 1)
    # Expand the range from all that is close enough, until nothing new comes up.
    edge = found.copy()
    r, c = np.nonzero((ids >= 0) & (sims >= cosine - SLACK))
    edge[r, ids[r, c]] = True
    r, v = np.nonzero(edge)
    while len(r):
        front = []
        total = np.cumsum(border[v + 1] - border[v])
        a = 0
        while a < len(r):  # in pieces, so that a dense group's frontier stays small in memory
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + FRONT, "right")))
            n = border[v[a:b] + 1] - border[v[a:b]]
            rr = np.repeat(r[a:b], n)
            vv = ends[np.repeat(border[v[a:b]] - (np.cumsum(n) - n), n) + np.arange(len(rr))]
            a = b
            fresh = ~seen[rr, vv]
            pair = np.unique(rr[fresh] * len(x) + vv[fresh])
            rr, vv = pair // len(x), pair % len(x)
            seen[rr, vv] = True
            sim = np.concatenate([np.einsum("ij,ij->i", q[rr[i : i + 65536]], x[vv[i : i + 65536]]) for i in range(0, len(rr), 65536)] or [np.zeros(0)])
            hit = sim >= cosine
            found[rr[hit], vv[hit]] = True
            go = sim >= cosine - SLACK
            front.append((rr[go], vv[go]))
        r, v = (np.concatenate(x_) for x_ in zip(*front, strict=True))
    return found


def mutual(x: np.ndarray, u: np.ndarray, v: np.ndarray, width: int = 3 * DEGREE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of edges u -> v with the edges back, twice: as rows of ``width`` at most (own neighbours first, then the nearest), and whole, as borders and ends.

    Whole lists have two entries an edge, whatever the degree of a hub.
    """
    n = len(x)
    key, own = np.unique(np.concatenate([u * n + v, v * n + u]), return_index=True)
    back = own >= len(u)  # unique keeps the first place, so an own edge stays one
    u, v = key // max(1, n), key % max(1, n)
    sim = np.concatenate([np.einsum("ij,ij->i", x[u[i : i + 65536]], x[v[i : i + 65536]]) for i in range(0, len(u), 65536)] or [np.zeros(0)])
    order = np.lexsort((-sim, back, u))
    u, v = u[order], v[order]
    size = np.bincount(u, minlength=n)
    border = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(u)) - border[u]
    keep = place < width
    table = np.full((n, max(1, min(width, int(size.max(initial=0))))), -1)
    table[u[keep], place[keep]] = v[keep]
    return table, border, v


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _plain(column: Column) -> Column:
    """Components as doubles, with one zero."""
    return F.transform(column.cast("array<double>"), lambda v: v + F.lit(0.0))


def _digest(x: Column) -> Column:
    """128 bits that stand for a vector."""
    return F.concat(F.hex(F.xxhash64(x)), F.lit("-"), F.hex(F.xxhash64(F.lit("other"), x)))


def _good(x: Column) -> Column:
    """Whether a vector can link: not null or empty, its components finite, its squares summing to a positive finite number."""
    length = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    finite = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(finite & (length > 0) & (length < float("inf")), F.lit(False))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(node, n, digest, x): one row per distinct vector that can link."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _plain(F.col("embedding")).alias("x"))
    fine = rows.filter(F.col("vec_id").isNotNull() & _good(F.col("x")))
    return materialise(fine.groupBy("x").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).select("node", "n", _digest(F.col("x")).alias("digest"), "x"))


def _by_dim(spark, nodes: DataFrame, exact: bool) -> dict[int, np.ndarray]:
    """Centroids by vector length, from the rows of smallest id digests; with ``exact`` one each."""
    out = {}
    for dim, n in nodes.groupBy(F.size("x")).count().collect():
        rows = nodes.filter(F.size("x") == dim).orderBy(F.xxhash64("node", F.lit("sample"))).limit(SAMPLE).select("x").collect()
        x = unit(np.array([r[0] for r in rows]))
        out[dim] = centroids(x, 1 if exact else int(min(max(1, -(-n // TARGET)), MOST_SHARDS, len(x))))
    return out


def _link(nodes: DataFrame, cosine: float, overlap: int, beam: int, exact: bool = False) -> DataFrame:
    """(node, links, root) per vertex, piece and slice. ``exact``: one shard of all, pieces of which are compared whole."""
    spark = nodes.sparkSession
    model = spark.sparkContext.broadcast(_by_dim(spark, nodes, exact))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = unit(_matrix(column.take(pa.array(rows))))
                c = model.value[int(dim)]
                k = min(overlap, len(c))
                near = np.sort(np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k], axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(near + (int(dim) << 32)), pa.list_(pa.int64())),
                ], names=["node", "n", "x", "homes"])

    placed = materialise(nodes.select("node", "n", "x").mapInArrow(assign, "node long, n long, x array<double>, homes array<long>"))
    rows = placed.withColumn("shard", F.explode("homes"))
    n = F.count("*")
    pieces = rows.groupBy("shard").agg(F.ceil(n / CAP).cast("int").alias("pieces"), F.when(n > CAP, F.ceil(n / QUERIES)).otherwise(1).cast("int").alias("slices"))
    # One row a centroid, MOST_SHARDS a vector length at most.
    cut = rows.join(F.broadcast(pieces), "shard").withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    # Every slice has the whole piece, and of the shard's other vertices a part.
    part = F.pmod(F.xxhash64("node", F.lit("slice")), F.col("slices")).cast("int")
    bases = cut.withColumn("piece", F.col("own")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("base", F.lit(True))
    others = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).filter("piece <> own").withColumn("slice", part).withColumn("base", F.lit(False))
    columns = ("shard", "piece", "slice", "base", "node", "n", "x", "homes")
    bases, others = bases.select(*columns), others.select(*columns)
    grouped = lambda df: df.repartition("shard", "piece", "slice").sortWithinPartitions("shard", "piece", "slice", "node")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            at = 0
            for to in [*(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]:
                if at == to:
                    continue
                if held and (key[at] != now).any():
                    yield pa.Table.from_batches(held)
                    held = []
                now = key[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield pa.Table.from_batches(held)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            if t.num_rows < 2:
                continue
            node = t["node"].to_numpy()
            kept = build(_matrix(t["x"].combine_chunks()))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([node[r[r >= 0]] for r in kept], pa.list_(pa.int64()))], names=["node", "near"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            shard, slice_ = t["shard"][0].as_py(), t["slice"][0].as_py()
            base = np.flatnonzero(t["base"].to_numpy())
            node, n, x = t["node"].to_numpy(), t["n"].to_numpy(), _matrix(t["x"].combine_chunks())
            homes = _matrix(t["homes"].combine_chunks())
            # United lists, in local places; neighbours that are not in this piece drop out. Lists are made mutual.
            order = np.argsort(node[base], kind="stable")
            ids = node[base][order]
            near = t["near"].combine_chunks().take(pa.array(base))
            flat = near.flatten().to_numpy(zero_copy_only=False)
            u = np.repeat(np.arange(len(base)), near.value_lengths().fill_null(0).to_numpy())
            at = np.minimum(np.searchsorted(ids, flat), max(0, len(ids) - 1))
            here = ids[at] == flat if len(ids) else np.zeros(len(flat), bool)
            u, v = u[here], order[at[here]]
            xb = x[base]
            if not exact:
                united = mutual(xb, u, v)
                entry = medoids(xb) if len(base) else np.zeros(0, int)
            up = np.arange(len(node))
            links = np.zeros(len(node), np.int64)
            # The piece's own vertices ask in its first slice.
            asking = np.arange(len(node)) if slice_ == 0 else np.setdiff1d(np.arange(len(node)), base)
            for a in range(0, len(asking) if len(base) else 0, _BLOCK):
                q = x[asking[a : a + _BLOCK]]
                mask = q @ xb.T >= cosine if exact else search(xb, united, entry, q, cosine, beam)
                r, c = np.nonzero(mask)
                r, c = asking[r + a], base[c]
                other = r != c
                r, c = r[other], c[other]
                same = homes[r][:, :, None] == homes[c][:, None, :]
                first = np.where(same.any(axis=2), homes[r], np.iinfo(np.int64).max).min(axis=1)
                np.add.at(links, r, np.where(first == shard, n[c], 0))
                while len(r):  # union by smallest place
                    for _ in range(64):
                        up = up[up]
                        if (up[up] == up).all():
                            break
                    p, q = up[r], up[c]
                    far = p != q
                    r, c, p, q = r[far], c[far], p[far], q[far]
                    np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
            for _ in range(64):
                up = up[up]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[up])], names=["node", "links", "root"])

    if exact:
        no_lists = F.lit(None).cast("array<long>")
        found = grouped(bases.unionByName(others).select(*columns, no_lists.alias("near"))).mapInArrow(find, "node long, links long, root long")
        return materialise(found)
    adjacency = grouped(bases.filter("slice = 0")).mapInArrow(lists, "node long, near array<long>").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    with_lists = bases.join(materialise(adjacency), "node", "left").select(*columns, "near").unionByName(others.withColumn("near", F.lit(None).cast("array<long>")))
    return materialise(grouped(with_lists).mapInArrow(find, "node long, links long, root long"))


def _seen(nodes: DataFrame, linked: DataFrame, sample: list, cosine: float) -> tuple[int, int]:
    """Links of the vertices in ``sample``, rows of (node, n, x): those found, and all there are, by brute force against ``nodes`` in blocks."""
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast([(r["node"], np.array(r["x"])) for r in sample])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x, n = unit(_matrix(batch.column(1).take(pa.array(rows)))), batch.column(0).take(pa.array(rows)).to_numpy()
                mine = np.array([i for i, (_, q) in enumerate(sent.value) if len(q) == dim], int)
                if len(mine):
                    q = unit(np.array([sent.value[i][1] for i in mine]))
                    for a in range(0, len(x), 4 * _BLOCK):
                        count[mine] += ((q @ x[a : a + 4 * _BLOCK].T >= cosine) * n[a : a + 4 * _BLOCK]).sum(axis=1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["i", "n"])

    exact = dict(nodes.select("n", "x").mapInArrow(work, "i long, n long").groupBy("i").agg(F.sum("n")).collect())
    sent.destroy()
    there = [exact.get(i, r["n"]) - r["n"] for i, r in enumerate(sample)]
    wanted = F.broadcast(spark.createDataFrame([(r["node"],) for r in sample], "node long"))
    got = dict(linked.join(wanted, "node").groupBy("node").agg(F.sum("links")).collect())
    return sum(min(got.get(r["node"], 0), n) for r, n in zip(sample, there, strict=True)), sum(there)


def planted(nodes: DataFrame, sample: list, cosine: float) -> list[tuple]:
    """Rows (node, n, digest, x) of neighbours of sampled vertices: copies turned by a small random angle, well within ``cosine``, with ids below all others."""
    rng, least = np.random.default_rng(7), nodes.agg(F.min("node")).first()[0]
    out = []
    for i, r in enumerate(sample):
        x = np.array(r["x"])
        side = rng.normal(size=len(x))
        side -= x * (side @ x) / (x @ x)
        size = np.sqrt(side @ side)
        near = x + side / size * np.sqrt(x @ x) * np.tan(np.arccos(cosine + 0.6 * (1 - cosine))) if size > 1e-9 else 2 * x
        if np.isfinite(near).all():
            out.append((least - 1 - i, 1, f"planted {i}", near.tolist()))
    return out


def audit(nodes: DataFrame, linked: DataFrame, cosine: float = COSINE, size: int = AUDIT, links: int = LEAST_LINKS, most: int = MOST_AUDIT, again=None) -> float:
    """Share of the links of a sample of vertices that were found, against brute force over all vertices in blocks.

    The sample grows until it has ``links`` links, or holds ``most`` or all
    vertices. Where it holds ``most`` and has too few links to tell, planted
    neighbours of sampled vertices are searched for in their stead: ``again``
    links a table as ``linked`` was linked.
    """
    while True:
        sample = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(min(size, most)).select("node", "n", "x").collect()
        if not sample:
            return 1.0
        have, there = _seen(nodes, linked, sample, cosine)
        if there >= links or len(sample) < min(size, most) or size >= most:
            break
        size *= 4
    if there < links and len(sample) >= most and again is not None:
        rows = planted(nodes, sample[:links], cosine)
        both = materialise(nodes.unionByName(nodes.sparkSession.createDataFrame(rows, nodes.schema)))
        found = again(both)
        more, of = _seen(both, found, [{"node": r[0], "n": r[1], "x": r[3]} for r in rows], cosine)
        have, there = have + more, there + of
        release(found)
        release(both)
    return have / there if there else 1.0


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    nodes = distinct_vectors(vectors)
    overlap, beam = OVERLAP, BEAM
    for _ in range(TRIES):
        linked = _link(nodes, cosine, overlap, beam)
        if audit(nodes, linked, cosine, AUDIT, LEAST_LINKS, MOST_AUDIT, lambda df, o=overlap, b=beam: _link(df, cosine, o, b)) >= LEAST_RECALL:
            break
        release(linked)
        overlap, beam = overlap * 2, beam * 2
    else:
        linked = _link(nodes, cosine, 1, beam, exact=True)
    roots = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = nodes.join(links, "node", "left").select("digest", "node", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    named = per_class.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = materialise(named.select("digest", "links", F.coalesce("root", "node").alias("component"), "n"))
    # Equal vectors may be a third of all rows: these stay where they are, and so do all that can't link.
    x = _plain(F.col("embedding"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).select("vec_id", F.when(F.col("vec_id").isNotNull() & _good(F.col("x")), _digest(F.col("x"))).alias("digest"))
    hot = F.broadcast(named.filter(F.col("n") > F.lit(named.agg(F.sum("n")).first()[0] or 0) / HOT).drop("n"))
    cold = named.drop("n").join(hot.select("digest"), "digest", "left_anti")
    able = rows.filter("digest IS NOT NULL")
    held = able.join(hot.select("digest", F.lit(True).alias("hot")), "digest", "left")
    out = held.filter("hot").drop("hot").join(hot, "digest").unionByName(held.filter("hot IS NULL").drop("hot").join(cold, "digest", "left"))
    out = out.unionByName(rows.filter("digest IS NULL").withColumns({"links": F.lit(0).cast("long"), "component": F.col("vec_id")}))
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: What the query returns where every link is found, in DuckDB's SQL.
ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings
), fine AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v
  WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.a LEFT JOIN counted ON v.vec_id = counted.a
"""
