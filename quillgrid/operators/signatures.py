"""Lossless signature join of names by indel ratio: equal keys instead of nested loops.

A name is a bag of tokens (letter, how manieth of its kind), in one order of
rarity for all. Names of lengths m and n with a ratio of f or more have
L = ceil(f * (m + n) / 2) letters in common, hence L tokens; then any k of the
common tokens that come first lie among the first m - L + k tokens of one name
and the first n - L + k of the other. So both names, dealt to pairs of length
bands, emit every k of those tokens as a signature, and meet on an equal one.
L is that of the shortest lengths of the two bands, k the largest for which
neither side emits more than ``COMBINATIONS``. Signatures are hashed; a clash
only adds a candidate.

Candidates are held against the bound of lengths and the bag bound in the join
itself. A pair meets on every k tokens it shares; only the meeting on the first
k of them counts, so pairs come once and no shuffle has to tell repeats apart.
A signature that very many names have is laid out as a grid: each side's
rows are dealt to one coordinate and copied along the other, so no task gets
all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.similarity import KINDS
from quillgrid.storage import materialise

#: Signatures a name and pair of bands, tokens of a signature, growth of the bands.
COMBINATIONS, MOST, BAND = 90, 4, 1.15
#: Rows of a signature, on either side, from which it is laid out as a grid.
GRID_ROWS = 4_000
#: Grid entries that may be broadcast.
GRID_BROADCAST = 1_000_000
#: Manieth letters of a kind that have a rank of their own; further ones are rarer than all.
RANKED = 24
EPSILON = 1e-9


def bands(longest: int) -> list[tuple[int, int]]:
    """(first, last) lengths of the bands from 1 to ``longest`` or beyond."""
    out, at = [], 1
    while at <= max(longest, 1):
        last = max(at, math.ceil(at * BAND) - 1)
        out.append((at, last))
        at = last + 1
    return out


def band_pairs(longest: int, floor: float) -> list[tuple[int, int, int, int]]:
    """(left band, right band, L, k) of all bands that can hold a pair."""
    held, out = bands(longest), []
    for i, (a, a_last) in enumerate(held):
        for j, (b, b_last) in enumerate(held):
            if 2 * min(a_last, b_last) < floor * (max(a, b) + min(a_last, b_last)) - EPSILON:
                continue
            common = max(1, math.ceil(floor * (a + b) / 2 - EPSILON))
            # No pair has more in common than its shorter name has letters.
            fits = [k for k in range(1, min(MOST, common) + 1) if max(math.comb(max(last - common + k, k), k) for last in (a_last, b_last)) <= COMBINATIONS]
            out.append((i, j, common, max(fits, default=1)))
    return out


def _kinds(text: Column) -> Column:
    """Kind of every letter: its place in the alphabet, the space, or all others."""
    letters = F.split(F.regexp_replace(text, "[^a-z ]", "~"), "")
    return F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.when(c == "~", F.lit(len(KINDS))).when(c == " ", F.lit(len(KINDS) - 1)).otherwise(F.ascii(c) - 97))


def _tokens(text: Column) -> Column:
    """Distinct tokens: kind, and how manieth of it."""
    kinds = F.array_sort(_kinds(text))
    return F.transform(kinds, lambda k, i: F.struct(k.cast("int").alias("kind"), (i - F.array_position(kinds, k) + 2).cast("int").alias("nth")))


def rarity(names: DataFrame, text: str) -> Callable[[Column], Column]:
    """Rank of a token as a function of it, rarest first; from one aggregation of ``names``, of which a bounded table reaches the driver."""
    tokens = names.select(F.explode(_tokens(F.col(text))).alias("t")).filter(F.col("t.nth") <= RANKED)
    counts = {(r["kind"], r["nth"]): r["n"] for r in tokens.groupBy("t.kind", "t.nth").agg(F.count("*").alias("n")).collect()}
    order = sorted(((counts.get((k, n), 0), -n, k) for k in range(len(KINDS) + 1) for n in range(1, RANKED + 1)))
    place = {(k, -n): i for i, (_, n, k) in enumerate(order)}
    ranks = F.lit([place[k, n] for k in range(len(KINDS) + 1) for n in range(1, RANKED + 1)])
    # Beyond RANKED, the more the rarer: below zero, each token its own number.
    return lambda t: F.when(t["nth"] <= RANKED, F.get(ranks, t["kind"] * RANKED + t["nth"] - 1)).otherwise(-(t["nth"] * (len(KINDS) + 1) + t["kind"]))


def _choices() -> list[tuple[int, ...]]:
    """(k, p, places): every choice of k > 1 of the first p places, where these are few enough; places that k has not are -1."""
    held = [(k, p) for k in range(2, MOST + 1) for p in range(k, COMBINATIONS) if math.comb(p, k) <= COMBINATIONS]
    return [(k, p, *at, *[-1] * (MOST - k)) for k, p in held for at in combinations(range(p), k)]


def _signature(tokens: list[Column]) -> Column:
    return F.xxhash64("_base", *tokens)


def _emit(names: DataFrame, text: str, longest: int, floor: float, side: int) -> DataFrame:
    """``names``, whose tokens are in ``_ranked``, once a signature, which is ``sig``; ``_base`` and ``_k`` are what it was made of."""
    spark = names.sparkSession
    held = bands(longest)
    length = F.length(text)
    band = F.size(F.filter(F.lit([a for a, _ in held]), lambda a: a <= length)) - 1
    # Both tables are bounded: by the logarithm of the longest name, and by COMBINATIONS.
    pairs = F.broadcast(spark.createDataFrame([(p[side], *p) for p in band_pairs(longest, floor)], "_band int, _a int, _b int, _common int, _k int"))
    places = [f"_c{i}" for i in range(MOST)]
    choices = F.broadcast(spark.createDataFrame(_choices(), "_ck int, _cp int, " + ", ".join(f"{c} int" for c in places)))
    rows = names.withColumn("_band", band).join(pairs, "_band").filter(length >= F.col("_common"))
    rows = rows.withColumn("_prefix", F.slice("_ranked", F.lit(1), F.greatest(length - F.col("_common") + F.col("_k"), F.lit(0)))).withColumn("_base", F.col("_a") * 4096 + F.col("_b"))
    rows = rows.drop("_band", "_a", "_b", "_common")
    many = rows.join(choices, (F.col("_k") == F.col("_ck")) & (F.size("_prefix") == F.col("_cp"))).withColumn("sig", _signature([F.get("_prefix", F.col(c)) for c in places]))
    one = rows.filter("_k = 1").withColumn("_one", F.explode("_prefix")).withColumn("sig", _signature([F.col("_one"), *[F.lit(None).cast("int")] * (MOST - 1)]))
    return many.drop("_ck", "_cp", "_prefix", *places).unionByName(one.drop("_one", "_prefix"))


def _grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """(sig, rows, columns) of the signatures that are laid out as grids."""
    count = lambda df, name: df.groupBy("sig").agg(F.count("*").alias(name))
    both = count(left, "l").join(count(right, "r"), "sig").filter(F.greatest("l", "r") > GRID_ROWS)
    return both.select("sig", F.ceil(F.col("l") / GRID_ROWS).cast("int").alias("_rows"), F.ceil(F.col("r") / GRID_ROWS).cast("int").alias("_columns"))


def candidates(left: DataFrame, right: DataFrame, left_text: str, right_text: str, floor: float, condition: Column | None = None) -> DataFrame:
    """Rows of ``left`` joined to those of ``right`` whose indel ratio may be ``floor`` or more, each pair once.

    The sides have no column in common. Every pair that reaches the floor is
    among them; empty and null names are in none. ``condition`` is a further
    one over both sides' columns.
    """
    floor = floor - EPSILON
    rank = rarity(right, right_text)

    def prepared(df: DataFrame, text: str) -> DataFrame:
        """Names with their tokens, written once: counts and join read them again."""
        return materialise(df.filter(F.length(text) > 0).withColumn("_ranked", F.array_sort(F.transform(_tokens(F.col(text)), rank))))

    left, right = prepared(left, left_text), prepared(right, right_text)
    longest = max([r[0] or 0 for df, text in ((left, left_text), (right, right_text)) for r in df.agg(F.max(F.length(text))).collect()])
    keyed = lambda df, text, side: _emit(df.select(text, "_ranked"), text, longest, floor, side).select("sig")
    grid = materialise(_grid(keyed(left, left_text, 0), keyed(right, right_text, 1)))
    n = grid.limit(GRID_BROADCAST + 1).count()
    a = _emit(left, left_text, longest, floor, 0).withColumnRenamed("_ranked", "_lp")
    # The two sides agree on the base and the number of tokens; one is enough.
    b = _emit(right, right_text, longest, floor, 1).withColumnRenamed("_ranked", "_rp").drop("_base", "_k")
    keys = ["sig"]
    if n:
        hint = F.broadcast(grid) if n <= GRID_BROADCAST else grid
        of = lambda text, cells: F.pmod(F.xxhash64(text), F.coalesce(cells, F.lit(1))).cast("int")
        along = lambda cells: F.explode(F.sequence(F.lit(0), F.coalesce(cells, F.lit(1)) - 1))
        a = a.join(hint, "sig", "left").withColumn("_x", of(left_text, F.col("_rows"))).withColumn("_y", along(F.col("_columns"))).drop("_rows", "_columns")
        b = b.join(hint, "sig", "left").withColumn("_y", of(right_text, F.col("_columns"))).withColumn("_x", along(F.col("_rows"))).drop("_rows", "_columns")
        keys += ["_x", "_y"]
    la, lb = F.length(left_text), F.length(right_text)
    # Tokens are distinct, so what two names share of them is what their bags of letters share.
    shared = F.array_intersect("_lp", "_rp")
    near = (2.0 * F.least(la, lb) >= floor * (la + lb)) & (2.0 * F.size(shared) >= floor * (la + lb))
    first = F.slice(shared, F.lit(1), F.col("_k"))
    named = _signature([F.get(first, F.lit(i)) for i in range(MOST)])
    met = a.join(b, keys).filter(near if condition is None else near & condition).filter(named == F.col("sig"))
    return met.drop(*keys, "_lp", "_rp", "_base", "_k")
