"""Parts of exact set-similarity joins over 64-bit tokens: overlap bounds, prefixes, rarity order.

Two sets of sizes a and b with overlap o are similar when 100 * o >= 75 * (a + b - o), that is
7 * o >= 3 * (a + b); then o is at least three quarters of either size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def least_overlap(n: Column) -> Column:
    """What a set of n tokens must share with any similar set."""
    return F.floor((3 * n + 3) / 4).cast("int")


def prefix_size(n: Column, matches: Column | int = 1) -> Column:
    """Of any two similar sets in one order of tokens, prefixes of this size share ``matches`` tokens.

    Where two sets ask for different numbers of matches, they share the lesser.
    """
    return F.least(n, n - least_overlap(n) + matches)


def _asked(n: Column) -> Column:
    """Matches that the prefix pass asks of a set of n tokens."""
    return 1 + F.floor(n / 16).cast("int")


def searched(n: Column) -> Column:
    """Prefix of a set of n tokens in the prefix pass."""
    return prefix_size(n, _asked(n))


def listed(n: Column) -> Column:
    """How many tokens the prefix pass lists of a set of at most n."""
    return (F.floor(n / 4) + _asked(n)).cast("int")


def similar(overlap: Column, a: Column, b: Column) -> Column:
    return 7 * overlap >= 3 * (a + b)


def near_sizes(a: Column, b: Column) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def sharing(sets: DataFrame) -> DataFrame:
    """The ``h`` of those ``sets(h, n, tokens)`` that may have a partner: rows ``(h)``, distinct.

    ``tokens`` are the first ``searched(n)`` of a set's n tokens in the order of hashes. A set stays if as many of
    these as it must share with any similar set, which is no smaller than three quarters of it, occur in
    another ``h`` of near size. This is one shuffle of a third of the tokens and builds no pair; a common token
    gives one row for each set, one of the set's many. Rows that repeat an ``h`` don't count as others.
    """
    # 48 bits of a token do: a chance meeting lets a set pass that has no partner, never the reverse
    rows = sets.select("h", "n", F.explode("tokens").alias("token"))
    rows = rows.select("h", "n", F.shiftrightunsigned("token", 16).alias("token"))
    by_size = Window.partitionBy("token").orderBy("n", "h")
    same = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.select(
        "h", "n",
        F.lag("h").over(by_size).alias("h_below"), F.lag("n").over(by_size).alias("below"), F.lead("n").over(by_size).alias("above"),
        F.min("h").over(same).alias("low"), F.max("h").over(same).alias("high"),
    )
    near = (4 * F.col("below") >= 3 * F.col("n")) | (3 * F.col("above") <= 4 * F.col("n"))
    met = seen.where("low < high").where(F.col("h_below").isNull() | (F.col("h_below") != F.col("h"))).where(near)
    return met.groupBy("h", "n").count().where(F.col("count") >= _asked(least_overlap(F.col("n")))).select("h").distinct()


def meeting(rows: DataFrame) -> DataFrame:
    """As ``sharing``, for rows ``(h, least, most, token)`` of sets whose sizes are known by bounds only.

    A set lists its first tokens in one order of all tokens, ``listed(most)`` different ones or all it has.
    """
    rows = rows.withColumn("token", F.shiftrightunsigned("token", 16))
    by_size = Window.partitionBy("token").orderBy("least", "h")
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.select(
        "h", "least", "most",
        F.lag("h").over(by_size).alias("h_below"), F.max("most").over(before).alias("below"),
        F.lead("h").over(by_size).alias("h_above"), F.lead("least").over(by_size).alias("above"),
    )
    # rows of one h lie together: its first one tells of the sets below, its last one of those above
    near_below = (F.col("h_below") != F.col("h")) & (4 * F.col("below") >= 3 * F.col("least"))
    near_above = (F.col("h_above") != F.col("h")) & (3 * F.col("above") <= 4 * F.col("most"))
    met = seen.where(near_below | near_above)
    return met.groupBy("h", "least").count().where(F.col("count") >= _asked(least_overlap(F.col("least")))).select("h").distinct()


def by_rarity(sets: DataFrame) -> DataFrame:
    """``sets(key, tokens)`` as ``(key, n, shared)``: tokens of two sets or more, rarest first.

    ``shared`` is an array of ``(df, token)`` structs. Tokens of one set only are left out: they come
    first in the order, but meet nothing, and no overlap needs them. Sets without shared tokens go. Keys
    should be small numbers: each travels once with every token.
    """
    rows = sets.select("key", F.size("tokens").alias("n"), "tokens").select("key", "n", F.explode("tokens").alias("token"))
    counted = rows.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    return counted.groupBy("key", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "token"))).alias("shared")
    )


def reach(n: Column, shared: Column, matches: Column | int = 1) -> Column:
    """How many of ``shared`` lie in the prefix that shares ``matches`` tokens with any similar set."""
    alone = n - F.size(shared)
    return F.greatest(F.lit(0), F.least(F.size(shared), prefix_size(n, matches) - alone))


def overlap(a: Column, b: Column) -> Column:
    """Tokens in both of two ``shared`` arrays."""
    tokens = lambda x: F.transform(x, lambda e: e["token"])
    return F.size(F.array_intersect(tokens(a), tokens(b)))
