"""Benchmark decontamination: test items found inside documents of any length.

An item is found when a document holds three quarters or more of its distinct five-word shingles (A-Z
lower-cased); an item of fewer than five words is one run of all its words. Items are partitioned by the
size of their shingle set, in powers of two. A partition fixes the length of its items' MinHash signature:
the least hashes of the set, more than twice as many as an item of that size may miss. What a document
cannot miss follows: it holds at least the signature's length less a quarter of the item's shingles. So the
search finds every such document, however long, and asks for several matches before a pair is
verified on the shingles themselves. Documents need no signature: their hashes are looked up as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolog.functions.text import pinned
from chronolog.llm.shared import fresh, small, written
from chronolog.llm.shingles import WIDTH, folded, hashes, words


def _strings(width: int):
    """The distinct runs of ``width`` words of column ``w``, as texts."""
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.array_join(F.slice("w", i, width), " "))
    return F.when(F.size("w") >= width, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def signatures(items: DataFrame) -> DataFrame:
    """Per item with words: ``key`` (id and text hash), ``width``, ``n``, ``signature`` and ``needed``."""
    texts = items.select("item_id", "text").dropDuplicates()
    split = texts.select(
        F.struct("item_id", F.xxhash64("text").alias("h")).alias("key"), pinned(words(folded(F.col("text")))).alias("w")
    ).where("size(w) > 0")
    width = F.least(F.size("w"), F.lit(WIDTH))
    sets = split.select("key", width.alias("width"), pinned(F.sort_array(F.array_distinct(hashes(F.col("w"))))).alias("set"))
    n = F.size("set")
    upper = F.pow(2, F.floor(F.log2(n)) + 1) - 1  # the largest set of the item's partition
    length = F.least(n, (2 * F.floor(upper / 4) + 1).cast("int"))
    return sets.select(
        "key",
        "width",
        n.alias("n"),
        F.slice("set", F.lit(1), length).alias("signature"),
        (length - F.floor(n / 4)).alias("needed"),
    )


def candidates(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs ``(doc_id, h, key)`` of documents, by id and text hash, and items whose signature they meet."""
    sought = small(written(signed.select("key", "width", "needed", F.explode("signature").alias("hash"))))
    widths = [r[0] for r in signed.select("width").distinct().collect()]  # at most five
    split = docs.select("doc_id", F.xxhash64("text").alias("h"), pinned(words(folded(F.col("text")))).alias("w"))
    found = None
    for width in sorted(widths):
        runs = hashes(F.col("w"), width)
        rows = split.where(F.size("w") >= width).select("doc_id", "h", F.explode(F.array_distinct(runs)).alias("hash"))
        met = rows.join(sought.where(F.col("width") == width), "hash").groupBy("doc_id", "h", "key", "needed").count()
        met = met.where("count >= needed").select("doc_id", "h", "key")
        found = met if found is None else found.union(met)
    return found


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Found items: ``(doc_id, h, item_id, n_item, n_shared)``, a row for each document text and item.

    Null or wordless texts hold nothing and are found nowhere. Rows that repeat id and text, of either
    table, count once; a null id is an id like any other. Items that hold others' text are found each for
    itself. Either table may be empty: then there are no rows. Other columns are not read.
    """
    signed = written(signatures(items))
    if not signed.head(1):
        return docs.sparkSession.createDataFrame([], "doc_id bigint, h bigint, item_id bigint, n_item bigint, n_shared bigint")
    pairs = written(candidates(docs, signed))
    marked = pairs.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "key")
    hit = small(written(marked.select("d", "g").distinct()))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    seen = texts.join(hit, (F.col("h") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    split = seen.dropDuplicates(["doc_id", "h"]).select("doc_id", "h", pinned(words(folded(F.col("text")))).alias("w"))
    of_items = items.select("item_id", "text").dropDuplicates().select(
        F.struct("item_id", F.xxhash64("text").alias("h")).alias("key"), pinned(words(folded(F.col("text")))).alias("w")
    )
    result = None
    for width in sorted(r[0] for r in signed.select("width").distinct().collect()):
        of_width = signed.where(F.col("width") == width).select("key", "n")
        wanted = of_items.join(small(of_width), "key").select("key", "n", pinned(_strings(width)).alias("runs"))
        held = split.select("doc_id", "h", pinned(_strings(width)).alias("held"))
        same = (F.col("h") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d"))
        both = held.join(marked, same).join(wanted, "key")
        shared = both.select("doc_id", "h", "key.item_id", "n", pinned(F.size(F.array_intersect("runs", "held"))).alias("shared"))
        rows = shared.where("100 * shared >= 75 * n").select(
            "doc_id", "h", "item_id", F.col("n").cast("bigint").alias("n_item"), F.col("shared").cast("bigint").alias("n_shared")
        )
        result = rows if result is None else result.union(rows)
    return result


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found; own columns and rows."""
    ident, hashed = fresh("id", "h")
    found = written(leaks(docs, items).select(F.col("doc_id").alias(ident), F.col("h").alias(hashed)).distinct())
    same = (F.xxhash64("text") == F.col(hashed)) & F.col("doc_id").eqNullSafe(F.col(ident))
    return docs.join(small(found), same, "left_anti")
