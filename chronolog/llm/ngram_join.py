"""N-gram Jaccard join: documents whose five-word shingle sets have a similarity of 0.75 or more.

Exact copies (of the word sequence, A-Z lower-cased) form classes by a 128-bit hash, and one document
stands for its class. A prefix pass in hash order finds the documents that can have a partner at
all. For these, shingles are ordered by rarity, and each document chooses how many matches it asks for:
a prefix longer by one shingle for each further match, where the estimated cost of candidates falls by
it. Two documents become a candidate when their prefixes, cut to what the sizes of the pair demand, share as
many shingles as the lesser of the two asks, unless counts of their shingles by parts of the hash space bound the
overlap below what is needed; then the overlap is counted exactly.

``groups`` needs no pair inside a group that is known to hang together: each document is first compared
with one pivot, of the documents that hold fewest shingles of their own the one it shares most with; only
documents in different components then meet. ``links`` gives every pair between class representatives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.functions.text import pinned
from chronolog.llm.setjoin import by_rarity, near_sizes, reach, searched, sharing, similar
from chronolog.llm.shared import bucketed, components, fresh, small, written
from chronolog.llm.shingles import distinct_hashes, folded, words

#: Most matches a document may ask for.
MOST_MATCHES = 4
#: Shared shingles are counted in so many parts by hash, to bound overlaps.
PARTS = 32
#: What checking a candidate costs for each of its shingles, in posting entries.
CHECK = 0.25
#: A class with more than this part of all documents is compared by its first row only.
HEAVY = 1 / 10_000


def _sets(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the 128-bit hash of the words, and the sorted distinct shingle hashes ``tokens``."""
    split = docs.select(*keep, pinned(words(folded(F.col("text")))).alias("w"))
    joined = F.array_join("w", " ")
    return split.select(
        *keep,
        F.xxhash64(joined).alias("h"),
        F.xxhash64(F.lit(1), joined).alias("h2"),
        pinned(distinct_hashes(F.col("w"))).alias("tokens"),
    )


def _matches(n: Column, shared: Column) -> Column:
    """The number of matches a document asks for: the one of least estimated cost.

    Cost is the postings of the prefix, plus checking the candidates, of which each uses up as many
    postings as matches are asked.
    """

    def cost(m: Column) -> Column:
        prefix = F.slice(shared, F.lit(1), reach(n, shared, m))
        met = F.aggregate(prefix, F.lit(0).cast("double"), lambda acc, e: acc + e["df"] - 1)
        return F.struct((met * (1 + CHECK * n / m)).alias("cost"), m.alias("m"))

    options = F.transform(F.array(*[F.lit(m) for m in range(1, MOST_MATCHES + 1)]), cost)
    return F.array_min(options)["m"]


def _may_meet() -> Column:
    """Whether a token at place i of x and j of y can be among the first that a similar pair must share.

    For sizes a and b they share at least 3 (a + b) / 7 tokens. Of these the first m, m being the lesser number
    of matches asked for, lie before place a - 3 (a + b) / 7 + m of x, and likewise in y.
    """
    a, b = F.col("x.n"), F.col("y.n")
    m = F.least("x.asks", "y.asks")
    early = lambda n, place: 7 * (n - F.col(place) + m - 1) >= 3 * (a + b)
    return near_sizes(a, b) & early(a, "i") & early(b, "j")


def _most_shared() -> Column:
    """What two documents can share at most: in each part by hash no more than the lesser of their counts."""
    terms = [F.least(F.col(f"counts.c{k}"), F.col(f"others.c{k}")) for k in range(PARTS)]
    return reduce(lambda a, b: a + b, terms)


class Prepared:
    """Written tables of one join: all rows' hashes, classes, rarity lists and prefix postings."""

    def __init__(self, docs: DataFrame) -> None:
        texts = docs.select("doc_id", "text")
        n = F.size("tokens")
        first = F.slice("tokens", F.lit(1), searched(n))
        self.rows = written(_sets(texts, "doc_id").select("doc_id", "h", "h2", n.alias("n"), first.alias("tokens")))
        full = self.rows.where("n > 0 AND doc_id IS NOT NULL")
        self.classes = written(
            full.groupBy("h", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
        )
        total = self.classes.agg(F.sum("copies")).first()[0] or 0
        heavy = self.classes.where(F.col("copies") > max(1.0, total * HEAVY)).select("h", "h2", F.col("first").alias("only"))
        compared = full.join(F.broadcast(heavy), ["h", "h2"], "left").where("only IS NULL OR only = doc_id")
        partnered = written(sharing(compared.select("h", "n", "tokens")))
        chosen = self.classes.join(small(partnered), "h", "left_semi").select("h", "h2", F.col("first").alias("doc_id"))
        chosen = written(chosen.withColumn("key", F.monotonically_increasing_id()))
        seen = texts.join(small(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
        sets = _sets(seen, "doc_id").join(small(chosen), ["h", "h2", "doc_id"]).select("key", "tokens")
        rows = full.join(small(chosen), ["h", "h2", "doc_id"], "left_semi")
        if rows.groupBy("doc_id", "h", "h2").count().where("count > 1").head(1):
            sets = sets.dropDuplicates(["key"])  # rows that repeat both id and text
        self.names = chosen.select("key", F.struct("doc_id", "h", "h2").alias("name"))
        lists = by_rarity(sets.select("key", "tokens"))
        asked = lists.withColumn("asks", pinned(_matches(F.col("n"), F.col("shared"))))
        taken = reach(F.col("n"), F.col("shared"), F.col("asks"))
        self.lists = bucketed(asked.where(taken > 0), "key")
        alone = F.col("n") - F.size("shared")
        described = self.lists.select(
            F.struct("key", "n", "asks", (-alone / F.col("n")).alias("central")).alias("x"),
            alone.alias("alone"),
            F.slice("shared", F.lit(1), taken).alias("first"),
        )
        placed = described.select("x", "alone", F.posexplode("first").alias("at", "e"))
        self.postings = written(placed.select("x", (F.col("alone") + F.col("at")).alias("i"), F.col("e.token").alias("token")))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs(a, b)`` of keys the similar ones, with their overlap and sizes."""
        tokens = F.transform("shared", lambda e: e["token"])
        sets = self.lists.select("key", "n", tokens.alias("tokens"))
        left = sets.withColumnsRenamed({"key": "a", "n": "n_a", "tokens": "of_a"})
        right = sets.withColumnsRenamed({"key": "b", "n": "n_b", "tokens": "of_b"})
        both = pairs.join(left, "a").join(right, "b")
        counted = both.select("a", "b", "n_a", "n_b", pinned(F.size(F.array_intersect("of_a", "of_b"))).alias("overlap"))
        return counted.where(similar(F.col("overlap"), F.col("n_a"), F.col("n_b")))

    def named(self, pairs: DataFrame) -> DataFrame:
        """Pairs of keys as pairs of class names; names begin with the least doc_id."""
        names = small(self.names)
        first = names.select(F.col("key").alias("a"), F.col("name").alias("name_a"))
        second = names.select(F.col("key").alias("b"), F.col("name").alias("name_b"))
        joined = pairs.join(first, "a").join(second, "b").drop("a", "b")
        return joined.withColumnsRenamed({"name_a": "a", "name_b": "b"})

    def part_counts(self, keys: DataFrame) -> DataFrame:
        """How many of a document's shared shingles fall into each of ``PARTS`` parts, for some keys."""
        lists = self.lists.select("key", "shared").join(small(written(keys)), "key", "left_semi")
        parts = lists.select("key", pinned(F.transform("shared", lambda e: F.pmod(e["token"], F.lit(PARTS)))).alias("parts"))
        held = lambda k: F.size(F.filter("parts", lambda part: part == k))
        counts = [held(k).alias(f"c{k}") for k in range(PARTS)]
        return written(parts.select("key", F.struct(*counts).alias("counts")))

    def to_pivots(self) -> DataFrame:
        """One candidate pair per document: with the pivot it shares most prefix shingles with."""
        pivots = self.postings.groupBy("token").agg(F.max(F.struct("x.central", F.col("x").alias("y"), F.col("i").alias("j"))).alias("p"))
        met = (
            self.postings.join(pivots, "token")
            .select("x", "i", "p.y", "p.j")
            .where(F.col("x.key") != F.col("y.key"))
            .where(_may_meet())
            .groupBy("x", "y")
            .count()
        )
        best = met.groupBy(F.col("x.key").alias("a")).agg(F.max(F.struct("count", F.col("y.key").alias("b"))).alias("best"))
        return best.select("a", "best.b")

    def between(self, labels: DataFrame | None) -> DataFrame:
        """All candidate pairs, or only those between different ``labels(id, component)``."""
        rows = self.postings
        if labels is None:
            rows = rows.withColumn("part", F.col("x.key"))
        else:
            rows = rows.join(labels, F.col("x.key") == F.col("id"), "left")
            rows = rows.select("x", "i", "token", F.coalesce("component", "x.key").alias("part"))
        rows = written(rows)
        mixed = rows.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
        rows = written(rows.join(mixed.select("token"), "token", "left_semi"))
        counts = self.part_counts(rows.select(F.col("x.key").alias("key")).distinct())
        rows = rows.join(small(counts), F.col("x.key") == F.col("key")).drop("key")
        other = rows.select(*[F.col(a).alias(b) for a, b in (("x", "y"), ("i", "j"), ("token", "t"), ("part", "q"), ("counts", "others"))])
        pairs = rows.join(
            other,
            (F.col("token") == F.col("t"))
            & (F.col("x.key") < F.col("y.key"))
            & (F.col("part") != F.col("q"))
            & _may_meet()
            & similar(_most_shared(), F.col("x.n"), F.col("y.n")),
        )
        met = pairs.groupBy("x", "y").count().where(F.col("count") >= F.least("x.asks", "y.asks"))
        return met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def links(docs: DataFrame) -> DataFrame:
    """Every similar pair between classes of copies: ``(a, b, n_a, n_b, overlap)``.

    ``a`` and ``b`` are structs of the class's least doc_id and its hash; copies are not expanded. The
    result may be as large as the links are many.
    """
    prepared = Prepared(docs)
    return prepared.named(prepared.verified(prepared.between(None)))


def groups(docs: DataFrame) -> DataFrame:
    """Each row's ``doc_id``, ``n_shingles``, ``component_id`` and ``h``, the hash of its words.

    The component is the least doc_id reachable by links. A text without words, null or empty, has no
    shingle and links with nothing, copies included; a null doc_id has no component. Repeated rows are
    copies of each other. Other columns are not read. An empty table gives no rows.
    """
    prepared = Prepared(docs)
    near = written(prepared.verified(prepared.to_pivots()).select("a", "b"))
    rest = written(prepared.verified(prepared.between(components(near))).select("a", "b"))
    labels = components(prepared.named(near.union(rest)).select("a", "b"))
    named = prepared.classes.select("h", "h2", F.struct(F.col("first").alias("doc_id"), "h", "h2").alias("id"))
    classes = named.join(labels, "id", "left").select("h", "h2", F.coalesce("component.doc_id", "id.doc_id").alias("component"))
    rows = prepared.rows.select("doc_id", "h", "h2", "n")
    return rows.join(classes, ["h", "h2"], "left").select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
        "h",
        "h2",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay when each group keeps the one of least doc_id; own columns.

    Documents without words and rows without a doc_id all stay. Of rows that repeat id and words one stays.
    """
    ident, words_hash, hashed = fresh("id", "h", "hash")
    found = written(groups(docs))
    named = [F.col("doc_id").alias(ident), F.col("h").alias(words_hash)]
    gone = written(found.where("component_id <> doc_id").select(*named).distinct())
    again = written(found.where("component_id = doc_id AND n_shingles > 0").groupBy(*named).count().where("count > 1"))
    marked = docs.withColumn(hashed, F.xxhash64(F.array_join(words(folded(F.col("text"))), " ")))
    same = (F.col("doc_id") == F.col(ident)) & (F.col(hashed) == F.col(words_hash))
    kept = marked.join(small(gone), same, "left_anti")
    if again.head(1):
        again = small(again.select(ident, words_hash))
        twice = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", hashed])
        kept = kept.join(again, same, "left_anti").unionByName(twice)
    return kept.drop(hashed)
