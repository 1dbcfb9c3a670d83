"""Line dedup: later lines that match an earlier one are taken out of the documents.

A line's tokens are its distinct five-word shingles, with A-Z lower-cased. A line goes when an earlier
line of the corpus (order: doc_id, hash of the text, place in the document) has the same or a similar token set,
by a Jaccard similarity of 0.75 or more; it does not matter whether that earlier line itself stays.
A line of one to four words has one token, its words as a whole; a line without a word stays.

How: lines equal but for the case of A-Z form classes by a 128-bit hash, lines of under five words by their
words alone, which settles them; of longer ones only a class's first line is compared. A prefix pass, in the
order of the hashes of shingles' first two words, finds the classes that can have a partner at all (``meeting``); for
these, tokens are ordered by rarity, and prefix, positional and length filters give candidates, whose Jaccard is verified.
Candidates are first sought with the earliest line of each token; only lines still unmatched then meet
all earlier lines of their tokens, so that a family of thousands of variants makes no square of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.functions.text import pinned
from chronolog.llm.setjoin import by_rarity, listed, meeting, near_sizes, overlap, reach, similar
from chronolog.llm.shared import fresh, small, written
from chronolog.llm.shingles import WIDTH, distinct_hashes, folded, words

SOME_WORD = r"[^ \t\n\x0B\f\r]"
LONG_ENOUGH = r"^[ \t\x0B\f\r]*([^ \t\n\x0B\f\r]+[ \t\x0B\f\r]+){4}[^ \t\n\x0B\f\r]"
#: A line that makes up more than this part of all lines is compared at its first place only; there
#: can be no more than 1 / HEAVY of them, so their list is broadcast.
HEAVY = 1 / 10_000
PLACE = ("doc_id", "row", "line_no")


def _row_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a word: place, 128-bit hash of the folded line, and its image where it has five words or more.

    A shorter line's hash is that of its words with single blanks: it tells all that its one token does.
    """
    rows = docs.select("doc_id", _row_hash().alias("row"), F.posexplode(F.split(folded(F.col("text")), "\n")).alias("line_no", "line"))
    long = pinned(F.when(F.col("line").rlike(LONG_ENOUGH), F.col("line")))
    rows = rows.where(F.col("line").rlike(SOME_WORD)).select(F.struct(*PLACE).alias("place"), "line", long.alias("long"))
    told = pinned(F.coalesce("long", F.concat_ws(" ", words(F.col("line")))))
    rows = rows.select("place", "long", told.alias("told"))
    return rows.select("place", F.xxhash64("told").alias("h"), F.xxhash64(F.lit(1), "told").alias("h2"), F.col("long").alias("line"))


def _words(line: Column) -> Column:
    """As ``words``; where blanks are the only white space, no pattern is needed, which is much faster."""
    blanks = F.array_remove(F.split(line, " "), "")
    return F.when(line.rlike(r"[\t\n\x0B\f\r]"), words(line)).otherwise(blanks)


def _with_tokens(lines: DataFrame, *keep: str) -> DataFrame:
    split = lines.select(*keep, pinned(_words(F.col("line"))).alias("w"))
    return split.select(*keep, pinned(distinct_hashes(F.col("w"))).alias("tokens"))


def _prefixes(lines: DataFrame) -> DataFrame:
    """Shingles of ``lines(h, line)`` for the prefix pass: rows ``(h, least, most, token)``.

    Shingles are ordered by the hash of their first two words; a line lists all up to the order's place
    at which ``listed`` different pairs are reached, so at least as many different shingles, or all it has.
    Pairs and places tell bounds of the line's number of different shingles, ``least`` and ``most``. Only
    what is listed is hashed as a whole, from the hashes of the pairs.
    """
    w = lines.select("h", pinned(_words(F.col("line"))).alias("w"))
    after = F.slice("w", F.lit(2), F.size("w") - 1)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), after, lambda a, b: F.xxhash64(a, b))
    rows = w.select("h", (F.size("w") - (WIDTH - 1)).alias("most"), pinned(pairs).alias("p"))
    order = F.sort_array(F.array_distinct(F.slice("p", F.lit(1), F.col("most"))))
    rows = rows.select("h", "most", "p", pinned(order).alias("order"))
    least = F.size("order")
    last = F.element_at("order", F.least(least, listed(F.col("most"))))
    rows = rows.select("h", "most", "p", pinned(least).alias("least"), pinned(last).alias("last"))
    at = lambda k: F.get("p", k.cast("int"))
    token = lambda i: F.xxhash64(at(i), at(i + 2), at(i + 3))
    # a line that repeats a pair may repeat a shingle: it lists each once, or "a a a ..." would be one token's many rows
    places = F.sequence(F.lit(0).cast("bigint"), F.col("most").cast("bigint") - 1)
    once = F.array_distinct(F.transform(F.filter(places, lambda i: at(i) <= F.col("last")), token))
    repeats = F.col("least") < F.col("most")
    rows = rows.select("*", F.explode(F.when(repeats, once).otherwise(places)).alias("e")).where(repeats | (at(F.col("e")) <= F.col("last")))
    return rows.select("h", "least", "most", F.when(repeats, F.col("e")).otherwise(token(F.col("e"))).alias("token"))


def _at_places(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The folded lines at the places of ``firsts(key, first)``: one row ``(key, line)`` each."""
    at = F.sort_array(F.collect_list(F.struct("first.line_no", "key"))).alias("at")
    sought = written(firsts.groupBy(F.col("first.doc_id").alias("ident"), F.col("first.row").alias("row")).agg(at))
    texts = docs.select("doc_id", _row_hash().alias("hash"), "text")
    found = texts.join(small(sought), (F.col("hash") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("ident")))
    split = found.select("at", pinned(F.split(folded(F.col("text")), "\n")).alias("split"))
    rows = split.select("split", F.explode("at").alias("e")).select("e.key", F.get("split", F.col("e.line_no")).alias("line"))
    return rows.dropDuplicates(["key"])


def _matched(sets: DataFrame, places: DataFrame) -> DataFrame:
    """Keys of ``sets(key, tokens)`` that are similar to a set at an earlier one of ``places(key, place)``."""
    sets = written(by_rarity(sets))
    placed = sets.select("key", "n", "shared").join(small(places), "key")
    described = placed.select(
        F.struct("place", "key", "n").alias("x"),
        (F.col("n") - F.size("shared")).alias("alone"),
        F.slice("shared", F.lit(1), reach(F.col("n"), F.col("shared"))).alias("first"),
    )
    rows = described.select("x", "alone", F.posexplode("first").alias("at", "e")).select("x", (F.col("alone") + F.col("at")).alias("i"), F.col("e.token").alias("token"))

    def verified(pairs: DataFrame) -> DataFrame:
        chosen = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
        left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
        right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
        both = chosen.join(left, "a").join(right, "b")
        return both.where(similar(overlap(F.col("sa"), F.col("sb")), F.col("na"), F.col("nb"))).select(F.col("a").alias("key")).distinct()

    # the shared token is the first one at best: what follows it bounds the overlap
    left = lambda v, i: F.col(f"{v}.n") - F.col(i)
    enough = 7 * F.least(left("x", "i"), left("y", "j")) >= 3 * (F.col("x.n") + F.col("y.n"))
    fits = near_sizes(F.col("x.n"), F.col("y.n")) & enough
    first = rows.groupBy("token").agg(F.min(F.struct(F.col("x").alias("y"), F.col("i").alias("j"))).alias("f"))
    led = rows.join(first, "token").select("x", "i", "f.y", "f.j").where("x.place > y.place").where(fits)
    done = written(verified(led))
    rest = rows.join(done, F.col("x.key") == F.col("key"), "left_anti")
    earlier = rows.select(F.col("x").alias("y"), F.col("i").alias("j"), "token")
    more = rest.join(earlier, (rest.token == earlier.token) & (F.col("x.place") > F.col("y.place")) & fits)
    return done.union(verified(more)).distinct()


def later_matches(docs: DataFrame) -> DataFrame:
    """Lines to take out, as ``(doc_id, row, lines)``: for a text, by its hash, the sorted line numbers."""
    lines = _lines(docs)
    known = written(lines.select("place", "h", "h2"))
    classes = written(known.groupBy("h", "h2").agg(F.min("place").alias("first"), F.count("*").alias("copies")))
    total = classes.agg(F.sum("copies")).first()[0] or 0
    heavy = classes.where(F.col("copies") > max(1.0, total * HEAVY)).select("h", "h2", F.col("first").alias("only"))
    compared = lines.where("line IS NOT NULL").join(F.broadcast(heavy), ["h", "h2"], "left").where("only IS NULL OR only = place")
    partnered = written(meeting(_prefixes(compared)))
    firsts = classes.join(small(partnered), "h", "left_semi").select("h", "h2", "first")
    firsts = written(firsts.withColumn("key", F.monotonically_increasing_id()))
    matched = _matched(_with_tokens(_at_places(docs, firsts), "key"), firsts.select("key", F.col("first").alias("place")))
    matched = written(firsts.join(small(written(matched)), "key").select("h", "h2", F.lit(True).alias("whole")))
    hit = (
        classes.join(small(matched), ["h", "h2"], "left")
        .where("copies > 1 OR whole")
        .select("h", "h2", F.when(F.col("whole").isNull(), F.col("first")).alias("stays"))
    )
    gone = known.join(small(written(hit)), ["h", "h2"]).where("stays IS NULL OR stays <> place")
    return gone.groupBy("place.doc_id", "place.row").agg(F.sort_array(F.collect_set("place.line_no")).alias("lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with later matches gone from ``text``, and ``removed_lines``, their number.

    All columns stay; the other lines of a text stay in order. A null text stays null, an empty one
    empty; a document may become empty. Rows that repeat both id and text are edited alike, as one
    document; a null id comes first in the order. An empty table gives an empty table. A column that
    is already called ``removed_lines`` is replaced.
    """
    ident, row, lines, hashed, split = fresh("id", "row", "lines", "hash", "split")
    gone = written(later_matches(docs)).select(F.col("doc_id").alias(ident), F.col("row").alias(row), F.col("lines").alias(lines))
    joined = docs.drop("removed_lines").withColumn(hashed, _row_hash()).join(
        small(gone), (F.col(hashed) == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(ident)), "left"
    )
    stays = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), F.col(lines))
    packed = joined.withColumn(split, pinned(F.when(F.col(lines).isNotNull(), F.split("text", "\n"))))
    text = F.array_join(F.transform(stays, lambda i: F.get(F.col(split), i)), "\n")
    return (
        packed.withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(text))
        .withColumn("removed_lines", F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("bigint"))
        .drop(ident, row, lines, hashed, split)
    )
