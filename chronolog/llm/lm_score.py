"""Language-model scores: the marginal probability of a text under a unigram model over subword pieces.

The pieces are an existing vocabulary's tokens. Their probabilities are learned from the training texts:
add-one smoothed counts of the pieces in the encodings of all training words. A word's probability sums over
all ways to cut it, a blank in front, into pieces: a forward recursion in log space. Pieces hold a blank at most as
their first byte, so no cut crosses words and a text's probability is the product of its words' and the end's.
Each distinct word of the corpus is weighed once; texts are blocks of codes (``blocks``). The counts of whole words
give the base score only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log, log10

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolog.llm import spans
from chronolog.llm.blocks import (
    block_table, dictionary_rows, joined_planes, packed, packed_words, text_rows, unpacked, unpacked_words,
)
from chronolog.llm.shared import written

#: Words of one bucket that a task keeps scores of; beyond, it forgets them and may weigh a word again.
REMEMBERED = 500_000


class Pieces:
    """Log probabilities of the pieces; ``weight(word)`` is the log of a word's marginal probability."""

    def __init__(self, ranks: dict[bytes, int], counts: dict[int, int], ends: int) -> None:
        """``counts``: by token id. Byte strings with an inner blank are no pieces of a word."""
        usable = {t: i for t, i in ranks.items() if b" " not in t[1:]}
        total = sum(counts.get(i, 0) for i in usable.values()) + ends
        every = log(total + len(usable) + 1)
        self.end = log(ends + 1) - every
        self.logs = {t: log(counts.get(i, 0) + 1) - every for t, i in usable.items()}
        self.begins = {t[:k] for t in usable for k in range(1, len(t) + 1)}

    def weight(self, word: bytes) -> float:
        text = b" " + word
        n = len(text)
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        terms[0].append(0.0)
        for i in range(n):
            ways = terms[i]
            if not ways:
                continue
            most = max(ways)
            here = ways[0] if len(ways) == 1 else most + log(sum([exp(w - most) for w in ways]))
            terms[i] = ()
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                found = self.logs.get(piece)
                if found is not None:
                    terms[j].append(here + found)
                elif piece not in self.begins:
                    break
        most = max(terms[n])
        return most + log(sum(exp(w - most) for w in terms[n]))


def score(docs: DataFrame, learn, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``learn``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``learn`` is a boolean column of ``docs``: the rows to learn from; null counts as false. Tokens are the
    words, A-Z lower-cased, and one end, so an empty or null text has one token. Scores are log10. Without
    any training row counts are 0 and V is 0. Repeated rows count each; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    texts = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")
    )
    table = block_table(texts, spans.words, lower=True)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = spark.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The training counts of each bucket's words, and of the pieces in their encodings."""
        library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary.value, special_tokens={})
        bucket, found = None, {}

        def row() -> pa.RecordBatch:
            words, counts = list(found), np.fromiter(found.values(), dtype=np.int64, count=len(found))
            pieces = [library.encode_ordinary(" " + w.decode()) for w in words]
            sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
            ids = np.fromiter((i for p in pieces for i in p), dtype=np.int64)
            weights = np.bincount(ids, np.repeat(counts, sizes)).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
            used = np.flatnonzero(weights)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket], pa.int32()),
                    pa.array([packed_words(words)], pa.binary()),
                    pa.array([packed(counts)], pa.binary()),
                    pa.array([len(words)], pa.int64()),
                    pa.array([int(counts.sum())], pa.int64()),
                    pa.array([list(zip(used.tolist(), weights[used].tolist()))], pa.list_(pa.struct([("piece", pa.int32()), ("n", pa.int64())]))),
                ],
                names=["bucket", "words", "counts", "v", "n", "pieces"],
            )

        for batch in batches:
            for b, words, counts in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                if b != bucket:
                    if found:
                        yield row()
                    bucket, found = b, {}
                for word, c in zip(unpacked_words(words), unpacked(counts).tolist()):
                    if c:
                        found[word] = found.get(word, 0) + c
        if found:
            yield row()

    dealt = dictionary_rows(table).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    counted = written(
        dealt.mapInArrow(count, "bucket int, words binary, counts binary, v bigint, n bigint, pieces array<struct<piece:int,n:bigint>>")
    )
    ends = text_rows(table).where("learn").count()
    sums = counted.agg(F.sum("v"), F.sum("n")).first()
    v, n = (sums[0] or 0) + (ends > 0), (sums[1] or 0) + ends
    by_piece = counted.select(F.explode("pieces").alias("p")).groupBy("p.piece").agg(F.sum("p.n").alias("n"))
    # at most as many rows as the vocabulary has tokens
    learned = spark.sparkContext.broadcast({r["piece"]: r["n"] for r in by_piece.collect()})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part of a dictionary its words' training counts and log10 probabilities."""
        pieces = Pieces(vocabulary.value, learned.value, ends)
        bucket, counts, known = None, {}, {}
        for batch in batches:
            out = ([], [], [], [])
            for b, first, block, place, words, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket or len(known) > REMEMBERED:
                    known = {}
                if b != bucket:
                    bucket, counts = b, {}
                if first == 0:
                    counts.update(zip(unpacked_words(words), unpacked(numbers).tolist()))
                    continue
                found = unpacked_words(words)
                scores = np.empty(len(found))
                for k, word in enumerate(found):
                    s = known.get(word)
                    if s is None:
                        s = known[word] = pieces.weight(word) / log(10)
                    scores[k] = s
                c = np.fromiter((counts.get(w, 0) for w in found), dtype=np.int64, count=len(found))
                for column, value in zip(out, (block, place, packed(c), scores.tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=["block", "places", "counts", "scores"]
            )

    both = counted.selectExpr("bucket", "0 AS kind", "CAST(NULL AS bigint) AS block", "CAST(NULL AS binary) AS places", "words", "counts").union(
        dictionary_rows(table).selectExpr("bucket", "1 AS kind", "block", "places", "words", "CAST(NULL AS binary) AS counts")
    )
    replies = (
        both.repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "kind")
        .mapInArrow(weigh, "block bigint, places binary, counts binary, scores binary")
    )
    spread = n + (v + 1)
    end = Pieces(ranks, learned.value, ends).end / log(10)

    def sum_up(texts: pa.Table, replies: pa.Table) -> pa.Table:
        places, counts, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for p, c, s in zip(*(replies.column(k).to_pylist() for k in ("places", "counts", "scores"))):
            places.append(np.cumsum(unpacked(p)))
            counts.append(unpacked(c))
            scores.append(np.frombuffer(s))
        place, c, s = (np.concatenate(x) for x in (places, counts, scores))
        base_of, known_of, score_of = np.empty(len(place)), np.empty(len(place), np.int64), np.empty(len(place))
        base_of[place], known_of[place], score_of[place] = np.log10((c + 1) / spread), c > 0, s
        rows = [joined_planes(*c) for c in zip(*(texts.column(k).to_pylist() for k in ("c0", "c1", "c2")))]
        return pa.table(
            {
                "id": texts.column("id"),
                "learn": texts.column("learn"),
                "n_tokens": pa.array([len(r) + 1 for r in rows], pa.int64()),
                "n_known": pa.array([int(known_of[r].sum()) + (ends > 0) for r in rows], pa.int64()),
                "base_score": pa.array([float(base_of[r].sum()) + log10((ends + 1) / spread) for r in rows], pa.float64()),
                "score": pa.array([float(score_of[r].sum()) + end for r in rows], pa.float64()),
            }
        )

    schema = "id string, learn boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    done = text_rows(table).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(sum_up, schema)
    return done.select(
        F.col("id").cast(kind).alias(id_col), "learn", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
