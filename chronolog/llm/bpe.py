"""Byte-level BPE encoding and decoding by a public rank file.

Texts become blocks of codes over the blocks' distinct words (``blocks``); the words of all dictionaries
are shuffled by their hash, so that each distinct word of the corpus meets one task, is encoded once, and
its ids go back to the blocks, where they are put in the words' places. Decoding looks ids up in the table of the
tokens' bytes, a constant of the plan: a vocabulary is bounded, whatever the corpus.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolog.llm import spans
from chronolog.llm.blocks import block_table, dictionary_rows, joined_planes, packed, text_rows, unpacked, unpacked_words

#: A task remembers the ids of so many words; beyond, it forgets them and may encode a word again.
REMEMBERED = 500_000
#: Texts whose ids are put together at once, to bound a worker's memory.
ROWS = 200


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a token in base 64 and its id on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``id_col`` and ``ids``, an array of token ids as the tiktoken library gives them.

    No special tokens are known. A null or empty text has no ids. Repeated rows give repeated results,
    a null id stays null; other columns are not read. ``pattern`` has to be the public pattern that
    ``spans.pretokens`` follows.
    """
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.lit(False).alias("learn"))
    table = block_table(texts, spans.pretokens)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ranks)

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        known: dict[bytes, bytes] = {}
        for batch in batches:
            blocks, places, sizes, flat = [], [], [], []
            for block, place, words in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if len(known) > REMEMBERED:
                    known.clear()
                found = []
                for word in unpacked_words(words):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = array("i", library.encode_ordinary(word.decode())).tobytes()
                    found.append(ids)
                blocks.append(block)
                places.append(place)
                sizes.append(packed(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4))
                flat.append(packed(np.frombuffer(b"".join(found), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), *[pa.array(x, pa.binary()) for x in (places, sizes, flat)]],
                names=["block", "places", "sizes", "ids"],
            )

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    replies = (
        dictionary_rows(table).drop("counts")
        .repartition(partitions, "bucket")
        .mapInArrow(to_ids, "block bigint, places binary, sizes binary, ids binary")
    )

    def put_back(texts: pa.Table, replies: pa.Table) -> pa.Table:
        places, sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for place, size, ids in zip(*(replies.column(k).to_pylist() for k in ("places", "sizes", "ids"))):
            places.append(np.cumsum(unpacked(place)))
            sizes.append(unpacked(size))
            flat.append(unpacked(ids))
        place, size, ids = (np.concatenate(x) for x in (places, sizes, flat))
        size_of, start_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        size_of[place], start_of[place] = size, np.cumsum(size) - size
        ids = ids.astype(np.int32)
        del places, sizes, flat, place, size
        columns = [texts.column(k) for k in ("c0", "c1", "c2")]
        parts = []
        for k in range(0, len(texts), ROWS):
            lists, ends = [np.zeros(0, np.int32)], [0]
            for c in zip(*(column.slice(k, ROWS).to_pylist() for column in columns)):
                codes = joined_planes(*c)
                n = size_of[codes]
                total = int(n.sum())
                lists.append(ids[np.arange(total) + np.repeat(start_of[codes] - (np.cumsum(n) - n), n)])
                ends.append(ends[-1] + total)
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int32())))
        return pa.table({"id": texts.column("id"), "ids": pa.chunked_array(parts, pa.list_(pa.int32()))})

    done = text_rows(table).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(put_back, "id string, ids array<int>")
    return done.select(F.col("id").cast(kind).alias(id_col), "ids")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with ``out_col``, the bytes of their ids; null for a null array. An unknown id raises.

    The table of tokens is one constant of the plan, in hexadecimal: beside the workers that encode, no others are needed.
    """
    by_id = {i: token.hex() for token, i in ranks.items()}
    unknown = "-"
    tokens = F.split(F.lit(",".join(by_id.get(i, unknown) for i in range(max(by_id, default=-1) + 1))), ",")
    of = lambda i: F.coalesce(F.get(tokens, i), F.lit(unknown))
    ids, whole = F.col(f"`{ids_col}`"), F.unhex(F.array_join(F.transform(f"`{ids_col}`", of), ""))
    wrong = F.raise_error(F.lit("an id is not in the vocabulary")).cast("binary")
    return encoded.withColumn(out_col, F.when(ids.isNotNull(), F.coalesce(whole, wrong)))
