"""Token counts of the sections of texts.

A whole text is encoded once. Its tokens' byte spans are mapped to character spans, and these are joined with
the sections' character intervals. A token that crosses a boundary goes to one section by an explicit rule:
the one that holds its first character (``start``), its last one (``end``), or most of it (``most``, the
earlier of equal ones). So the counts of a text's sections add up to its own count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "most")
#: Rows of the result that go out together.
LOT = 50_000


def character_spans(text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character that each token has a byte of; ``sizes``: bytes of the tokens."""
    head = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    at = np.cumsum(head) - 1
    stop = np.cumsum(sizes)
    return at[stop - sizes], at[stop - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; section k is from ``edges[k]`` to before ``edges[k + 1]``."""
    first = np.searchsorted(edges, start, side="right") - 1
    last = np.searchsorted(edges, end - 1, side="right") - 1
    if rule == "start":
        return first
    if rule == "end":
        return last
    chosen = first.copy()
    for t in np.flatnonzero(first != last):  # only tokens that cross a boundary
        parts = range(first[t], last[t] + 1)
        chosen[t] = max(parts, key=lambda k: (min(end[t], edges[k + 1]) - max(start[t], edges[k]), -k))
    return chosen


def section_edges(text: str, mark: str = "\n") -> np.ndarray:
    """Starts of the sections and the text's end; a section runs up to and including ``mark``."""
    cuts, at = [0], text.find(mark)
    while at >= 0:
        cuts.append(at + len(mark))
        at = text.find(mark, at + len(mark))
    return np.array([*cuts, max(len(text), cuts[-1])], dtype=np.int64)


def count_sections(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, rule: str = "start", mark: str = "\n",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per text and section: ``id_col``, ``section`` from 0, ``n_chars`` and ``n_tokens``.

    A text that ends with ``mark`` has an empty last section; a null or empty text has one empty section
    without tokens. Ids, null or repeated, are passed on row by row; other columns are not read. Rows need
    no shuffle, each text is worked on where it is read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        size_of = np.zeros(max(sent.value.values(), default=0) + 1, dtype=np.int64)
        for token, rank in sent.value.items():
            size_of[rank] = len(token)
        for batch in batches:
            keys, rows, waiting = [], [], 0

            def out() -> pa.RecordBatch:
                sizes = [len(n) for n, _ in rows]
                number = np.concatenate([np.arange(s) for s in sizes])
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                        pa.array(number, pa.int64()),
                        pa.array(np.concatenate([n for n, _ in rows]), pa.int64()),
                        pa.array(np.concatenate([t for _, t in rows]), pa.int64()),
                    ],
                    names=["id", "section", "n_chars", "n_tokens"],
                )

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                edges = section_edges(text, mark)
                ids = np.array(library.encode_ordinary(text), dtype=np.int64)
                tokens = np.zeros(len(edges) - 1, dtype=np.int64)
                if len(ids):
                    start, end = character_spans(text.encode(), size_of[ids])
                    tokens = np.bincount(attribute(start, end, edges, rule), minlength=len(edges) - 1)
                keys.append(key)
                rows.append((np.diff(edges), tokens))
                waiting += len(tokens)
                if waiting >= LOT:
                    yield out()
                    keys, rows, waiting = [], [], 0
            if rows:
                yield out()

    done = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        count, "id string, section bigint, n_chars bigint, n_tokens bigint"
    )
    return done.select(F.col("id").cast(kind).alias(id_col), "section", "n_chars", "n_tokens")
