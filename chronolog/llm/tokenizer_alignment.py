"""Alignment of two tokenizers over the same texts: where their tokens end together, and which ids meet.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece model that sets a blank before
each text. Both read a blank and the text. The spans that the libraries report are coarse cuts: characters for
A, places in the text for B. Tokens that hold a part of a character or have no span of their own, as those of
byte fallback, are cut by the lengths of their decoded bytes.

A text is worked on in chunks that both tokenizers provably cut: a chunk begins at a blank after a character that
is no white space, and no piece of B holds a blank behind another character. A worker remembers the chunks
that it has aligned.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolog.llm import spans
from chronolog.llm.shared import small, written

#: A worker remembers so many aligned chunks; beyond, it forgets them and may align a chunk again.
REMEMBERED = 900_000
#: The tokenizers read chunks in runs of so many characters or little more.
RUN = 1000
BLANK = "▁"
CHUNK = re.compile(rf" +[^ ]*(?:(?<=[\s{BLANK}]) +[^ ]*| +\Z)*")
NAMES = ["n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
SCHEMA = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def byte_of_char() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for.

    Printable bytes stand for themselves, the others in order for the characters from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Two opened tokenizers and the bytes of their tokens."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        stands = byte_of_char()
        added = {t["content"] for t in json.loads(a_json).get("added_tokens", [])}
        self.a_bytes = {i: b"" if t in added else bytes(stands[c] for c in t) for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self._tables: tuple[np.ndarray, np.ndarray, list[str]] | None = None
        self.chunked = not any(BLANK in p.lstrip(BLANK) for p in pieces)

    def chunks(self, text: str) -> list[str]:
        """The text with a blank before it, in parts that are tokenized on their own."""
        return CHUNK.findall(" " + text) if self.chunked else [" " + text]

    def tables(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Byte lengths of both vocabularies' tokens, and their ids as text with what may follow: ``,`` ``|`` ``;``."""
        if self._tables is None:
            size = max(self.a_bytes, default=-1) + 1
            of_a = np.array([len(self.a_bytes.get(i, b"")) for i in range(size)], np.int64)
            of_b = np.array([len(x) for x in self.b_bytes], np.int64)
            shown = [f"{i}{sign}" for n, last in ((size, "|"), (len(of_b), ";")) for sign in (",", last) for i in range(n)]
            self._tables = of_a, of_b, shown
        return self._tables


class Tokens:
    """The tokens of many chunks on one side: ids, the chunk of each, and the byte of all chunks' bytes that each ends at."""

    def __init__(self, ids: np.ndarray, count: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> None:
        self.ids, self.count = ids, count
        owner = np.repeat(np.arange(len(count)), count)
        last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
        own = (starts < ends) & (last | (np.append(starts[1:], 0)[: len(starts)] >= ends))
        # of no own span: as far as the decoded bytes go
        lengths = sizes[self.ids]
        through = np.concatenate(([0], np.cumsum(lengths)))
        begin = np.cumsum(self.count) - self.count
        decoded = through[1:] - np.repeat(through[begin], self.count) + np.repeat(first[:-1], self.count)
        self.ends = np.where(own, ends, decoded)


def rebuilt(ids: np.ndarray, count: np.ndarray, sizes: np.ndarray, tokens: dict[int, bytes] | list[bytes], first: np.ndarray, data: list[bytes]) -> bool:
    """Whether the bytes of the tokens are those of the chunks, each run's its own; ``count`` and ``first`` go by run."""
    through = np.concatenate(([0], np.cumsum(sizes[ids])))
    ends = through[np.cumsum(count)]
    return np.array_equal(ends, first[1:]) and b"".join([tokens[i] for i in ids.tolist()]) == b"".join(data)


def runs(chunks: list[str]) -> np.ndarray:
    """Where runs of chunks begin that may be tokenized as one text, and the number of chunks.

    A chunk that ends in white space or the blank's sign ends its run, as no chunk may begin behind it.
    """
    begin, size = [], RUN
    for k, chunk in enumerate(chunks):
        if size >= RUN:
            begin.append(k)
            size = 0
        size = RUN if chunk[-1].isspace() or chunk[-1] == BLANK else size + len(chunk)
    return np.array([*begin, len(chunks)], np.int64)


def cut(ids: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, bool]:
    """The number of tokens of each chunk, by the bytes of the tokens, and whether every chunk ends with a token."""
    through = np.concatenate(([0], np.cumsum(sizes[ids])))
    at = np.searchsorted(through, first)
    return np.diff(at), np.array_equal(through[np.minimum(at, len(ids))], first) and through[-1] == first[-1]


def aligned(pair: Pair, chunks: list[str], single: bool = False) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of each chunk: whether its bytes are not those of the tokens, the numbers of tokens of A and B and of groups, the
    groups as text with a ``;`` after each, and the number of linked ids; then all linked ids as ``a << 32 | b``.

    The tokenizers read runs of chunks, which they cut where the chunks begin; with ``single`` each chunk is read alone.
    """
    if not chunks:
        return np.zeros(0, bool), np.zeros((0, 3), np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    single = single or not pair.chunked
    begin = np.arange(len(chunks) + 1) if single else runs(chunks)
    read = chunks if single else ["".join(chunks[x:y]) for x, y in zip(begin.tolist(), begin[1:].tolist())]
    of_a = pair.a.encode_batch(read, add_special_tokens=False)
    of_b = pair.b.encode([c[1:] for c in read], return_type="proto", num_threads=1)
    ids_a = [x.ids for x in of_a]
    flat, run_b = [], []
    for x in of_b:
        found = x.pieces
        run_b.append(len(found))
        flat += [v for p in found for v in (p.id, p.begin, p.end)]
    pieces = np.array(flat, np.int64).reshape(-1, 3)
    data = [c.encode() for c in chunks]
    sizes_a, sizes_b, shown = pair.tables()
    first = np.cumsum([0, *map(len, data)])
    run_a, run_b = np.fromiter(map(len, ids_a), np.int64, len(ids_a)), np.array(run_b, np.int64)
    flat_a = np.fromiter(chain.from_iterable(ids_a), np.int64, int(run_a.sum()))
    sides = ((flat_a, run_a, sizes_a, pair.a_bytes), (pieces[:, 0], run_b, sizes_b, pair.b_bytes))
    (many_a, whole_a), (many_b, whole_b) = ((run, True) if single else cut(ids, sizes, first) for ids, run, sizes, _ in sides)
    whole = whole_a and whole_b
    if not (whole and all(rebuilt(ids, run, sizes, tokens, first[begin], data) for ids, run, sizes, tokens in sides)):
        wrong = np.zeros(len(chunks), bool)
        cuts = [np.cumsum(np.append(0, run)).tolist() for _, run, _, _ in sides]
        doubted = []
        for k, (x, y) in enumerate(zip(begin.tolist(), begin[1:].tolist())):
            d = b"".join(data[x:y])
            parts = [b"".join([tokens[i] for i in ids[c[k] : c[k + 1]].tolist()]) for (ids, _, _, tokens), c in zip(sides, cuts)]
            if any(part != d for part in parts):
                doubted += range(x, y)
        if single:
            wrong[doubted] = True
        elif doubted:
            wrong[doubted] = aligned(pair, [chunks[k] for k in doubted], single=True)[0]
        right = np.flatnonzero(~wrong).tolist()
        _, counts, texts, links, pairs = aligned(pair, [chunks[k] for k in right], single=single or not wrong.any())
        every, told, many = np.zeros((len(chunks), 3), np.int64), [""] * len(chunks), np.zeros(len(chunks), np.int64)
        every[right], many[right] = counts, links
        for k, text in zip(right, texts):
            told[k] = text
        return wrong, every, told, many, pairs
    # A's spans count characters, B's bytes after the blank
    code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))))
    char = np.cumsum([0, *map(len, read)])[:-1]
    spans_a = np.fromiter(chain.from_iterable(chain.from_iterable(x.offsets for x in of_a)), np.int64, 2 * len(flat_a)).reshape(-1, 2)
    spans_a = at[spans_a + np.repeat(char, run_a)[:, None]]
    spans_b = pieces[:, 1:] + (np.repeat(first[begin[:-1]], run_b) + 1)[:, None]
    a = Tokens(flat_a, many_a, spans_a[:, 0], spans_a[:, 1], sizes_a, first)
    b = Tokens(pieces[:, 0], many_b, spans_b[:, 0], spans_b[:, 1], sizes_b, first)
    common = np.intersect1d(a.ends, b.ends)
    pairs = linked(a, b, common)
    groups = np.diff(np.searchsorted(common, first, side="right"))
    # tokens by group, A's before B's; the last of a side in its group has another sign behind it
    group = np.concatenate((np.searchsorted(common, a.ends), np.searchsorted(common, b.ends)))
    side = np.repeat([0, 1], [len(a.ids), len(b.ids)])
    order = np.lexsort((side, group))
    key = (2 * group + side)[order]
    ends_side = np.append(key[1:] != key[:-1], True)[: len(key)]
    base = np.array([0, 2 * len(sizes_a)])[side] + np.concatenate((a.ids, b.ids))
    token = base[order] + ends_side * np.array([len(sizes_a), len(sizes_b)])[side[order]]
    parts = list(map(shown.__getitem__, token.tolist()))
    edges = np.cumsum([0, *(a.count + b.count).tolist()]).tolist()
    texts = ["".join(parts[x:y]) for x, y in zip(edges, edges[1:])]
    return np.zeros(len(chunks), bool), np.stack((a.count, b.count, groups), axis=1), texts, groups, pairs


def linked(a: Tokens, b: Tokens, common: np.ndarray) -> np.ndarray:
    """The ids of the tokens that end at the common ends. No token is empty, so that each side has one there."""
    return a.ids[np.searchsorted(a.ends, common)] << 32 | b.ids[np.searchsorted(b.ends, common)]


def put(array: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``array`` with ``more`` from place ``n`` on, in a new array half as large again if it has no room."""
    if n + len(more) > len(array):
        room = np.zeros((n + len(more) + n // 2, *array.shape[1:]), array.dtype)
        room[:n] = array[:n]
        array = room
    array[n : n + len(more)] = more
    return array


class Memory:
    """Aligned chunks by number: counts and texts, and all their pairs in one array. The arrays have room behind."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts = np.zeros((0, 3), np.int64)
        self.wrong = np.zeros(0, bool)
        self.pairs = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.number]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            wrong, counts, texts, links, pairs = aligned(self.pair, part)
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part))))
            n, linked = len(self.texts), int(self.first[len(self.texts)])
            self.texts += texts
            self.wrong = put(self.wrong, n, wrong)
            self.counts = put(self.counts, n, counts)
            self.pairs = put(self.pairs, linked, pairs)
            self.first = put(self.first, n + 1, linked + np.cumsum(links))

    def text(self, chunks: list[str]) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """Counts, hash of the groups, and distinct pairs with their numbers of a text cut into chunks."""
        codes = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        if not chunks or self.wrong[codes].any():
            return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        n_a, n_b, n_groups = self.counts[codes].sum(axis=0).tolist()
        hashed = hashlib.sha256("".join(map(self.texts.__getitem__, codes.tolist()))[:-1].encode()).hexdigest()
        start, size = self.first[codes], self.first[codes + 1] - self.first[codes]
        at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
        return n_a, n_b, n_groups, hashed, *np.unique(self.pairs[at], return_counts=True)


#: The memory of this worker for the running query; a worker is used for many tasks.
_memories: dict[str, Memory] = {}


def coded(docs: DataFrame, a_json: str, b_model: bytes) -> DataFrame:
    """``docs(id, row, text)`` as ``(id, row, n_a, n_b, n_groups, groups_sha256, pairs, times)``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((a_json, b_model))
    key = uuid.uuid4().hex
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _memories:
            _memories.clear()
            _memories[key] = Memory(Pair(*sent.value))
        memory = _memories[key]
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                texts = [t or "" for t in part.column(2).to_pylist()]
                for x, y in spans.lots(texts):
                    cuts = [memory.pair.chunks(t) if t else [] for t in texts[x:y]]
                    if len(memory.number) > REMEMBERED:
                        memory.forget()
                    memory.learn(set().union(*cuts))
                    found = list(zip(*map(memory.text, cuts)))
                    arrays = [part.column(0).slice(x, y - x), part.column(1).slice(x, y - x)]
                    arrays += [pa.array(f, pa.int64()) for f in found[:3]] + [pa.array(found[3], pa.string())]
                    for lists, number in zip(found[4:], (np.int64, np.int32)):
                        ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                        arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists).astype(number))))
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "row", *NAMES])

    return docs.select("id", "row", "text").mapInArrow(work, f"id {kind}, row bigint, {SCHEMA}")


def align(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``a_json`` is the tokenizers file of A as text, ``b_model`` the sentencepiece model of B. Groups lie between
    bytes where tokens of both end; a link is a token of A and one of B that end together, its count the number of such
    links of their ids in the corpus, and it is best when no other id of A meets the id of B more often. Texts that are
    null, empty or not rebuilt by either side's bytes have zeros and an empty hash. Repeated rows count each, null
    ids stay; other columns are not read; an empty table gives an empty one.

    Each text is tokenized once; its distinct pairs are written with it and read twice, to count them over the corpus
    and to sum the counts by text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    texts = written(coded(rows, a_json, b_model))
    links = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    counts = written(links.groupBy("pairs").agg(F.sum("times").alias("n")))
    of_b = counts.withColumn("b", F.col("pairs").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = of_b.groupBy("b").agg(F.max("n").alias("most"))
    rated = written(of_b.join(most, "b").select("pairs", "n", (F.col("n") == F.col("most")).alias("best")))
    sums = links.join(small(rated), "pairs").groupBy("row").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    done = texts.drop("pairs", "times").join(sums, "row", "left")
    return done.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", *map(zero, ("n_links", "n_best", "count_sum")), "groups_sha256")
