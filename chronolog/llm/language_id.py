"""Language identification: a Viterbi path over the words of mixed-language text.

Words are runs of letters. A word's script, by ranges of code points, narrows the languages it may be in to
those that the training texts show to be written in it. Each character scores every language by its trigram,
whose counts per language come from all training texts; a word's scores are the sums. The Viterbi path through
a text's words, with a penalty for every change of language, labels spans; the language of most letters
is the text's, and its part of the letters the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.llm import spans

#: Trigrams are counted in this many slots, by hash.
SLOTS = 1 << 15
#: What a change of language costs, in natural log units.
SWITCH = 12.0
#: A language is written in a script that has at least this part of its letters.
SCRIPT_SHARE = 0.02
#: Texts are labelled in lots of about so many code points.
LOT = 1 << 21
UNKNOWN = "und"

#: First code points of the ranges of scripts, fixed values; 0 stands for any other script.
RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x3040, "Kana"), (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "other"), (0xFF21, "Latin"), (0xFF5B, "other"), (0xFF66, "Kana"),
    (0xFFA0, "other"), (0x20000, "Han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in RANGES})

_lower: np.ndarray | None = None


def lower_case() -> np.ndarray:
    """The lower-case form of every code point that has a single one."""
    global _lower
    if _lower is None:
        pairs = [(c, chr(c).lower()) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        table = np.arange(0x110000, dtype=np.uint32)
        for c, low in pairs:
            if len(low) == 1 and ord(low) != c:
                table[c] = ord(low)
        _lower = table
    return _lower


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of the texts: starts, ends, text number, trigram slots of each place, script of each word."""
    chars, after = spans.code_points(texts)
    kind = spans.kinds()[chars] == spans.LETTER
    kind[after] = False
    edge = np.diff(np.concatenate(([0], kind.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    low = np.where(kind, lower_case()[chars], 0).astype(np.uint64)
    left, right = np.concatenate(([0], low[:-1])).astype(np.uint64), np.concatenate((low[1:], [0])).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (left * np.uint64(0x1F123BB5) + low) * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    slot = (mixed >> np.uint64(40)).astype(np.int64) % SLOTS
    number = {name: k for k, name in enumerate(SCRIPTS)}
    of_range = np.array([number[name] for _, name in RANGES])
    script = of_range[np.searchsorted([a for a, _ in RANGES], chars[start], side="right") - 1]
    return start, end, np.searchsorted(after, start), slot, script


class Model:
    """Log probabilities by trigram slot and language, and the languages of each script."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        """``counts``: languages by slots; ``scripts``: languages by letters in each of ``SCRIPTS``."""
        self.languages = languages
        self.logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * SLOTS)).T.astype(np.float32)
        self.allowed = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
        self.allowed[~self.allowed.any(axis=1)] = True

    def label(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Start, end and text of each word, and its language's number on the best path."""
        start, end, owner, slot, script = letters(texts)
        if not len(start):
            return start, end, owner, np.zeros(0, dtype=np.int64)
        n = len(self.languages)
        size = end - start
        first = np.cumsum(size) - size
        place = np.repeat(start - first, size) + np.arange(int(size.sum()))
        score = np.add.reduceat(self.logs[slot[place]], first, axis=0)
        score[~self.allowed[script]] -= 1e6
        # all texts step through their words together, the longest texts first
        words = np.bincount(owner, minlength=len(texts))
        order = np.argsort(-words, kind="stable")
        begin = (np.cumsum(words) - words)[order]
        words = words[order]
        live = np.searchsorted(-words, -np.arange(words[0] + 1), side="left")  # texts with more than t words
        back = np.zeros((len(start), n), dtype=np.int16)
        best = score[begin[: live[0]]].copy()
        ends = np.zeros((len(texts), n), dtype=np.float32)
        for t in range(1, words[0]):
            m = live[t]
            ends[m : len(best)] = best[m:]
            best = best[:m]
            top = best.argmax(axis=1)
            jump = best[np.arange(m), top] - SWITCH
            at = begin[:m] + t
            stay = best >= jump[:, None]
            back[at] = np.where(stay, np.arange(n), top[:, None])
            best = np.where(stay, best, jump[:, None]) + score[at]
        ends[: len(best)] = best
        label = np.zeros(len(start), dtype=np.int64)
        now = ends.argmax(axis=1)
        for t in range(words[0] - 1, -1, -1):
            m = live[t]
            at = begin[:m] + t
            label[at] = now[:m]
            now[:m] = back[at, now[:m]]
        return start, end, owner, label


def train(docs: DataFrame, learn: Column) -> Model:
    """A model from all texts with a language where ``learn`` holds; null languages and texts teach nothing.

    Tasks count trigrams and letters by language and send sums only. The driver gets one number per
    language and slot used, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in spans.lots(texts, LOT):
                start, end, owner, slot, script = letters(texts[a:b])
                names, of = np.unique(np.array(langs[a:b], dtype=object).astype(str), return_inverse=True)
                size = end - start
                place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                by_word = of[owner] * (SLOTS + len(SCRIPTS))
                width = len(names) * (SLOTS + len(SCRIPTS))
                sums = np.bincount(np.repeat(by_word, size) + slot[place], minlength=width)
                sums += np.bincount(by_word + SLOTS + script, size, minlength=width).astype(np.int64)
                for name, row in zip(names.tolist(), sums.reshape(len(names), -1)):
                    found[name] = found[name] + row if name in found else row
        for name, row in found.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(row[used], pa.int64())], names=["lang", "slot", "n"]
            )

    taught = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = taught.mapInArrow(count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = sums.collect()
    languages = sorted({r["lang"] for r in rows})
    table = np.zeros((len(languages), SLOTS + len(SCRIPTS)))
    number = {name: k for k, name in enumerate(languages)}
    for r in rows:
        table[number[r["lang"]], r["slot"]] = r["n"]
    return Model(languages, table[:, :SLOTS], table[:, SLOTS:])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``lang_pred``, ``score`` and ``spans``, runs of words of one language.

    Spans have ``start`` and ``end`` in code points and ``lang``. A text that is null or has no letter is
    ``und`` with score 0 and no spans, as is every text if the model knows no language. Of languages with
    equally many letters the first by name counts. Ids are passed on; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType
    run = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            if not model.languages:
                none = [UNKNOWN] * len(ids), [0.0] * len(ids), [[]] * len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(none[0]), pa.array(none[1]), pa.array(none[2], pa.list_(run))], names=["id", "lang_pred", "score", "spans"]
                )
                continue
            for a, b in spans.lots(texts, LOT):
                start, end, owner, label = model.label(texts[a:b])
                n = len(model.languages)
                mass = np.bincount(owner * n + label, end - start, minlength=(b - a) * n).reshape(-1, n)
                top, total = mass.argmax(axis=1), mass.sum(axis=1)
                names = [model.languages[k] if s else UNKNOWN for k, s in zip(top.tolist(), total.tolist())]
                part = mass.max(axis=1) / np.maximum(total, 1)
                offset = np.cumsum([0, *[len(t) + 1 for t in texts[a:b]]])
                new = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(label, prepend=-1)) if len(owner) else np.zeros(0, np.int64)
                last = np.append(new[1:], len(owner)) - 1
                runs: list[list[tuple]] = [[] for _ in range(a, b)]
                for x, y in zip(new.tolist(), last.tolist()) if len(owner) else ():
                    o = int(owner[x])
                    runs[o].append((int(start[x] - offset[o]), int(end[y] - offset[o]), model.languages[label[x]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a:b], pa.string()),
                        pa.array(names, pa.string()),
                        pa.array(part, pa.float64()),
                        pa.array(runs, pa.list_(run)),
                    ],
                    names=["id", "lang_pred", "score", "spans"],
                )

    schema = "id string, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    done = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
    return done.select(F.col("id").cast(kind).alias(id_col), "lang_pred", "score", "spans")
