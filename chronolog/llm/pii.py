"""Personal data: patterns find protected values, co-occurrence in the corpus finds the terms that reveal them.

Protected values are mail addresses, network addresses, card and phone numbers. A term near a value (``NEAR`` words on
either side) may disclose it: its pointwise mutual information with the value, in bits over the corpus's
different texts, is compared with the information that the value itself holds, ``-log2 p(value)``. The quotient
is 1 for a term that occurs beside the value only, and 0 for one that has nothing to do with it. Terms whose
quotient reaches ``GENERALISED`` give way to the class of their characters, from ``REMOVED`` on they go,
wherever in the corpus they stand.

One occurrence tells nothing: a value and a term have to meet in ``SUPPORT`` different texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.llm.shared import BROADCAST_ROWS, small, written

KINDS = ("email", "ip", "card", "phone")
#: The kinds of spans that the method adds.
ADDED = ("generalised", "removed")
#: Words on either side of a value that count as near it.
NEAR = 8
#: Different texts in which a term has to stand near a value.
SUPPORT = 3
#: Part of a value's information that a term may tell before it is generalised, and before it is removed.
GENERALISED, REMOVED = 0.8, 0.95

#: The base patterns, each from a place where a leftmost match can begin. Fixed values.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{3,}")
DIGITS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        found = AT.match(text, at) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def values(text: str) -> list[tuple[int, int, int, str]]:
    """Protected values of a text: the number of the kind, start, end, and the value by which it is counted.

    Per kind the leftmost matches that don't overlap; addresses with a part beyond 255, cards of a wrong length
    or check digit and phones of under 8 or over 15 digits are dropped. Every pattern is linear in the text.
    """
    found = [(0, a, b, text[a:b].lower()) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in parts):
            found.append((1, m.start(), m.end(), m[0]))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].translate(DIGITS)
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = m[0].translate(DIGITS)
            if 8 <= len(digits) <= 15:
                found.append((3, m.start(), m.end(), digits))
    return found


def near(text: str, found: list[tuple[int, int, int, str]]) -> set[tuple[str, str]]:
    """Values, with their kind, and the terms near them that are no part of a value."""
    if not found:
        return set()
    covered = sorted((a, b) for _, a, b, _ in found)
    words, k = [], 0
    reach = 0  # the furthest end of a value that began before the word
    for m in TERM.finditer(text):
        while k < len(covered) and covered[k][0] < m.end():
            reach = max(reach, covered[k][1])
            k += 1
        if reach <= m.start():
            words.append((m.start(), m[0].lower()))
    met, starts = set(), [s for s, _ in words]
    for kind, a, _, value in found:
        at = bisect_left(starts, a)
        met.update((f"{KINDS[kind]}:{value}", w) for _, w in words[max(0, at - NEAR) : at + NEAR])
    return met


def _found(texts: DataFrame) -> DataFrame:
    """``texts(id, hash, text)`` as ``(id, hash, spans, met)``."""
    kind = texts.schema["id"].dataType.simpleString()
    span, pair = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]), pa.struct([("value", pa.string()), ("term", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                spans, met = [], []
                for text in part.column(2).to_pylist():
                    found = values(text or "")
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in found])
                    met.append([{"value": v, "term": t} for v, t in sorted(near(text or "", found))])
                arrays = [part.column(0), part.column(1), pa.array(spans, pa.list_(span)), pa.array(met, pa.list_(pair))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "hash", "spans", "met"])

    shape = "spans array<struct<kind:int,start:bigint,end:bigint>>, met array<struct<value:string,term:string>>"
    return texts.mapInArrow(work, f"id {kind}, hash bigint, {shape}")


def _occurrences(texts: DataFrame, terms: DataFrame, places: bool) -> DataFrame:
    """Where the ``terms(term, ...)`` stand in ``texts(id, hash, text)``.

    ``(hash, term)``, once for each row and term, or with ``places`` ``(id, hash, term, start, end)`` for each place,
    with the terms' other columns. Up to a counted number of terms, workers hold them and give rows of them alone; beyond, all
    words are joined with the terms by a shuffle.
    """
    kind = texts.schema["id"].dataType.simpleString()
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = texts.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in terms.select("term").collect()) if few else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                rows: list[tuple[int, str, int, int]] = []
                for k, text in enumerate(part.column(2).to_pylist()):
                    if not text:
                        continue
                    if places:
                        words = ((m[0].lower(), m.start(), m.end()) for m in TERM.finditer(text))
                        rows.extend((k, *w) for w in words if wanted is None or w[0] in wanted)
                    else:
                        words = set(TERM.findall(text.lower())) if text.isascii() else {w.lower() for w in TERM.findall(text)}
                        rows.extend((k, w, 0, 0) for w in (words if wanted is None else words & wanted))
                at = pa.array([r[0] for r in rows], pa.int64())
                arrays = [part.column(0).take(at), part.column(1).take(at), pa.array([r[1] for r in rows], pa.string())]
                arrays += [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "hash", "term", "start", "end"])

    rows = texts.mapInArrow(work, f"id {kind}, hash bigint, term string, start bigint, end bigint")
    if few and not places:
        return rows.select("hash", "term")
    joined = rows.join(F.broadcast(terms) if few else terms, "term")
    return joined if places else joined.select("hash", "term")


def disclosing(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Terms that disclose a value too well: ``(term, told, kind)``, ``told`` the largest part of a value's information.

    ``found(hash, met)`` holds the values and the terms near them by text; texts that repeat count once, and a value
    counts in the texts in which a term stands near it.
    """
    met = found.where(F.size("met") > 0).select("hash", F.explode("met").alias("m")).select("hash", "m.value", "m.term")
    met = written(met.distinct())
    together = met.groupBy("value", "term").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT)
    valued = met.select("hash", "value").distinct().groupBy("value").agg(F.count("*").alias("n_value")).where(F.col("n_value") >= SUPPORT)
    total = max(1, texts.select("hash").distinct().count())
    information = -F.log2(F.col("n_value") / F.lit(float(total)))
    told = lambda n: F.log2(F.col("both") * F.lit(float(total)) / (F.col("n_value") * F.col(n))) / information
    # a term stands in as many texts at least as it is near any value in: most common words end here
    least = met.select("hash", "term").distinct().groupBy("term").agg(F.count("*").alias("least"))
    candidates = together.join(valued.where(F.col("n_value") < total), "value").join(least, "term")
    candidates = written(candidates.where(told("least") >= GENERALISED))
    terms = written(candidates.select("term").distinct())
    stands = _occurrences(texts, terms, places=False).distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    strongest = candidates.join(stands, "term").groupBy("term").agg(F.max(told("n_term")).alias("told"))
    kind = F.when(F.col("told") >= REMOVED, F.lit(ADDED[1])).otherwise(F.lit(ADDED[0]))
    return written(strongest.where(F.col("told") >= GENERALISED).select("term", "told", kind.alias("kind")))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``id_col`` and ``spans``, an array of ``(kind, start, end)``: code points, the end exclusive.

    Base kinds come in the order of ``KINDS``, then generalised and removed terms, each kind by its starts; terms that
    overlap a base span are left out. A null or empty text has none. Rows that repeat id and text have the same
    spans, null ids stay; other columns are not read; an empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    found = written(_found(texts))
    terms = disclosing(found, texts)
    spot = F.struct((F.lit(len(KINDS)) + (F.col("kind") == ADDED[1]).cast("int")).alias("kind"), "start", "end")
    places = _occurrences(texts, terms.select("term", "kind"), places=True)
    added = written(places.groupBy("id", "hash").agg(F.collect_set(spot).alias("added")))
    added = added.select(F.col("id").alias("of"), F.col("hash").alias("of_hash"), "added")
    joined = found.drop("met").join(small(added), (F.col("hash") == F.col("of_hash")) & F.col("id").eqNullSafe(F.col("of")), "left")
    apart = F.filter(F.col("added"), lambda t: ~F.exists(F.col("spans"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    every = F.sort_array(F.concat("spans", F.coalesce(apart, F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))
    names = F.array(*map(F.lit, (*KINDS, *ADDED)))
    named = F.transform(every, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(F.col("id").alias(id_col), F.col("hash").alias("_text_hash"), named.alias("spans"))


def sanitised(text: str | None, spans: list | None) -> str | None:
    """The text with values replaced by their kind, generalised terms by the class of their characters, removed ones gone."""
    if not text or not spans:
        return text
    parts, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < last:
            last = max(last, end)
            continue
        word = text[start:end]
        if kind == ADDED[0]:
            shown = "[number]" if word.isdigit() else "[name]" if word[0].isupper() else "[word]" if word.isalpha() else "[code]"
        else:
            shown = "" if kind == ADDED[1] else f"[{kind}]"
        parts += [text[last:start], shown]
        last = end
    return "".join([*parts, text[last:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``text_col`` sanitised by what ``detect`` finds; all other columns stay."""
    names = docs.columns
    found = detect(docs, id_col, text_col).where(F.size("spans") > 0)
    found = found.select(F.col(id_col).alias("_pii_id"), F.col("_text_hash").alias("_pii_hash"), F.col("spans").alias("_pii_spans"))
    found = written(found).dropDuplicates(["_pii_id", "_pii_hash"])
    joined = docs.join(found, (_text_hash(F.col(text_col)) == F.col("_pii_hash")) & F.col(id_col).eqNullSafe(F.col("_pii_id")), "left")
    replaced = F.udf(sanitised, "string", useArrow=True)(F.col(text_col), F.col("_pii_spans"))
    text = F.when(F.col("_pii_spans").isNull(), F.col(text_col)).otherwise(replaced)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in names])
