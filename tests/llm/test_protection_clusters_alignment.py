"""Personal data, centroid clustering and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronolog.llm import centroids, pii, tokenizer_alignment
from chronolog.llm.queries import QUERIES
from chronolog.llm.reference_sql import SQL

DOCS = "doc_id bigint, text string"
FOLDER = "/root/testdata/sf0.001"


def odd(df):
    """Extra columns under names that operators use themselves."""
    for name in ("row", "id", "hash", "spans", "met", "term", "kind", "pairs", "times", "n", "whole", "cluster", "_pii_x"):
        df = df.withColumn(name, F.lit("x"))
    return df


# 11 ------------------------------------------------------------------------------------------------

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    """The contract's patterns as they stand."""
    found = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def test_values_are_those_of_the_patterns():
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", ".", "x@y.zz", "-", " ", "+", "1", "12", "4111111111111111", "5500 0000 0000 0004", "255", "256", "1.2.3.4", "é", "(", ")", "+1 (743) 555-3824", "%", "\n", "٣", "0007"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert [(pii.KINDS[k], a, b) for k, a, b, _ in pii.values(text)] == plain(text), text


def test_values_of_very_long_texts():
    for text in ("a" * 300_000 + "@", "1" * 200_000, "+1" + "(" * 300_000, "1.1." * 100_000, "@a." * 100_000, "4 -" * 100_000):
        pii.values(text)
    assert [k for k, *_ in pii.values("x" * 200_000 + "@y.z")] == [0]


def disclosed(rows):
    """The terms that disclose a value, by brute force over the different texts."""
    texts = {t or "" for _, t in rows}
    met, stands, held = defaultdict(set), defaultdict(set), defaultdict(set)
    for text in texts:
        spans = plain(text)
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]{3,}", text)]
        for _, _, w in words:
            stands[w].add(text)
        free = [w for w in words if not any(a < w[1] and w[0] < b for _, a, b in spans)]
        for kind, a, b in spans:
            value = text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            before, after = [w for w in free if w[0] < a], [w for w in free if w[0] >= a]
            held[kind, value].update({text} if free else ())
            for w in before[-pii.NEAR :] + after[: pii.NEAR]:
                met[kind, value, w[2]].add(text)
    told = {}
    for (kind, value, term), both in met.items():
        n = len(held[kind, value])
        if len(both) >= pii.SUPPORT and n >= pii.SUPPORT and n < len(texts):
            share = math.log2(len(both) * len(texts) / (n * len(stands[term]))) / -math.log2(n / len(texts))
            told[term] = max(told.get(term, -9), share)
    return {t: "removed" if s >= pii.REMOVED else "generalised" for t, s in told.items() if s >= pii.GENERALISED}


def private_rows():
    rng = random.Random(12)
    say = lambda n: " ".join(f"word{int(rng.random() ** 2 * 60)}" for _ in range(n))
    rows = [(k, say(rng.randint(1, 40))) for k in range(60)]
    for k in range(60, 66):  # a rare name stands beside one address, a common word beside it as well
        rows.append((k, f"{say(12)} Zebulon word3 zeb@mail.example.com {say(15)}"))
    rows.append((66, f"{say(5)} call Quagmire {say(3)} 152.143.123.131"))
    rows += [(67, "zebulon alone, far from the address"), (68, "word1 152.143.123.131 Loner"), (69, None), (70, ""), (None, "Zebulon zeb@mail.example.com")]
    rows += [rows[60]] * 5 + [(90 + k, rows[61][1]) for k in range(9)]
    return rows


def test_terms_that_disclose(spark):
    rows = private_rows()
    df = odd(spark.createDataFrame(rows, DOCS))
    found = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pii.detect(df).collect()]
    terms = disclosed(rows)
    assert terms["zebulon"] in pii.ADDED and "word3" not in terms and "quagmire" not in terms
    expected = []
    for k, text in rows:
        base = plain(text or "")
        added = [(terms[m[0].lower()], m.start(), m.end()) for m in re.finditer(r"[^\W_]{3,}", text or "") if m[0].lower() in terms]
        added = [t for t in added if not any(a < t[2] and t[1] < b for _, a, b in base)]
        expected.append((k, base + sorted(added)))
    assert sorted(map(str, found)) == sorted(map(str, expected))
    assert pii.detect(df.limit(0)).count() == 0


def test_many_terms_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(private_rows(), DOCS)
    few = sorted(map(str, pii.detect(df).collect()))
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert sorted(map(str, pii.detect(df).collect())) == few


def test_sanitised_texts(spark):
    spans = [("email", 4, 9), ("card", 20, 40), ("phone", 25, 50), ("generalised", 0, 3), ("removed", 10, 13)]
    assert pii.sanitised("Bob a@b.c zip", spans[:1] + spans[3:]) == "[name] [email] "
    assert pii.sanitised("x" * 60, spans[1:3]) == "x" * 20 + "[card]" + "x" * 10
    rows = private_rows()
    df = odd(spark.createDataFrame(rows, DOCS))
    done = pii.sanitise(df)
    assert done.columns == df.columns and done.count() == len(rows)
    texts = [r["text"] for r in done.collect()]
    assert not any(re.search("(?i)zebulon|@", t or "") for t in texts) and None in texts and "" in texts


def test_pii_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op11_pii"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        base = plain(d["text"] or "")
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = rows[d["doc_id"]]
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(x[0] == k for x in base) for k in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest() and r["spans"].startswith(shown)


# 12 ------------------------------------------------------------------------------------------------


def test_walsh_keeps_distances():
    matrix = centroids.walsh()
    assert (matrix @ matrix.T == 64 * np.eye(64, dtype=np.int64)).all()
    assert ((np.diff(matrix, axis=1) != 0).sum(axis=1) == np.arange(64)).all()


@pytest.mark.parametrize("size", [1, 30, 1 << 20, 1 << 28])
def test_search_is_exact(size):
    rng = np.random.default_rng(size)
    vectors, points = rng.integers(-size, size + 1, (200, 64)), rng.integers(-size, size + 1, (16, 64))
    vectors[:20], points[3] = points[rng.integers(0, 16, 20)], points[9]
    number, distance = centroids.search(vectors, points)
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, p)) for p in points] for v in vectors]
    assert number.tolist() == [min(range(16), key=lambda k: (e[k], k)) for e in every]  # noqa: B023
    assert [int(d) for d in distance] == [min(e) for e in every]
    assert [len(x) for x in centroids.search(vectors[:0], points)] == [0, 0]


def test_clusters_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.4, (9, 64))
    rows = [(k, [float(np.float32(x)) for x in base[k % 9] + rng.normal(0, 0.1, 64)]) for k in range(150)]
    rows += [(200 + k, rows[5][1]) for k in range(60)] + [rows[7]] * 3
    bad = [(400, rows[0][1][:63]), (401, rows[0][1] + [0.0]), (402, None), (403, []), (404, [None] + rows[0][1][1:]), (405, [math.nan] + rows[0][1][1:]), (406, [math.inf] + rows[0][1][1:]), (407, [1e30] + rows[0][1][1:])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>")
    found = centroids.cluster(odd(df))
    names = sorted(found.columns)
    connection = duckdb.connect()
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "e"))
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    cursor = connection.execute(SQL["op12_centroid_clustering"])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == names
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(tuple(r[order.index(n)] for n in names) for r in cursor.fetchall())


def test_clusters_of_few_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    one = spark.createDataFrame([(None, [0.5] * 64), (3, [0.25] * 64), (3, [0.25] * 64)], schema)
    rows = sorted(map(str, centroids.cluster(one).select("vec_id", "distance", "inertia").collect()))
    assert rows == ["Row(vec_id=3, distance=0, inertia=0)"] * 2 + ["Row(vec_id=None, distance=0, inertia=0)"]
    empty = centroids.cluster(one.limit(0))
    assert empty.count() == 0 and empty.dtypes == centroids.cluster(one).dtypes


# 13 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def files():
    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(), Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def by_bytes(pair, text):
    """Tokens of a whole text, cut by their bytes alone; None if those are not the text's."""
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text, num_threads=1)
    data = (" " + text).encode()
    parts = [[pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]]
    if not text or any(b"".join(p) != data for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    groups, links = [], []
    last = 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([i for i, e in zip(ids, own) if last < e <= end] for ids, own in zip((a, b), ends)))
        last = end
    ends_b = dict(zip(ends[1], b))
    links = [(i, ends_b[e]) for i, e in zip(a, ends[0]) if e in ends_b]
    return len(a), len(b), groups, links


TEXTS = [
    None, "", " ", "  ", "a", "a ", "a  ", " a", "a\n b  \n  c", "\n", "x\ty", "a▁b ▁ c", "é中😀x 中中 ‍ ", "don't it's  we'll", "<s> </s> <0x0A> <|endoftext|> <unk>",
    "\x00 \x1c \x85 a", "ﬁ ́é é", "日本語のテキスト と English", "  " * 40 + "x", "1234567 89,00 $5", "a\r\n b\r", "{\r\n}\r ;\r", "👩‍👩‍👧 flags 🇩🇪 ok", "\U000e0041 �", "word " * 50, "tail　 x", "　 x",
]


def test_alignment_equals_whole_texts(spark, files):
    pair = tokenizer_alignment.Pair(*files)
    rng = random.Random(3)
    pieces = [" ", "  ", "\n", "a", "the", "é", "中", "😀", "'s", "1", "!", "\x85", "ing", "\r", "\xa0", "ß", "́"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(300)] + ["long" * 20_000, "é " * 9000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a the end"), (3, "repeated row"), (3, "repeated row")]
    found = tokenizer_alignment.align(odd(spark.createDataFrame(rows, DOCS)), *files).collect()
    told = [(k, by_bytes(pair, t or "")) for k, t in rows]
    counts = Counter(link for _, x in told if x for link in x[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    expected = []
    for k, x in told:
        if x is None:
            expected.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[link] == most[link[1]] for link in links)
        expected.append((k, n_a, n_b, len(groups), len(links), best, sum(counts[link] for link in links), hashlib.sha256(shown.encode()).hexdigest()))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in found))) == sorted(map(str, expected))
    assert sum(x is None for _, x in told) == 3  # null, empty, and the text that holds the sign for a blank itself


def test_alignment_beyond_memory_and_broadcast(spark, files, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    usual = sorted(map(str, tokenizer_alignment.align(docs, *files).collect()))
    from chronolog.llm import shared

    monkeypatch.setattr(tokenizer_alignment, "small", lambda df: shared.small(df, 0))
    assert sorted(map(str, tokenizer_alignment.align(docs, *files).collect())) == usual
    assert tokenizer_alignment.align(docs.limit(0), *files).count() == 0


def test_runs_of_chunks_are_aligned_as_single_chunks(files, monkeypatch):
    """The tokenizers read few texts for many chunks; chunks whose bytes differ are found among the others."""
    pair = tokenizer_alignment.Pair(*files)
    rng = random.Random(5)
    pieces = [" ", " ", "\n", "a", "the", "é", "中", "😀", "'s", "1", "!", "\x85", "ing", "\r", "\xa0", "́"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    chunks = list(dict.fromkeys(c for t in texts for c in pair.chunks(t)))
    rng.shuffle(chunks)

    def told(chunks, **how):
        return [x.tolist() if isinstance(x, np.ndarray) else x for x in tokenizer_alignment.aligned(pair, chunks, **how)]

    read = []
    encode = pair.b.encode
    monkeypatch.setattr(pair.b, "encode", lambda texts, **how: read.append(len(texts)) or encode(texts, **how))
    clean = [c for c in chunks if tokenizer_alignment.BLANK not in c]
    assert not any(told(clean)[0]) and len(read) == 1 and read[0] < len(clean) / 2
    assert told(clean) == told(clean, single=True)
    mixed = told(chunks)
    assert any(mixed[0]) and mixed == told(chunks, single=True)
    monkeypatch.setattr(tokenizer_alignment, "RUN", 7)
    assert told(chunks) == mixed


def test_arrays_with_room():
    array, n = np.zeros((0, 2), np.int64), 0
    moved = 0
    for k in range(300):
        grown = tokenizer_alignment.put(array, n, np.full((k % 3, 2), k))
        moved, array, n = moved + (grown is not array), grown, n + k % 3
    assert array[:n, 1].tolist() == [k for k in range(300) for _ in range(k % 3)] and moved < 20


def test_spans_are_coarse_cuts():
    def ends(spans, lengths):
        starts, stops = np.array(spans).T
        return tokenizer_alignment.Tokens(np.arange(len(spans)), np.array([len(spans)]), starts, stops, np.array(lengths), np.array([0, sum(lengths)])).ends.tolist()

    assert ends([(0, 4), (1, 4), (1, 4), (4, 6)], [2, 1, 1, 2]) == [2, 3, 4, 6]  # three tokens share a character
    assert ends([(0, 0), (0, 3)], [1, 2]) == [1, 3] and ends([(0, 1), (1, 1), (1, 3)], [1, 1, 1]) == [1, 2, 3]
