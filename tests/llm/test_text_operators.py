"""Operators for training text against brute force, on small tables with nulls, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from chronolog.llm import (
    blocks, bpe, chat_format, decontamination, html_text, language_id, line_dedup, lm_score, ngram_join, quality, queries, spans, token_counts,
)
from chronolog.llm.shared import arrow_rows, components

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, fold=True):
    w = WORD.findall(lowered(text) if fold else text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def corpus():
    """Documents with exact and near copies, repeated lines, odd white space, nulls and empty texts."""
    rng = random.Random(7)
    texts = []
    for k in range(60):
        lines = [prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        texts.append("\n".join(lines))
    common = prose(rng, 60)
    texts += [t + "\n" + common for t in texts[:12]]
    for t in texts[:8]:
        w = t.split(" ")
        for _ in range(3):
            x = list(w)
            for _ in range(max(1, len(x) // 40)):
                x[rng.randrange(len(x))] = "edit"
            texts.append(" ".join(x))
    texts += [texts[0], texts[0].upper(), texts[1].replace(" ", "  "), None, "", " \n\t", "one two", "ONE two", "one two three four five"]
    texts += ["É été Ünter x", "ÉTÉ", "été"]
    return [(k, t, "en", "s", 0) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def library(ranks):
    return tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd(df):
    """Extra columns under names that operators use themselves."""
    for name in ("h", "h2", "key", "n", "tokens", "token", "block", "id", "line", "w", "component", "_id", "_h", "_hash", "learn"):
        df = df.withColumn(name, F.lit("x"))
    return df


# 1 -------------------------------------------------------------------------------------------------


def test_pretokens_follow_the_pattern(ranks):
    rng, enc = random.Random(3), None
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    alphabet = " \t\n  '''strevmlld aéЯ1٢½!?-_\0  中\x1c\x85😀"
    for _ in range(1500):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 4))]
        chars, after = spans.code_points(texts)
        start, end = spans.pretokens(chars, after)
        joined = "\0".join([*texts, ""])
        expected = [m for t in texts for m in pattern.findall(t)]
        assert [joined[a:b] for a, b in zip(start, end)] == expected, (texts, enc)
        code, words = spans.distinct(chars, start, end)
        assert [words[c] for c in code] == expected


def test_bpe_equals_the_library(spark, docs, ranks):
    long = "  x" * 40_000 + "\n" * 3000 + "é" * 5000
    rows = docs.union(spark.createDataFrame([(None, "no id's text", None, None, None), (500, long, None, None, None), (500, long, None, None, None)], DOCS))
    enc = library(ranks)
    done = bpe.decode(bpe.encode(odd(rows), ranks, public_tokenizers.PATTERN), ranks).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    found = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in done), key=key)
    expected = sorted(((r[0], enc.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows.collect()), key=key)
    assert found == expected
    assert bpe.encode(rows.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


# 2 -------------------------------------------------------------------------------------------------


def links_of(rows):
    sets = {k: shingles(t) for k, t, *_ in rows}
    keys = [k for k in sets if sets[k]]
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}, sets


def least_reachable(rows):
    links, sets = links_of(rows)
    label = {k: k for k in sets}
    for _ in label:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {k: (len(sets[k]), label[k]) for k in label}


def test_decoding_needs_no_workers(spark, ranks):
    token = {i: t for t, i in ranks.items()}
    some = [[1, 2, 300, 50_000], [], [256, 256], None]
    rows = spark.createDataFrame(list(enumerate(some)), "`doc id` int, ids array<int>")
    done = bpe.decode(rows, ranks)
    assert "InArrow" not in done._jdf.queryExecution().toString()
    found = {r[0]: r[2] and bytes(r[2]) for r in done.collect()}
    assert found == {k: ids and b"".join(token[i] for i in ids) for k, ids in enumerate(some)} | {1: b""}
    for unknown in ([1_000_000], [-1], [1, None]):
        with pytest.raises(Exception, match="not in the vocabulary"):
            bpe.decode(spark.createDataFrame([(unknown,)], "ids array<int>"), ranks).collect()
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(rows.limit(3), {b"a": 1}).collect()


def test_blocks_are_packed_in_small_steps(spark):
    """No array of a task spans more than a lot of texts, a task is handed few texts at once, and the session keeps its settings."""
    rows = [(str(k), "ab cd " * 400 + f"x{k}", k % 2 == 0) for k in range(300)] + [(None, None, True)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def split(chars, after):
        assert len(chars) <= blocks.LOT + 2500
        return spans.words(chars, after)

    assert blocks.BATCH < int(before)
    table = blocks.block_table(spark.createDataFrame(rows, "id string, text string, learn boolean").coalesce(1), split)
    assert spark.conf.get(name) == before
    assert blocks.text_rows(table).count() == len(rows)
    times = Counter()
    for row in blocks.dictionary_rows(table).collect():
        times.update(dict(zip(blocks.unpacked_words(row["words"]), blocks.unpacked(row["counts"]).tolist())))
    assert times == Counter(w.encode() for _, text, learn in rows if learn for w in (text or "").split()) | Counter(
        {f"x{k}".encode(): 0 for k in range(1, 300, 2)}
    )
    with arrow_rows(spark, 7):
        assert spark.conf.get(name) == "7"
    assert spark.conf.get(name) == before


def test_classes_of_code_points_are_found_in_little_memory(monkeypatch):
    monkeypatch.setattr(spans, "_kinds", None)
    tracemalloc.start()
    try:
        kinds = spans.kinds()
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
    assert [kinds[ord(c)] for c in "aß漢7٣ \u3000\n'"] == [spans.LETTER] * 3 + [spans.NUMBER] * 2 + [spans.SPACE] * 3 + [spans.OTHER]


def test_ngram_groups_equal_brute_force(spark, docs):
    rows = corpus()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(odd(docs)).collect()}
    assert found == least_reachable(rows)
    assert len({c for _, c in found.values()}) < len(rows) - 20


def test_ngram_links_are_all_pairs_of_classes(spark):
    rng = random.Random(5)
    base = prose(rng, 80, 10_000).split(" ")
    rows = []
    for k in range(40):  # a family of variants, some of which only meet by way of others
        x = list(base)
        for i in range(k % 7):
            x[(11 * i + k) % 80] = f"v{k}"
        rows.append((k, " ".join(x), None, None, None))
    df = spark.createDataFrame(rows, DOCS)
    found = {(r["a"]["doc_id"], r["b"]["doc_id"]) for r in ngram_join.links(df).collect()}
    links, sets = links_of(rows)
    first = {}
    for k in sets:
        first.setdefault(frozenset(sets[k]), k)
    expected = {(a, b) for a, b in links if first[frozenset(sets[a])] == a and first[frozenset(sets[b])] == b}
    assert {tuple(sorted(p)) for p in found} == expected
    labels = {r["doc_id"]: r["component_id"] for r in ngram_join.groups(df).collect()}
    assert labels == {k: c for k, (_, c) in least_reachable(rows).items()}


def test_ngram_odd_rows(spark):
    text = prose(random.Random(1), 30)
    df = spark.createDataFrame([(None, text, None, None, None), (4, text, None, None, None), (4, text, None, None, None), (3, text, None, None, None)], DOCS)
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in ngram_join.groups(df).collect()))) == ["(3, 3)", "(4, 3)", "(4, 3)", "(None, None)"]
    assert sorted(map(str, (r["doc_id"] for r in ngram_join.keep_one(df).collect()))) == ["3", "None"]
    twice = df.where("doc_id = 4")
    assert ngram_join.keep_one(twice).count() == 1
    assert ngram_join.groups(df.limit(0)).count() == 0 and ngram_join.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


# 3 -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, docs, ranks, rule):
    enc = library(ranks)
    rows = token_counts.count_sections(odd(docs), ranks, public_tokenizers.PATTERN, rule).collect()
    found = Counter()
    for r in rows:
        found[r["doc_id"], r["section"]] = (r["n_chars"], r["n_tokens"])
    expected = {}
    for k, text, *_ in corpus():
        text = text or ""
        parts = text.split("\n")
        sizes = [len(p) + (i < len(parts) - 1) for i, p in enumerate(parts)]
        owner = [i for i, s in enumerate(sizes) for _ in range(s)]
        at_byte = [c for c, x in enumerate(text) for _ in range(len(x.encode()))]
        counts, at = Counter(), 0
        for i in enc.encode_ordinary(text):
            size = len(enc.decode_single_token_bytes(i))
            touched = sorted(set(at_byte[at : at + size]))
            held = Counter(owner[c] for c in touched)
            at += size
            counts[{"start": owner[touched[0]], "end": owner[touched[-1]], "most": min(held, key=lambda s: (-held[s], s))}[rule]] += 1
        expected.update({(k, i): (s, counts[i]) for i, s in enumerate(sizes)})
    assert dict(found) == expected


# 4 -------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, n, 5000)) for k, n in enumerate([3, 4, 5, 6, 9, 15, 24, 40, 57, 200])] + [(50, None), (51, " "), (7, prose(rng, 30, 5000))]
    rows = []
    for k in range(60):
        words = prose(rng, rng.choice([20, 200, 2000]), 5000).split(" ")
        if k % 2:
            item = items[k % len(items)][1] or ""
            part = item.split(" ")
            for _ in range(k % 4):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = part
        rows.append((k, " ".join(words).upper() if k % 5 == 0 else " ".join(words), None, None, None))
    rows += [(100, None, None, None, None), (101, "", None, None, None), (None, items[5][1], None, None, None), (5, rows[5][1], None, None, None)]
    found = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontamination.leaks(
        odd(spark.createDataFrame(rows, DOCS)), odd(spark.createDataFrame(items, "item_id bigint, text string"))).collect()}
    expected = set()
    for k, text, *_ in rows:
        w = WORD.findall(lowered(text))
        for i, item in items:
            v = WORD.findall(lowered(item))
            size = min(len(v), 5)
            sought = {tuple(v[j : j + size]) for j in range(len(v) - size + 1)} if v else set()
            held = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
            if sought and 100 * len(sought & held) >= 75 * len(sought):
                expected.add((k, i, len(sought), len(sought & held)))
    assert found == expected and len(expected) > 8
    empty = spark.createDataFrame([], "item_id bigint, text string")
    df = spark.createDataFrame(rows, DOCS)
    assert decontamination.leaks(df, empty).count() == 0 and decontamination.clean(df, empty).count() == len(rows)
    assert decontamination.clean(df.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


# 5 -------------------------------------------------------------------------------------------------


class Tail:
    """Adds an end mark after all turns."""

    def render(self, turns):
        return "<s>" + "".join(f"[{r}]{t.strip()}\n" for r, t in turns) + "</s>"


class Forgetful:
    """Drops what earlier assistants thought, so that output for more turns changes the past."""

    def render(self, turns):
        last = len(turns) - 1
        return "".join(f"{r}:{t if i == last else t.replace('think', '')};" for i, (r, t) in enumerate(turns))


def test_chat_spans(spark):
    rng = random.Random(2)
    pieces = ["\\", "###", "####", "</turn>", "a", "\n", "é", "<", "\\### Assistant: ", " ", ":", "\ue000", "\ue001\ue000\ue001"]
    rows = [(c, t, rng.choice(["user", "assistant", "a:b\\", "", "\ue001\ue000\ue001", "\ue000"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for c in range(40) for t in range(c % 6 + 1)]
    rows += [(90, None, None, None), (90, 1, "assistant", None), (91, 1, "user", "x"), (91, 1, "user", "x"), (None, 1, "user", "no id")]
    df = odd(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    template = chat_format.MarkedTurns()
    done = chat_format.format_chats(df, template)
    cut = lambda a, b: F.substring("formatted", a + 1, b - a)
    read = F.transform("spans", lambda s: F.struct(template.role(cut(s["start"], s["text_start"])), template.text(cut(s["text_start"], s["text_end"])), s["loss"]))
    found = {r[0]: [tuple(t) for t in r[1]] for r in done.select("conv_id", read).collect()}
    expected = {}
    for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or "", role == "assistant"))
    assert found == expected


def test_chat_templates_with_tails_and_rewriting():
    turns = [("user", " hi "), ("assistant", "</s"), ("user", "hi")]
    text, found, at = chat_format.located(Tail(), turns)
    assert at is None and [text[a:b] for _, _, a, b in found] == ["hi", "</s", "hi"] and text.endswith("</s>")
    assert [text[a:b] for a, b, _, _ in found] == ["[user]hi\n", "[assistant]</s\n", "[user]hi\n"]
    assert chat_format.located(Forgetful(), [("user", "a"), ("assistant", "think b"), ("user", "c")])[1:] == (None, 2)
    assert chat_format.located(Tail(), []) == ("<s></s>", [], None)


def test_chat_probe_is_in_no_role_or_text():
    for held in ("\ue001\ue000\ue001", "\ue000", "\ue001\ue000\ue000", "\ue000" * 40 + "\ue001"):
        turns = [(held, "one"), ("user", held), (held + "x" + held, held * 2)]
        text, found, at = chat_format.located(Tail(), turns)
        assert at is None and [text[a:b] for _, _, a, b in found] == ["one", held, held * 2]


def test_chat_query_equals_brute_force(spark, tmp_path):
    """What the query reads back from the output is what went in, and conversation -7 is there."""
    rng = random.Random(8)
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], rng.choice([None, "", "\\### x </turn>", "a\n\nb", "é😀 \\\\ ", "### : </turn> "])) for c in range(30) for t in range(1, c % 7 + 2)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    control = r"\### Assistant: </turn> ok"
    turns = {-7: [("user", control), ("assistant", control)]}
    for c, t, role, text in rows:
        turns.setdefault(c, []).append((role, text or ""))
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = {}
    for c, of in turns.items():
        loss = "".join(text for role, text in of if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in of)
        expected[c] = (len(of), digest(whole), len(loss), digest(loss), len(chat_format.MarkedTurns().render(of)))
    found = {r[0]: tuple(r[1:]) for r in queries.op5_chat_formatting(spark, str(tmp_path)).collect()}
    assert found == expected and len(found) == 31


# 6 -------------------------------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
{body}<aside>More</aside><form><p>Sign up</p></form><div id="comments"><article><p>First!</p></article></div>
<footer>&copy; me</footer></body></html>"""


def test_html_article():
    body = "<article><h1>A &amp; B</h1><p><b>One\n  two<br>three<br><p>caf&eacute;&nbsp;x <a href='#'>link</a><div class=\"ad\">Buy</div><ul><li>i<li>j</ul><pre>p  q</pre></article>"
    assert html_text.main_text(PAGE.format(body=body)) == "A & B\n\nOne two three\n\ncafé x link\n\ni\n\nj\n\np q"


def test_html_wrapper_induction(spark):
    rng = random.Random(4)
    paragraphs = [[prose(rng, 20) for _ in range(rng.randint(1, 4))] for _ in range(12)]
    page = lambda ps: "<body><div><p>Welcome to our shop</p></div><div>" + "".join(f"<p>{p}</p>" for p in ps) + "</div></body>"
    rows = [(k, f"http://shop.example.com/{k}", page(ps)) for k, ps in enumerate(paragraphs)]
    rows += [(90, None, page(["alone here"])), (91, "http://shop.example.com/x", None), (92, "http://other.example.com/", ""), (0, rows[0][1], rows[0][2])]
    df = odd(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    found = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    texts = [(k, "\n\n".join(ps)) for k, ps in enumerate(paragraphs)] + [(0, "\n\n".join(paragraphs[0]))]
    texts += [(90, "Welcome to our shop\n\nalone here"), (91, ""), (92, "")]
    assert found == sorted((k, t, len(t)) for k, t in texts)
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_template_inside_articles(spark):
    rng = random.Random(5)
    paragraphs = [[prose(rng, 20) for _ in range(rng.randint(1, 4))] for _ in range(12)]
    page = lambda ps: "<body><article><p>Like what you read?</p>" + "".join(f"<p>{p}</p>" for p in ps) + "<div>Tell a friend</div></article></body>"
    rows = [(k, f"http://news.example.com/{k}", page(ps)) for k, ps in enumerate(paragraphs)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert found == {k: "\n\n".join(ps) for k, ps in enumerate(paragraphs)}


def test_tree_matching_counts_the_most_pairs():
    a, b = html_text.parse("<div><p>x</p><ul><li>1<li>2</ul></div>"), html_text.parse("<div><h1>t</h1><p>y</p><ul><li>3</ul></div>")
    assert html_text.matched(a, b)[0] == 5 and len(html_text.matched(a, b)[1]) == 5


def test_tree_matching_equals_every_alignment(monkeypatch):
    rng = random.Random(6)

    def tree(depth):
        tag = rng.choice(["div", "p", "b"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)) + f"</{tag}>"

    def most(a, b):
        if a.label != b.label:
            return 0
        left, right = ([k for k in n.kids if not isinstance(k, str)] for n in (a, b))

        def aligned(i, j):
            if i == len(left) or j == len(right):
                return 0
            return max(aligned(i + 1, j), aligned(i, j + 1), most(left[i], right[j]) + aligned(i + 1, j + 1) if most(left[i], right[j]) else 0)

        return 1 + aligned(0, 0)

    for _ in range(40):
        a, b = (html_text.parse("<section>" + "".join(tree(2) for _ in range(3)) + "</section>") for _ in range(2))
        size, pairs = html_text.matched(a, b)
        assert size == most(a, b) == len(pairs) and all(x.label == y.label for x, y in pairs)
        with monkeypatch.context() as m:
            m.setattr(html_text, "PAIRS", 0)
            assert html_text.matched(a, b)[0] <= size


def test_long_lists_of_siblings_are_aligned_as_short_ones(monkeypatch):
    rng = random.Random(7)

    def tree(depth):
        tag = rng.choice(["div", "p", "b"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)) + f"</{tag}>"

    for width in (1, 4, 9, 30, 60):
        a, b = (html_text.parse("<section>" + "".join(tree(2) for _ in range(width)) + "</section>") for _ in range(2))
        size, pairs = html_text.matched(a, b)
        with monkeypatch.context() as m:
            m.setattr(html_text, "PAIRS", 0)
            m.setattr(html_text, "SIZES", rng.choice([0, 1000]))
            other, same = html_text.matched(a, b)
        assert other == size and {(id(x), id(y)) for x, y in same} == {(id(x), id(y)) for x, y in pairs}


def test_html_keeps_headings_and_what_a_class_only_hints_at(spark):
    rng = random.Random(8)
    page = (
        "<body><article><h2>Abstract</h2><p>{0} by <b>Reuters</b> {1}</p><div class='related-work'><p>{2}</p></div><section class='comment-analysis'>{3}</section>"
        "<div class='ad-hoc'>Sign up now</div><div class='share-buttons'>{4}</div><div class='related-reading'><a href='/x'>{5}</a></div><table><tr><th>Year</th></tr><tr><td>{6}</td></tr></table></article></body>"
    ).format
    facts = [[prose(rng, 8) for _ in range(7)] for _ in range(12)]
    rows = [(k, f"http://papers.example.com/{k}", page(*f)) for k, f in enumerate(facts)]
    rows += [(50, "http://papers.example.com/stub", "<p>Moved</p>"), (51, "http://papers.example.com/deep", "<article>" + "<div>" * 5000 + "far" + "</div>" * 5000 + "</article>")]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    expected = {k: "\n\n".join(["Abstract", f"{f[0]} by Reuters {f[1]}", f[2], f[3], "Year", f[6]]) for k, f in enumerate(facts)}
    assert found == {**expected, 50: "Moved", 51: "far"}


def test_html_seeds_are_those_of_layouts(spark):
    rng = random.Random(9)
    news = "<body><div><p>Welcome to our shop</p></div><div><p>{}</p></div></body>".format
    shop = "<body><section><p>All prices with tax</p></section><section><p>{}</p></section></body>".format
    texts = [prose(rng, 20) for _ in range(16)]
    rows = [(k, "http://x.example.com/a", (news if k % 2 else shop)(t)) for k, t in enumerate(texts)] + [(90, "http://x.example.com/b", "")]
    rows += [(91, "http://x.example.com/c", "<body>Gone</body>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert found == {**dict(enumerate(texts)), 90: "", 91: "Gone"}


def test_html_of_very_wide_pages():
    wide = lambda k: html_text.parse("<body>" + "".join("<p>x</p>" if i % k else f"<p><b>{i}</b></p>" for i in range(5000)) + "</body>")
    size, pairs = html_text.matched(wide(3), wide(4))
    assert size == len(pairs) > 5000


# 7 -------------------------------------------------------------------------------------------------


def test_language_spans(spark):
    rng = random.Random(6)
    syllables = {"xx": ["ba", "lo", "tri"], "yy": ["zu", "keh", "mog"], "ru": ["да", "но", "ли"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, say(lang, 40), lang, None, None) for k, lang in enumerate(["xx", "yy", "ru"] * 20)]
    mixed = [say("xx", 30), say("yy", 20), say("ru", 10)]
    rows += [(100, ". ".join(mixed), None, None, None), (101, None, "xx", None, None), (102, "12 !", "yy", None, None), (103, "", None, None, None), (None, say("yy", 5), None, None, None)]
    df = odd(spark.createDataFrame(rows, DOCS))
    model = language_id.train(df, F.lit(True))
    found = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert all(found[k]["lang_pred"] == lang for k, _, lang, _, _ in rows[:60])
    assert [s["lang"] for s in found[100]["spans"]] == ["xx", "yy", "ru"] and found[100]["lang_pred"] == "xx"
    assert [rows[60][1][s["start"] : s["end"]] for s in found[100]["spans"]] == mixed
    assert [(found[k]["lang_pred"], found[k]["score"], found[k]["spans"]) for k in (101, 102, 103)] == [("und", 0.0, [])] * 3
    assert found[None]["lang_pred"] == "yy" and all(0 <= r["score"] <= 1 for r in found.values())
    nothing = language_id.identify(df, language_id.train(df.limit(0), F.lit(True)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], rng.integers(0, 50, (3, language_id.SLOTS)).astype(float), np.ones((3, len(language_id.SCRIPTS))))
    texts = ["ab cd ef gh", "", "xyz", "no one is here at all"]
    start, end, owner, label = model.label(texts)
    _, _, _, slot, _ = language_id.letters(texts)
    for t in range(len(texts)):
        mine = np.flatnonzero(owner == t)
        scores = [model.logs[slot[start[i] : end[i]]].sum(axis=0) for i in mine]
        value = lambda path: sum(s[k] for s, k in zip(scores, path)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max((value(p) for p in itertools.product(range(3), repeat=len(mine))), default=0)
        assert value(label[mine]) == pytest.approx(best, abs=1e-2)


# 8 -------------------------------------------------------------------------------------------------


def test_line_dedup_equals_brute_force(spark, docs):
    rows = corpus()
    found = {r["doc_id"]: (r["removed_lines"], r["text"]) for r in line_dedup.dedup_lines(odd(docs)).collect()}
    seen, expected = [], {}
    for k, text, *_ in rows:
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            s = shingles(line)
            match = bool(s) and any(7 * len(s & o) >= 3 * (len(s) + len(o)) for o in seen)
            gone += match
            if not match:
                kept.append(line)
            if s:
                seen.append(s)
        expected[k] = (gone, None if text is None else "\n".join(kept))
    assert found == expected and sum(g for g, _ in found.values()) > 20


def test_line_dedup_odd_rows(spark):
    text = "a b c d e f g\nx"
    df = spark.createDataFrame([(1, text, None, None, None), (1, text, None, None, None), (None, text, None, None, None), (2, "q\na b c d e f g", None, None, None)], DOCS)
    found = sorted(map(str, ((r["doc_id"], r["text"], r["removed_lines"]) for r in line_dedup.dedup_lines(df).collect())))
    assert found == ["(1, '', 2)", "(1, '', 2)", "(2, 'q', 1)", f"(None, {text!r}, 0)"]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_folds_case(spark):
    rng = random.Random(11)
    line, accented = "Terms of Use and Conditions apply", "Été à la mer et au Soleil"
    long = prose(rng, 40)
    near = long.upper().rsplit(" ", 1)[0] + " EDIT"
    texts = [f"{line}\n{accented}\n{long}", f"{line.upper()}\n{near}\nnew words of the second document", "ÉTÉ À LA MER ET AU SOLEIL", "Été À la mer ET AU SOLEIL", "ÉTé à LA MER ET AU SOLEIL"]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    seen, expected = [], {}
    for k, text in enumerate(texts):
        sets = [(x, shingles(x)) for x in text.split("\n")]
        kept = []
        for x, s in sets:
            if not any(7 * len(s & o) >= 3 * (len(s) + len(o)) for o in seen):
                kept.append(x)
            seen.append(s)
        expected[k] = "\n".join(kept)
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert found == expected and found[1] == "new words of the second document" and found[2] == texts[2]


def test_line_dedup_short_lines(spark):
    texts = ["Read more\n\n  \none two three four\nx\nfour words and one more", "x\nREAD  more \nread\tMORE\none two three\n", "X", "one two three FOUR\ty", "y", "one two three four\nread more\n"]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    seen, expected = [], {}
    for k, text in enumerate(texts):
        kept = []
        for line in text.split("\n"):
            s = shingles(line)
            if not s or not any(7 * len(s & o) >= 3 * (len(s) + len(o)) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        expected[k] = (len(text.split("\n")) - len(kept), "\n".join(kept))
    found = {r["doc_id"]: (r["removed_lines"], r["text"]) for r in line_dedup.dedup_lines(df).collect()}
    assert found == expected and [found[k][0] for k in range(6)] == [0, 3, 1, 0, 0, 2]


def test_line_dedup_prefixes(spark):
    from pyspark.sql import functions as F

    from chronolog.llm import setjoin

    rng = random.Random(12)
    lines = []
    for k in range(150):
        w = [rng.choice("abcd" if k % 3 else "abcdefghijklmnop") for _ in range(rng.randrange(5, 60))]
        other = list(w)
        for _ in range(rng.randrange(4)):
            other[rng.choice([0, -1, rng.randrange(len(w))])] = "x"
        lines += [w, other + other[: rng.randrange(5)], w + w]
    lines = sorted({"\t ".join(w) if len(w) % 2 else " ".join(w) for w in lines})
    sets = [shingles(line) for line in lines]
    rows = line_dedup._prefixes(spark.createDataFrame(list(enumerate(lines)), "h bigint, line string"))
    sized = rows.groupBy("h", "least", "most").agg(F.countDistinct("token").alias("n"), F.any_value(setjoin.listed(F.col("most"))).alias("listed"))
    listed = {r["h"]: r for r in sized.collect()}
    assert len(listed) == len(lines) and rows.count() == rows.distinct().count()
    for k, s in enumerate(sets):
        r = listed[k]
        assert r["least"] <= len(s) <= r["most"] and min(len(s), r["listed"]) <= r["n"] <= len(s)
    assert sum(r["n"] for r in listed.values()) < sum(map(len, sets))
    near = {a for a, s in enumerate(sets) for b, o in enumerate(sets) if a != b and 7 * len(s & o) >= 3 * (len(s) + len(o))}
    met = {r["h"] for r in setjoin.meeting(rows).collect()}
    assert near <= met and near and len(met) < len(lines)
    repeats = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(lines)], DOCS)
    gone = {r["doc_id"] for r in line_dedup.dedup_lines(repeats).where("removed_lines > 0").collect()}
    assert gone == {a for a in near if any(7 * len(sets[a] & o) >= 3 * (len(sets[a]) + len(o)) for o in sets[:a])}


# 9 -------------------------------------------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    from math import exp, log

    ranks = {bytes([b]): b for b in range(256)} | {b" a": 256, b"ab": 257, b" ab": 258, b"ba": 259}
    pieces = lm_score.Pieces(ranks, {i: i % 7 for i in range(260)}, 5)

    def total(text):
        return 1.0 if not text else sum(exp(pieces.logs[text[:k]]) * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces.logs)

    for word in (b"a", b"ab", b"abba", b"", b"zab"):
        assert pieces.weight(word) == pytest.approx(log(total(b" " + word)))
    assert sum(map(exp, pieces.logs.values())) + exp(pieces.end) == pytest.approx(1)


def test_lm_scores(spark, docs, ranks):
    """The score against a plain sum over all segmentations, with piece counts taken from the library directly."""
    from functools import cache
    from math import fsum, log10

    import tiktoken

    rows = corpus()
    learn = F.col("doc_id") % 3 != 0
    found = {r["doc_id"]: r for r in lm_score.score(docs, learn, ranks, public_tokenizers.PATTERN).collect()}
    counts = Counter()
    for k, text, *_ in rows:
        if k % 3:
            counts.update([*WORD.findall(lowered(text)), None])
    n, v = sum(counts.values()), len(counts)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = Counter()
    for word, c in counts.items():
        for i in library.encode_ordinary(" " + word) if word is not None else []:
            pieces[i] += c
    usable = {t: i for t, i in ranks.items() if b" " not in t[1:]}
    total = sum(pieces[i] for i in usable.values()) + counts[None] + len(usable) + 1

    @cache
    def ways(text):
        return 1.0 if not text else fsum((pieces[usable[text[:k]]] + 1) / total * ways(text[k:]) for k in range(1, len(text) + 1) if text[:k] in usable)

    def likely(token):
        return (counts[None] + 1) / total if token is None else ways(b" " + token.encode())

    for k, text, *_ in rows:
        tokens = [*WORD.findall(lowered(text)), None]
        r = found[k]
        assert r["score"] == pytest.approx(sum(log10(likely(t)) for t in tokens))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["learn"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n, k % 3 != 0)
        assert r["base_score"] == pytest.approx(sum(log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
    assert lm_score.score(docs.limit(0), learn, ranks, public_tokenizers.PATTERN).count() == 0
    untaught = lm_score.score(odd(docs), F.lit(None).cast("boolean"), ranks, public_tokenizers.PATTERN).collect()
    assert {r["train_tokens"] for r in untaught} == {0} and all(r["n_known"] == 0 for r in untaught)


# 10 ------------------------------------------------------------------------------------------------


def stats_of(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, docs):
    more = [(200, "a b " * 3000, None, None, None), (201, "a b c a b c d e a b c\nq\nq\n \n \n", None, None, None), (202, " ".join(f"{i} {i}" for i in range(40)) * 2, None, None, None), (None, "| x", None, None, None)]
    rows = corpus() + more
    found = quality.statistics(odd(docs.select("doc_id", "text")).unionByName(odd(spark.createDataFrame(more, DOCS).select("doc_id", "text")))).collect()
    assert {r["doc_id"]: tuple(r[c] for c in quality.BASE) for r in found} == {r[0]: stats_of(r[1]) for r in rows}
    assert quality.statistics(docs.limit(0)).count() == 0


def test_rules_are_learned(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(80)]
        bad = k % 5 == 0
        if bad and k % 2:
            words = [w + "##" for w in words]
        elif bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), "en", "s", 1))
        if k < 200:
            labels.append((k, 0 if bad else 1))
    rows += [(900, None, None, None, None), (901, "short", None, None, None)]
    labels += [(0, None), (None, 0), (9999, 1)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(docs, known).collect()}
    assert kept == {**{k: k % 5 != 0 for k in range(300)}, 900: False, 901: False}
    stay = quality.keep_good(odd(docs), known)
    assert {r["doc_id"] for r in stay.collect()} == {k for k, v in kept.items() if v} and stay.columns == odd(docs).columns
    unlabelled = quality.judged(docs, known.limit(0))
    assert unlabelled.where("kept").count() == 300 and quality.judged(docs.limit(0), known).count() == 0


# pipeline ------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, ranks):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [(r["item_id"], shingles(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept.collect()
        kept = spark.createDataFrame(stage(spark, kept, folder).collect(), docs.schema) if number < 4 else stage(spark, kept, folder)
        after = {r["doc_id"]: r for r in kept.collect()}
        if number == 0:
            judged = {r["doc_id"]: r["kept"] for r in quality.judged(docs, labels).collect()}
            assert set(after) == {k for k, v in judged.items() if v}
        elif number == 1:
            seen = []
            for r in sorted(before, key=lambda r: r["doc_id"]):
                lines = []
                for line in r["text"].split("\n"):
                    s = shingles(line)
                    if not s or not any(7 * len(s & o) >= 3 * (len(s) + len(o)) for o in seen):
                        lines.append(line)
                    if s:
                        seen.append(s)
                text = "\n".join(lines)
                if WORD.search(text):
                    assert after[r["doc_id"]]["text"] == text and after[r["doc_id"]]["n_chars"] == len(text)
                else:
                    assert r["doc_id"] not in after
        elif number == 2:
            expected = least_reachable([(r["doc_id"], r["text"]) for r in before])
            assert set(after) == {k for k, (_, c) in expected.items() if k == c}
        elif number == 3:
            found = lambda r: any(s and 100 * len(s & shingles(r["text"])) >= 75 * len(s) for _, s in items)
            assert set(after) == {r["doc_id"] for r in before if not found(r)}
        else:
            enc = library(ranks)
            for r in before:
                assert after[r["doc_id"]]["ids"] == enc.encode_ordinary(r["text"])
                assert after[r["doc_id"]]["text_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
