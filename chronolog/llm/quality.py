"""Quality rules: text statistics and a learned decision list over them.

Statistics are Spark expressions over whole texts. A decision list is learned by sequential covering
from labelled documents: a rule is a conjunction of thresholds on statistics that is grown on two
thirds of the labelled rows and pruned on the rest; documents it covers are taken away before the next
rule is grown. The list is then one ordered conditional expression that Spark evaluates.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.functions.text import pinned
from chronolog.llm.shingles import words

#: The learner sees at most this many labelled documents, those with the least hash of their id.
LABELLED_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 32
#: Of the documents a rule rejects, at least so many of a hundred must be labelled bad.
PRECISION = 0.9

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: What rules may test: name and how it comes from the counts.
FEATURES = {
    "words": lambda c: c("n_words"),
    "word_length": lambda c: c("word_chars") / c("n_words"),
    "symbols_per_word": lambda c: c("n_symbols") / c("n_words"),
    "dup_lines_per_line": lambda c: c("n_dup_lines") / c("n_lines"),
    "repeated_words": lambda c: c("n_repeat_words") / c("n_words"),
    "upper_per_char": lambda c: c("n_upper") / c("word_chars"),
    "digits_per_char": lambda c: c("n_digits") / c("word_chars"),
    "marks_per_word": lambda c: c("n_marks") / c("n_words"),
    "words_per_line": lambda c: c("n_words") / c("n_lines"),
    "distinct_words": lambda c: c("n_distinct") / c("n_words"),
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document: ``id_col`` and the columns of ``BASE`` and a few more, all bigint.

    A null text counts as empty: all counts are 0. Repeated rows and ids give a row each. Columns other
    than the two named ones are not read. Work grows as n log n of a text's words, whatever it repeats.
    """
    text = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    base = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    counted = base.select(
        id_col,
        pinned(words(F.col("_t"))).alias("_w"),
        pinned(lines).alias("_l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("bigint").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[0-9]")).cast("bigint").alias("n_digits"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("bigint").alias("n_marks"),
    )
    keep = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
    n = F.size("_w")
    w = F.col("_w")
    runs = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    none = F.array().cast("array<bigint>")
    grams = counted.select(
        id_col,
        n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        "n_symbols", "n_upper", "n_digits", "n_marks",
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
        pinned(F.when(n >= 3, runs).otherwise(none)).alias("_g"),
    )
    ordered = grams.select(id_col, *keep, "_g", pinned(F.sort_array("_g")).alias("_s"))
    s = F.col("_s")
    again = F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
    found = ordered.select(id_col, *keep, "_g", pinned(again).alias("_d"))
    # few different repeats: look each window up; many: sort windows with their places
    g, d = F.col("_g"), F.col("_d")
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    placed = found.select(id_col, *keep, "_g", "_d", pinned(F.when(F.size(d) > 8, pairs)).alias("_p"))
    p = F.col("_p")
    same = lambda e, j: (F.get(p, j - 1)["x"] == e["x"]) | (F.get(p, j + 1)["x"] == e["x"])
    looked = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(d, F.get(g, i)))
    at = (
        F.when(F.size(d) == 0, F.array().cast("array<int>"))
        .when(p.isNull(), looked)
        .otherwise(F.sort_array(F.transform(F.filter(p, lambda e, j: F.coalesce(same(e, j), F.lit(False))), lambda e: e["i"])))
    )
    places = placed.select(id_col, *keep, pinned(at).alias("_at"))
    a = F.col("_at")
    # a repeated window adds the words up to the next repeated window, three at most
    covered = F.aggregate(
        F.transform(a, lambda x, j: F.least(F.coalesce(F.get(a, j + 1) - x, F.lit(3)), F.lit(3))),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )
    return places.select(id_col, *keep, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


def feature(name: str) -> Column:
    """A statistic as a double; 0 where it divides by nothing."""
    value = FEATURES[name](lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0)))
    return F.coalesce(value, F.lit(0.0)).cast("double")


Rule = tuple[Condition, ...]


def covers(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def _counts(rule: Rule, bad: list[dict], good: list[dict]) -> tuple[int, int]:
    return sum(covers(rule, r) for r in bad), sum(covers(rule, r) for r in good)


def _cuts(found: list[float]) -> list[float]:
    """Up to some ``CUTS`` values midway between neighbouring quantiles of the distinct values."""
    values = sorted(set(found))
    picked = values[:: max(1, len(values) // CUTS)]
    return [(a + b) / 2 for a, b in zip(picked, picked[1:])]


def _grow(bad: list[dict], good: list[dict]) -> Rule:
    """Add the condition that gains most information until no good document is covered."""
    rule: Rule = ()
    while good and len(rule) < MAX_CONDITIONS:
        p0, n0 = len(bad), len(good)
        best, gain = None, 0.0
        for name in FEATURES:
            of_bad, of_good = sorted(r[name] for r in bad), sorted(r[name] for r in good)
            for cut in _cuts(of_bad + of_good):
                over_p, over_n = p0 - bisect_right(of_bad, cut), n0 - bisect_right(of_good, cut)
                for above, p, n in ((True, over_p, over_n), (False, p0 - over_p, n0 - over_n)):
                    if p and (g := p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(name, above, cut), g
        if best is None:
            break
        rule += (best,)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return rule


def _prune(rule: Rule, bad: list[dict], good: list[dict]) -> Rule:
    """Drop conditions from the end as long as that is no worse on rows the rule was not grown on."""

    def worth(r: Rule) -> float:
        p, n = _counts(r, bad, good)
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(rows: list[tuple[dict[str, float], bool]]) -> list[Rule]:
    """An ordered list of rules for bad documents from ``(statistics, is bad)`` rows.

    Every third row is kept for pruning. Learning ends when a rule catches under half a percent of the
    bad rows, when it is not precise enough, or after ``MAX_RULES``. Without bad rows there is no rule.
    """
    grow_bad = [r for i, (r, b) in enumerate(rows) if b and i % 3]
    grow_good = [r for i, (r, b) in enumerate(rows) if not b and i % 3]
    prune_bad = [r for i, (r, b) in enumerate(rows) if b and not i % 3]
    prune_good = [r for i, (r, b) in enumerate(rows) if not b and not i % 3]
    least = max(2, len(grow_bad) // 200)
    rules: list[Rule] = []
    while grow_bad and len(rules) < MAX_RULES:
        rule = _prune(_grow(grow_bad, grow_good), prune_bad, prune_good)
        p, n = _counts(rule, grow_bad + prune_bad, grow_good + prune_good)
        if not rule or p < least or p < PRECISION * (p + n):
            break
        rules.append(rule)
        grow_bad, grow_good, prune_bad, prune_good = (
            [r for r in part if not covers(rule, r)] for part in (grow_bad, grow_good, prune_bad, prune_good)
        )
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a document, 0 if none does."""
    column = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column()
        column = F.when(test, k) if column is None else column.when(test, k)
    return F.lit(0) if column is None else column.otherwise(0)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[tuple[dict, bool]]:
    """Statistics of at most ``rows`` labelled documents that pass the base rules, for ``learn``.

    The sample is bounded before documents are read: the labels with the least hash of their id.
    Labels without a quality are left out; of repeated ids the lower quality counts.
    """
    known = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    seen = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    stats = statistics(seen.select(F.struct("doc_id", "_quality").alias("_key"), "text"), "_key")
    picked = stats.where(~base_failed()).select(
        "_key.doc_id", (F.col("_key._quality") == 0).alias("bad"), *[feature(f).alias(f) for f in FEATURES]
    )
    shuffled = [F.xxhash64("doc_id", *FEATURES), *FEATURES, "doc_id", "bad"]
    found = picked.orderBy(*shuffled).collect()
    return [({f: r[f] for f in FEATURES}, r["bad"]) for r in found]


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All counts, ``base_failed``, ``rule`` (0: no learned rule rejects) and ``kept`` per document.

    Null or empty texts fail the base rules (under 50 words). Without labelled rows only these apply.
    """
    rules = learn(labelled(docs, labels))
    return (
        statistics(docs)
        .withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns.

    Verdicts are computed next to each row, so nothing is joined by id: repeated ids are judged by
    their own texts.
    """
    rules = learn(labelled(docs, labels))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    good = ~base_failed() & (verdict(rules) == 0)
    return statistics(packed, "_row", "_text").where(good).select("_row.*")
