"""Pruning of JSON objects at any depth, by expressions over their compact text.

Structural characters inside strings are masked by control characters, which compact JSON does not hold. Then the
innermost objects and lists are rewritten, as often as they are nested: split into members, filtered, and
put back with their own structure masked as well, so that they look like plain values to what holds them. Each
carries its text before pruning along, for places that nothing may be pruned in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STRUCTURE = "{}[],:"
MASK = "\u0003\u0004\u0005\u0006\u000e\u000f"
BACKSLASH, QUOTE = "\u0001", "\u0002"
#: Around a rewritten object or list, and between its pruned and its whole text.
BEGIN, HALF, END = "\u0007", "\u0010", "\u0008"
INNERMOST = r"[\{\[][^\{\}\[\]]*[\}\]]"
EMPTY_OBJECT, EMPTY_LIST = MASK[:2], MASK[2:4]

Drops = Callable[[Column, Column], Column]


def masked(text: Column) -> Column:
    """Compact JSON whose strings hold no structural characters; ``unmasked`` gives it back."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    # every other part between quotes is a string
    parts = F.transform(F.split(plain, '"', -1), lambda p, i: F.when(i % 2 == 1, F.translate(p, STRUCTURE, MASK)).otherwise(p))
    return F.array_join(parts, '"')


def unmasked(text: Column) -> Column:
    shown = F.translate(text, MASK, STRUCTURE)
    return F.replace(F.replace(shown, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))


def scalar_text(value: Column) -> Column:
    """A masked scalar as text: a string without quotes and escapes, others as they are, null as NULL."""
    return F.get_json_object(F.concat(F.lit('{"v":'), unmasked(value), F.lit("}")), "$.v")


def _rewritten(found: Column, drops: Drops, keep_empty: bool) -> Column:
    """An innermost object or list, pruned and whole."""
    is_object = F.startswith(found, F.lit("{"))
    body = F.substr(found, F.lit(2), F.length(found) - 2)
    items = F.when(F.length(found) == 2, F.array().cast("array<string>")).otherwise(F.split(body, ",", -1))

    def member(item: Column) -> Column:
        key = F.when(is_object, F.substring_index(item, ":", 1)).otherwise("")
        value = F.when(is_object, F.substr(item, F.length(F.substring_index(item, ":", 1)) + 2)).otherwise(item)
        return F.struct(key.alias("key"), value.alias("value"))

    def halves(m: Column) -> Column:
        nested = F.startswith(m["value"], F.lit(BEGIN))
        half = lambda i: F.when(nested, F.get(F.split(F.translate(m["value"], BEGIN + END, ""), HALF), F.lit(i))).otherwise(m["value"])
        pruned, whole = half(0), half(1)
        # lists inside lists stay as they are
        pruned = F.when(~is_object & F.startswith(whole, F.lit(MASK[2])), whole).otherwise(pruned)
        return F.struct(m["key"].alias("key"), pruned.alias("pruned"), whole.alias("whole"))

    def stays(m: Column) -> Column:
        dropped = is_object & F.coalesce(drops(m["key"], m["whole"]), F.lit(False))
        if keep_empty:
            return ~dropped
        return ~dropped & (m["pruned"] != EMPTY_OBJECT) & ~(is_object & (m["pruned"] == EMPTY_LIST))

    def text(members: Column, half: str) -> Column:
        shown = F.transform(members, lambda m: F.when(is_object, F.concat(m["key"], F.lit(MASK[5]), m[half])).otherwise(m[half]))
        joined = F.array_join(shown, MASK[4])
        return F.concat(F.when(is_object, MASK[0]).otherwise(MASK[2]), joined, F.when(is_object, MASK[1]).otherwise(MASK[3]))

    def both(members: Column) -> Column:
        return F.concat(F.lit(BEGIN), text(F.filter(members, stays), "pruned"), F.lit(HALF), text(members, "whole"), F.lit(END))

    members = F.transform(F.transform(items, member), halves)
    return F.get(F.transform(F.array(members), both), F.lit(0))


def pruned_json(text: Column, drops: Drops, keep_empty: bool = False) -> Column:
    """A compact JSON object without the members that ``drops(key, value)`` tells, and without what that leaves empty.

    ``key`` is quoted and masked, ``value`` masked; objects and lists are no scalars that ``scalar_text`` reads. Members are
    looked at in every object but those in lists inside lists, which stay as they are. With ``keep_empty`` objects and
    lists stay where they are or become empty. A text that is NULL gives NULL.
    """

    def round_(t: Column, _: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(INNERMOST), 0), lambda x: _rewritten(x, drops, keep_empty))
        between = F.split(t, INNERMOST, -1)
        joined = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(F.startswith(t, F.lit(BEGIN)), t).otherwise(F.array_join(joined, ""))

    # no deeper than there are opening brackets; rounds after the last change nothing
    rounds = F.sequence(F.lit(1), F.length(text) - F.length(F.translate(text, "{[", "")))
    done = F.aggregate(rounds, masked(text), round_)
    return unmasked(F.substr(F.substring_index(done, HALF, 1), F.lit(2)))
