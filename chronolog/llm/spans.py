"""Words and pre-tokens of many texts at once, as numpy arrays over the texts' code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import tiktoken

LETTER, NUMBER, OTHER, SPACE, BREAK = range(5)
#: Texts are worked on in lots of about this many code points; a longer text is a lot of its own.
LOT = 1 << 19

_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """The class of every code point, as the regular expressions of the tiktoken library see it."""
    global _kinds
    if _kinds is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            # a few thousand at a time: the list of all their bytes would be a worker's largest object
            for first in range(0, 0x110000, 0x1000):
                if not 0xD800 <= first < 0xE000:
                    matched = bytes(library.encode_ordinary("".join(map(chr, range(first, first + 0x1000))))).decode()
                    table[np.frombuffer(matched.encode("utf-32-le"), dtype=np.uint32)] = kind
        _kinds = table
    return _kinds


def lots(texts: list[str], size: int = LOT) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose lengths sum up to ``size`` or little more."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts with one place after each text, and the places after each."""
    joined = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    after = np.cumsum([len(t) + 1 for t in texts]) - 1 if texts else np.zeros(0, dtype=np.int64)
    return joined, after


def pretokens(chars: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the public pattern for byte-level BPE, text by text.

    Runs of one class are matches. White space before another run gives its last blank to it, or is
    split before its last character; an apostrophe alone, not after such a blank, takes one of the endings
    s t re ve m ll d from the letters behind it.
    """
    if not len(chars):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = kinds()[chars]
    kind[after] = BREAK
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate(([0], change))
    end = np.append(start[1:], len(kind))
    of = kind[start]
    # neighbouring breaks of empty texts are one run; they are dropped
    follows = np.append(of[1:] < SPACE, False) & (of == SPACE)
    blank = follows & (chars[end - 1] == 0x20)
    lone = follows & ~blank & (end - start > 1)
    s, e = start.copy(), end.copy()
    e[follows] -= 1
    taken = np.flatnonzero(blank) + 1
    s[taken] -= 1
    # a single white-space character that is no blank stays a match of its own
    single = follows & ~blank & (end - start == 1)
    e[single] += 1
    extra_s, extra_e = end[lone] - 1, end[lone]
    # contractions
    mark = np.flatnonzero((of[:-1] == OTHER) & (e[:-1] - s[:-1] == 1) & (chars[s[:-1]] == 0x27) & (of[1:] == LETTER))
    if len(mark):
        at = s[mark + 1]
        size = e[mark + 1] - at
        one = chars[at]
        two = np.where(size > 1, chars[np.minimum(at + 1, len(chars) - 1)], 0)
        length = np.zeros(len(mark), dtype=np.int64)
        pairs = [(0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)]  # re ve ll
        for a, b in pairs:
            length[(one == a) & (two == b)] = 2
        length[np.isin(one, [0x73, 0x74, 0x6D, 0x64])] = 1  # s t m d
        mark, length = mark[length > 0], length[length > 0]
        e[mark] += length
        s[mark + 1] += length
    keep = (of != BREAK) & (e > s)
    s, e = np.concatenate((s[keep], extra_s)), np.concatenate((e[keep], extra_e))
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def words(chars: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but ASCII white space, text by text."""
    space = (chars == 0x20) | ((chars >= 0x09) & (chars <= 0x0D))
    space[after] = True
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def lowered(chars: np.ndarray) -> np.ndarray:
    """A-Z in lower case, nothing else changed."""
    return np.where((chars >= 0x41) & (chars <= 0x5A), chars + 32, chars).astype(np.uint32)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def distinct(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """A code for each span, and the distinct spans' texts in the order of codes.

    Spans are told apart by hashes of their characters; that equal hashes mean equal spans is then checked
    character by character, and if it does not hold, the spans are compared as strings.
    """
    if not len(start):
        return np.zeros(0, dtype=np.int64), []
    text = chars.astype("<u4").tobytes().decode("utf-32-le")
    with np.errstate(over="ignore"):
        mixed = (chars.astype(np.uint64) + np.uint64(0x7F4A7C15)) * _BASE
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        size = end - start
        owner = np.repeat(np.arange(len(start)), size)
        offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(start, size) + offset
        # each character weighs by its place within the span
        weight = (offset.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _BASE
        weight ^= weight >> np.uint64(31)
        hashed = np.add.reduceat(mixed[place] * (weight | np.uint64(1)), np.cumsum(size) - size)
        hashed += size.astype(np.uint64) * _BASE
    _, first, code = np.unique(hashed, return_index=True, return_inverse=True)
    like = start[first][code]
    if not (np.array_equal(size, size[first][code]) and np.array_equal(chars[place], chars[like[owner] + offset])):
        strings = [text[a:b] for a, b in zip(start.tolist(), end.tolist())]
        seen: dict[str, int] = {}
        return np.array([seen.setdefault(x, len(seen)) for x in strings], dtype=np.int64), list(seen)
    return code, [text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
