"""Texts of an Arrow batch as one array of code points, with class tables over Unicode.

The operators that look at characters work on whole batches with numpy: no Python code runs per
character or per word.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

N_CLASSES = 64
#: Letters with their own class; others are folded or share the class of other letters.
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýß"
OTHER_LETTER, HAN, SKIP = 62, 63, 255

# Letters of other scripts that look like Latin ones.
LOOKALIKE_FROM = "аеорсухіѕјһԁԛԝүАВЕКМНОРСТХІЅЈԚԜҮοΑΒΕΖΗΙΚΜΝΟΡΤΥΧνӓӧёїӘӐӑ"
LOOKALIKE_TO = "aeopcyxisjhdqwyABEKMHOPCTXISJQWYoABEZHIKMNOPTYXväöëïƏĂă"

# Characters without any visible form.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯ㅤ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿ﾠ"


#: Tables reach up to here; beyond lie rare Chinese characters and, at _OTHER, all the rest.
_TOP, _RARE_HAN, _OTHER = 0x20000, 0x20000, 0x20001
_SIZE = _TOP + 2


def look_up(values: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Table value of each code point."""
    if len(points) and points.max() >= _TOP:
        points = np.where(points < _TOP, points, np.where(points < 0x323B0, _RARE_HAN, _OTHER))
    return values[points]


def lower(points: np.ndarray) -> np.ndarray:
    """Lower-case code points, one for one."""
    low = look_up(_lower(), points)
    return np.where(points < _TOP, low, points).astype(np.uint32) if len(points) and points.max() >= _TOP else low


@cache
def _lower() -> np.ndarray:
    return np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(_SIZE)], np.uint32)


@cache
def alnum() -> np.ndarray:
    """Letters and digits."""
    out = np.array([chr(c).isalnum() for c in range(_SIZE)])
    out[[_RARE_HAN, _OTHER]] = True, False
    return out


@cache
def han() -> np.ndarray:
    """Chinese characters."""
    out = np.zeros(_SIZE, bool)
    for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x2E80, 0x2FDF)):
        out[a : b + 1] = True
    out[_RARE_HAN] = True
    return out


@cache
def kinds() -> np.ndarray:
    """Class for histograms: lower, upper, digit, space, mark of punctuation, Chinese, other letter, other."""
    names = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Zl": 3, "Zp": 3, "Lo": 6, "Lm": 6}
    out = np.full(_SIZE, 7, np.uint8)
    for c in range(_TOP):
        cat = unicodedata.category(chr(c))
        if cat in names:
            out[c] = names[cat]
        elif cat[0] in "PS":
            out[c] = 4
    out[[9, 10, 11, 12, 13]] = 3
    out[han()] = 5
    return out


@cache
def letters() -> np.ndarray:
    """Class of each code point for letter n-grams: 0 between words, then letters; SKIP has no class.

    Width, case, look-alikes and composition make no difference.
    """
    out = np.zeros(_SIZE, np.uint8)
    looks = dict(zip(LOOKALIKE_FROM, LOOKALIKE_TO))
    for c in range(_TOP):
        ch = chr(c)
        if ch.isalpha():
            if c > 127:
                ch = unicodedata.normalize("NFKC", looks.get(ch, ch))
            folded = ch.lower()[:1]
            at = _LETTERS.find(looks.get(folded, folded))
            out[c] = at + 1 if at >= 0 else OTHER_LETTER
        elif c > 127 and (unicodedata.category(ch) in ("Mn", "Me", "Cf") or ch in INVISIBLE):
            out[c] = SKIP
    out[han()] = HAN
    return out


def slices(texts: list[str], chars: int = 1 << 18):
    """Ranges of texts of about so many characters together, so that arrays stay in cache and memory bounded."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offsets of the texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([0, *map(len, texts)])


def owners(offsets: np.ndarray) -> np.ndarray:
    """Number of the text of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        a, b = np.full(n, _BASE), np.full(n, _INVERSE)
        a[0] = b[0] = 1
        return np.multiply.accumulate(a), np.multiply.accumulate(b)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the code points of each span; equal spans have equal hashes."""
    n = 1 << max(10, int(len(points)).bit_length())
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * up[: len(points)], dtype=np.uint64)])
        h = (total[ends] - total[starts]) * down[starts]
        return h ^ (h >> np.uint64(29))


def words(points: np.ndarray, offsets: np.ndarray, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits; texts marked ``single`` give one run per character."""
    ok = look_up(alnum(), points)
    first = np.zeros(len(points) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], ok[:-1]]) if len(ok) else ok
    alone = single[owners(offsets)] if single is not None else False
    start = ok & (~before | first[:-1] | alone)
    starts = np.flatnonzero(start)
    after = np.concatenate([ok[1:], [False]]) if len(ok) else ok
    end = ok & (~after | first[1:] | alone)
    return starts, np.flatnonzero(end) + 1
