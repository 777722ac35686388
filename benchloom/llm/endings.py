"""Likelihood that a text may end where it ends, from the n-grams before it.

Counted over all texts: for every n-gram, how often a sentence or a step of a list ends right after it.
Words that few texts hold (names) share one class. A text is judged by its longest known n-gram. Only
the n-grams at the ends of texts in question are needed, so these are gathered first, and of all others
none leaves its task; the counts meet the texts in question in a join and never come to the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

_TOKEN = re.compile(r"[㐀-鿿豈-﫿]|\d+(?:[.,]\d+)*|[^\W\d_]+|[^\w\s]")
_STOPS = frozenset(".!?。！？;；")
_ORDERS = (1, 2, 3, 4, 5, 7, 11)
_WORD_ORDERS = 6  # of these, for texts in words; the last is for Chinese characters only
RARE = "\0"
_STOP = "."  # every mark that ends a sentence, and the beginning of a text
#: Any word, after so many known ones: where a name or substance stands, the words before it decide.
ANY, _MASKED = "\x01", 3
#: Texts that must hold a word or an n-gram before it is known.
LEAST = 3
#: Share of the texts that must hold a word before it has a class of its own: the classes are the same at any scale.
COMMON_SHARE = 1 / 2500
#: Words of a phrase that many texts end in without a stop, as lists do; after fewer words they may have been cut by chance.
STOCK = 3
#: Bits of the table that tells which n-grams are needed, and characters that are counted at once.
_BITS, _CHARACTERS = 27, 1_000_000
#: Orders under which the masked n-gram and the last word itself are looked up.
MASKED, WORD = 0, -1

#: Marks of omission.
OMISSION = re.compile(r"(?:\.{3,}|…|\[\s*(?:\.{2,}|…)\s*\])\s*$")
#: An entity, tag or escape that broke off, or a character that was cut in its bytes.
BROKEN = re.compile(r"(?:&(?:#x?[0-9A-Fa-f]*|[A-Za-z]{0,8})|&amp;?(?:#x?[0-9A-Fa-f]*)?|<[/!]?[A-Za-z]{0,10}|\\(?:u[0-9A-Fa-f]{0,4}|x[0-9A-Fa-f]{0,2})?|�)\s*$")
_LABEL = re.compile(r"(?:\([a-zA-Z0-9]{0,3}\)?|[,:;，：；、(（\[/–—„“«‘-])\s*$")
_CLOSERS = "\"”“»’')）]】」》 \t\r\n\xa0"
_PAIRS = {")": "(", "）": "（", "]": "[", "”": "“", "»": "«"}

# Abbreviations that can't end a sentence, lower-case, without their full stop.
ABBREVIATIONS = frozenset(
    "fig figs e.g i.e approx ca no nos vol wt resp incl max min temp eq eqn cf vs al "
    "abb z.b z. b d.h bzw vgl nr sog evtl ggf u.a "
    "env p.ex ex c.-à-d n° éq "
    "p.ej ej aprox núm pág "
    "p.es circa pag".split()
)


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers as 0, Chinese characters and marks one by one."""
    return ["0" if t[0].isdigit() else t.lower() for t in _TOKEN.findall(text)]


def _inner(text: str) -> tuple[list[str], bool]:
    """Tokens of a text before a mark of omission or broken escape, and whether it had one."""
    body = BROKEN.sub("", OMISSION.sub("", text))
    return tokens(body), body != text


def held_words(texts: list[str]) -> tuple[Counter, Counter]:
    """Number of texts that hold each word, and of those that end in it without a stop, where it may be a part of a word."""
    held: Counter = Counter()
    last: Counter = Counter()
    for t in texts:
        x, broken = _inner(t)
        held.update(set(x[:-1]))
        if x and not broken:
            last[x[-1]] += 1
    return held, last


class Vocabulary:
    """Words with a class of their own, which ``common`` texts hold or end in, and the endings of the others."""

    def __init__(self, words: list[str], endings: dict[str, int], common: int) -> None:
        self.words, self.ordered, self.common = frozenset(words), sorted(words), common
        every = sum(endings.values())
        self.name_endings = frozenset(e for e, n in endings.items() if n >= max(2, 0.03 * every))

    def known_as(self, word: str) -> str:
        return _STOP if word in _STOPS else word if word in self.words or not word.isalpha() else RARE

    def begins_longer(self, word: str) -> bool:
        """Whether a longer word begins with this one."""
        k = bisect_right(self.ordered, word)
        return k < len(self.ordered) and self.ordered[k].startswith(word)


def common_from(n_texts: int) -> int:
    """Number of texts that must hold a word before it has a class of its own."""
    return max(LEAST, math.ceil(COMMON_SHARE * n_texts))


def _code(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


_ANY_CODE, _WORD_CODE = np.uint64(_code(ANY)), np.uint64(_code("\x02"))


class Grams:
    """Keys of the n-grams of texts: hashes of the classes of their words, from the last one back."""

    STOP, ALPHA, HAN, SINGLE, SHORT, DEGREE = (1 << k for k in range(6))

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.ids: dict[str, int] = {}
        self.codes: list[int] = []
        self.raws: list[int] = []
        self.kinds: list[int] = []

    def _id(self, w: str) -> int:
        got = self.ids.get(w)
        if got is None:
            got = self.ids[w] = len(self.codes)
            name = self.vocabulary.known_as(w)
            self.codes.append(_code(name))
            self.raws.append(_code(w))
            single = len(w) == 1 and w.isascii() and w.isalpha()
            flags = (name in _STOPS, name.isalpha(), "㐀" <= w <= "鿿", single, w in ABBREVIATIONS, w == "°")
            self.kinds.append(sum(1 << k for k, f in enumerate(flags) if f))
        return got

    def laid_out(self, lists: list[list[str]]) -> tuple[np.ndarray, ...]:
        """(class code, word code, kind, place, text) of the tokens of several texts."""
        if len(self.ids) > 1 << 20:
            self.ids, self.codes, self.raws, self.kinds = {}, [], [], []
        at = np.array([self._id(w) for x in lists for w in x], np.int64)
        n = np.array([len(x) for x in lists], np.int64)
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        take = lambda v, kind: np.array(v, kind)[at] if len(at) else np.zeros(0, kind)
        return take(self.codes, np.uint64), take(self.raws, np.uint64), take(self.kinds, np.uint8), place, np.repeat(np.arange(len(lists)), n)

    def keys(self, code: np.ndarray, kind: np.ndarray, place: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, indexes into ``at``, keys) of the n-grams that end at the places ``at``."""
        key, of = np.zeros(len(at), np.uint64), np.arange(len(at))
        for k in range(1, _ORDERS[-1] + 1):
            fit = place[at[of]] >= k - 1
            if k == _ORDERS[_WORD_ORDERS - 1] + 1:
                fit &= (kind[at[of]] & self.HAN) > 0
            of, key = of[fit], key[fit]
            if not len(of):
                break
            key = _mixed(key ^ code[at[of] - (k - 1)])
            if k in _ORDERS:
                yield k, of, key
        of = np.flatnonzero((place[at] >= _MASKED) & ((kind[at] & self.ALPHA) > 0))
        if len(of):
            key = _mixed(np.full(len(of), _ANY_CODE))
            for k in range(1, _MASKED + 1):
                key = _mixed(key ^ code[at[of] - k])
            yield MASKED, of, key

    def counts(self, texts: list[str], needed: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """(key, times seen, ends after it, texts that end there without a stop) of the n-grams of texts."""
        lists, whole = [], []
        for t in texts:
            x, broken = _inner(t)
            lists.append([_STOP, *x])
            whole.append(not broken)
        code, raw, kind, place, text = self.laid_out(lists)
        if not len(code):
            return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        of_text = np.append(text[1:] != text[:-1], True)
        stop = (kind & self.STOP) > 0
        before = np.concatenate([[0], kind[:-1]])
        end = ~of_text & np.append(stop[1:], False) & ~(((kind & self.SINGLE) > 0) & ((before & self.DEGREE) == 0)) & ((kind & self.SHORT) == 0)
        at = np.flatnonzero(~stop & (~of_text | np.array(whole)[text]))
        found = []
        for _, of, key in self.keys(code, kind, place, at):
            if needed is not None:
                hit = needed(key)
                of, key = of[hit], key[hit]
            found.append((key, end[at[of]], of_text[at[of]]))
        # words themselves, once a text; the last token may be a part of a word
        inside = np.flatnonzero(~of_text & ((kind & self.STOP) == 0))
        key = _mixed(raw[inside] ^ _WORD_CODE)
        if needed is not None:
            hit = needed(key)
            inside, key = inside[hit], key[hit]
        once = np.unique(np.stack([text[inside].astype(np.uint64), key]), axis=1)[1]
        found.append((once, np.zeros(len(once), bool), np.zeros(len(once), bool)))
        key, inverse = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        tally = lambda k: np.bincount(inverse, None if k is None else np.concatenate([x[k] for x in found]), len(key)).astype(np.int64)
        return key, tally(None), tally(1), tally(2)


def end_share(order: int, seen: int, ends: int, last: int, common: int) -> float | None:
    """Share of ends after an n-gram, None for one that isn't known.

    A text may have been cut, so an end without a stop is no evidence, nor an occurrence of the n-gram, unless
    as many texts as hold a common word end in the same phrase.
    """
    if order < STOCK or last < common:
        seen, last = seen - last, 0
    return (ends + last) / seen if seen >= LEAST else None


@dataclass
class Open:
    """What the n-grams at its end must decide about a text."""

    rule: str
    part: bool = False  # a part of a word, unless other texts hold the last word
    long: bool = False
    longer: bool = False  # the last word is the beginning of a known one
    words: list[str] = field(default_factory=list)

    def is_cut(self, share: dict[int, float], least: float) -> bool:
        """Verdict from the shares of ends by order of the n-gram."""
        if self.part and WORD not in share:
            return True
        if self.rule == "value":
            return False
        p, k = self.likelihood(share)
        return (k >= 2 and p < 0.02) if self.rule == "number" else (p < least or (k == 1 and p < 0.9 and self.long))

    def likelihood(self, share: dict[int, float]) -> tuple[float, int]:
        """Share of ends after the longest known n-gram at the end of a text, and its length."""
        x = self.words
        k = max((k for k in share if k > 0), default=0)
        p = share.get(k, 0.0) if k else 0.0
        if k <= 2 and (p > 0 or k < 2) and len(x) > _MASKED and x[-1].isalpha():
            if k < 2 and self.longer:
                return 0.0, k  # never seen in this place, and the beginning of a known word
            if share.get(MASKED, 0.0) > p:
                return share[MASKED], _MASKED + 1
        return p, k


def _tail(vocabulary: Vocabulary, text: str) -> list[str]:
    """The last words of a text that n-grams can reach."""
    x = tokens(text[-240:])
    while x and x[-1] in _STOPS:
        x.pop()
    if len(text) <= 240:
        x = [_STOP, *x]
    return [vocabulary.known_as(w) for w in x[-_ORDERS[-1] :]]


def _last_word(text: str) -> str:
    m = re.search(r"[^\W\d_]+$", text)
    return m[0].lower() if m and not "㐀" <= text[-1] <= "鿿" else ""


class EndingModel:
    """End likelihoods of the n-grams of texts that fit in memory."""

    def __init__(self, texts: list[str]) -> None:
        texts = [t for t in texts if t]
        (held, last), least = held_words(texts), common_from(len(texts))
        words = {w for c in (held, last) for w, n in c.items() if n >= least}
        self.vocabulary = Vocabulary([*words], Counter(w[-2:] for w in held if w not in words and w.isalpha()), least)
        self.counts = {k: n for k, *n in zip(*(v.tolist() for v in Grams(self.vocabulary).counts(texts)))}

    def shares(self, text: Open, word: str) -> dict[int, float]:
        orders, keys = look_ups(Grams(self.vocabulary), [text], [word])
        got = {o: self.counts.get(k % (1 << 64)) for o, k in zip(orders[0], keys[0])}
        return {o: p for o, n in got.items() if n and (p := end_share(o, *n, self.vocabulary.common)) is not None}


def look_ups(counter: Grams, found: list[Open], words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
    """Orders and keys (as signed integers) that decide about texts; ``words`` are their last words."""
    orders: list[list[int]] = [[] for _ in found]
    keys: list[list[int]] = [[] for _ in found]
    code, _, kind, place, _ = counter.laid_out([x.words for x in found])
    n = np.array([len(x.words) for x in found], np.int64)
    some = np.flatnonzero(n)
    for k, of, key in counter.keys(code, kind, place, np.cumsum(n)[some] - 1):
        for i, v in zip(some[of].tolist(), key.view(np.int64).tolist()):
            orders[i].append(k)
            keys[i].append(v)
    for i, (x, w) in enumerate(zip(found, words)):
        if x.part and w:
            orders[i].append(WORD)
            keys[i].append(int(_mixed(np.array([_code(w)], np.uint64) ^ _WORD_CODE).view(np.int64)[0]))
    return orders, keys


# ---------------------------------------------------------------- all texts of a table


def vocabulary(texts: DataFrame) -> Vocabulary:
    """Vocabulary of all rows of ``texts`` (text): bounded, as each of its words is in a share of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b.column(0).to_pylist()):
                held, last = held_words(part)
                words = [*held.keys() | last.keys()]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (held, last)), pa.array([w.isalpha() for w in words], pa.bool_())], names=["word", "held", "last", "alpha"])

    least = common_from(texts.count())
    counts = cut_lineage(texts.mapInArrow(run, "word string, held bigint, last bigint, alpha boolean").groupBy("word", "alpha").agg(F.sum("held").alias("held"), F.sum("last").alias("last")))
    common = F.greatest("held", "last") >= least
    endings = counts.where(F.col("alpha") & ~common & (F.col("held") > 0)).groupBy(F.expr("right(word, 2)").alias("e")).count().collect()
    return Vocabulary([r.word for r in counts.where(common).select("word").collect()], {r["e"]: r["count"] for r in endings}, least)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= _CHARACTERS:
            yield part
            part, size = [], 0
    if part:
        yield part


OPEN = "cut boolean, least double, rule string, part boolean, long boolean, longer boolean, alpha boolean, orders array<int>, keys array<bigint>"
OPEN_NAMES = [c.split()[0] for c in OPEN.split(", ")]


def open_rows(counter: Grams, found: list[tuple[bool | Open, str, float]]) -> list[pa.Array]:
    """Arrow columns OPEN of verdicts: (verdict or what must decide, last word, least share of ends)."""
    opens = [x if isinstance(x, Open) else Open("") for x, _, _ in found]
    orders, keys = look_ups(counter, opens, [w for _, w, _ in found])
    return [
        pa.array([not isinstance(x, Open) and x for x, _, _ in found], pa.bool_()),
        pa.array([v for _, _, v in found], pa.float64()),
        pa.array([x.rule for x in opens], pa.string()),
        pa.array([x.part for x in opens], pa.bool_()),
        pa.array([x.long for x in opens], pa.bool_()),
        pa.array([x.longer for x in opens], pa.bool_()),
        pa.array([len(x.words) > _MASKED and x.words[-1].isalpha() for x in opens], pa.bool_()),
        pa.array(orders, pa.list_(pa.int32())),
        pa.array(keys, pa.list_(pa.int64())),
    ]


def decided(texts: DataFrame, known: Vocabulary, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(columns) of the cut ones of ``rows`` (columns, OPEN), by the n-grams of all rows of ``texts`` (text)."""
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    asked = rows.where("not cut").select("_row", F.explode(F.arrays_zip("orders", "keys")).alias("x")).select("_row", "x.orders", F.col("x.keys").alias("key"))
    bit = F.col("key").bitwiseAND(F.lit((1 << _BITS) - 1))
    table = asked.select((bit / 64).cast("bigint").alias("at"), F.expr("shiftleft(1L, cast(key & 63L as int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    at, bits = table.column("at").to_numpy(), table.column("bits").to_numpy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = np.zeros(1 << (_BITS - 6), np.uint64)
        need[at] = bits.astype(np.int64).view(np.uint64)
        low, one = np.uint64((1 << _BITS) - 1), np.uint64(1)
        needed = lambda key: (need[((key & low) >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63)) & one) > 0
        counter = Grams(known)
        for b in batches:
            for part in _parts(b.column(0).to_pylist()):
                key, *n = counter.counts(part, needed)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(v) for v in n)], names=["key", "seen", "ends", "last"])

    counts = texts.select("text").mapInArrow(count, "key bigint, seen bigint, ends bigint, last bigint").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("seen", "ends", "last")])
    by_row = asked.join(counts.where(F.col("seen") >= LEAST), "key").groupBy("_row").agg(F.collect_list(F.struct("orders", "seen", "ends", "last")).alias("found"))
    wide = rows.join(by_row, "_row", "left").where("cut or rule != ''")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, r in enumerate(b.select([*OPEN_NAMES, "found"]).to_pylist()):
                x = Open(r["rule"], r["part"], r["long"], r["longer"], ["a"] * (_MASKED + 1) if r["alpha"] else [])
                if r["cut"] or x.is_cut({f["orders"]: p for f in r["found"] or () if (p := end_share(*f.values(), known.common)) is not None}, r["least"]):
                    keep.append(i)
            yield b.select(columns).take(pa.array(keep, pa.int64()))

    return wide.mapInArrow(decide, rows.select(columns).schema)


#: Marks of asides, and characters that an open one at the end of a text may have behind it; an older one is a slip.
_ASIDES, OPEN_SPAN = re.compile("[(（\\[„«“)）\\]”»]"), 400


def _open_bracket(text: str) -> bool:
    """Whether a bracket or quotation mark near the end was opened and not closed; the marks of the whole text are followed."""
    stack: list[tuple[str, int]] = []
    for m in _ASIDES.finditer(text):
        at, ch = m.start(), m[0]
        if ch in "(（[„«" or (ch == "“" and not any(c == "„" for c, _ in stack)):
            stack.append((ch, at))
        elif ch in ")）]“”»":
            opens = {"“": "„", "”": "“„"}.get(ch) or _PAIRS[ch]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in opens:
                    del stack[k:]
                    break
    return any(at >= len(text) - OPEN_SPAN for _, at in stack)


def abbreviated(text: str) -> bool:
    """Whether a text ends in an abbreviation that something must follow."""
    m = re.search(r"((?:[^\W\d_]{1,3}\.[- ]?){0,2}[^\W\d_°]{1,7})\.$", text)
    if not m:
        return False
    word = m[1].lower()
    return word in ABBREVIATIONS or word.rpartition(" ")[2] in ABBREVIATIONS or word.replace(" ", "") in ABBREVIATIONS


def verdict(known: Vocabulary, text: str, around: str = "") -> tuple[bool | Open, str]:
    """Whether the text stops in the middle of a word, sentence or list, or a mark of omission ends it, or
    what must decide so; and its last word.

    A whole text that only lacks its full stop, or that ends with white space or with a list, isn't cut.
    """
    if OMISSION.search(text) or BROKEN.search(text):
        return True, ""
    body = text.rstrip()
    if not body:
        return False, ""
    if body[-1] in ".!?。！？":
        if abbreviated(body):
            return True, ""
        if body[-1] == "." and len(body) > 1 and body[-2].isdigit():
            return _open("number", known, body), ""
        return False, ""
    if _LABEL.search(body) or _open_bracket(body):
        return True, ""
    bare = body.rstrip(_CLOSERS)
    if bare != body and re.search(r"[.!?。！？]$", bare):
        return False, ""
    if bare != body:  # an aside at the end: what stands before it counts
        for close, opens in ((")", "("), ("）", "（"), ("”", "“"), ("“", "„"), ("»", "«")):
            if body[-1] == close and opens in body:
                bare = body[: body.rfind(opens)].rstrip()
                break
    if not bare:
        return False, ""
    word = _last_word(bare)
    out = _open("words", known, bare)
    out.part = part_of_word(known, word, around)
    return out, word


def _open(rule: str, known: Vocabulary, text: str) -> Open:
    x = _tail(known, text)
    return Open(rule, long=len(text) > 20, longer=bool(x) and x[-1].isalpha() and known.begins_longer(x[-1]), words=x)


def part_of_word(known: Vocabulary, word: str, around: str) -> bool:
    """Whether a last word that no other text holds is the beginning of a longer one."""
    if not word or word in known.words:
        return False
    return any(w != word and w.startswith(word) for w in set(tokens(around))) or word[-2:] not in known.name_endings


def is_cut(model: EndingModel, text: str, around: str = "", least: float = 0.25) -> bool:
    """Verdict on a text by the n-grams of a model in memory."""
    got, word = verdict(model.vocabulary, text, around)
    return got.is_cut(model.shares(got, word), least) if isinstance(got, Open) else got
