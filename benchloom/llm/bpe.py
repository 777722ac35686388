"""Byte-level BPE over a minimal acyclic transducer of frequent words.

The pre-tokens that a bounded sample shows to be frequent are compiled, with their ids as
outputs, into a minimal acyclic automaton: states with equal right languages are shared, and
the number of words passed on the way to a state addresses its row of outputs. Spark's file
server takes the arrays to every executor, whatever the file system of the cluster, and the
Python workers map them into memory. A pre-token that the automaton doesn't hold is divided at
borders which no token of the vocabulary spans, the parts are looked up, and what is still
unseen is merged exactly by rank, so the sample decides the speed and never the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import mmap
import os
import re
import sys
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np

#: Folder with the public vocabularies; a parameter of every query that encodes.
TOKENIZERS = os.environ.get("BENCHLOOM_TOKENIZERS", "/opt/tokenizers")

# The published pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same pattern for the standard engine. \w there also takes the numbers outside \d, and \s
#: the separators 1c to 1f: texts with such characters go through the general engine.
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _ranges(chars: Iterable[int]) -> str:
    out: list[list[int]] = []
    for c in chars:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


_state: dict = {}


def _special() -> re.Pattern:
    if "special" not in _state:
        odd = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")]
        _state["special"] = re.compile(f"[\x1c-\x1f{_ranges(odd)}]")
        import regex

        _state["general"] = regex.compile(PATTERN)
    return _state["special"]


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; joined they give the text again."""
    if _special().search(text):
        return _state["general"].findall(text)
    return _FAST.findall(text)


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, as published."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """Exact merging of one pre-token by rank: the pair of lowest rank first, the left one of equals."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        inside = {(a, b) for t in ranks for a, b in zip(t, t[1:])}
        self.units = self._units(inside)

    @staticmethod
    def _units(inside: set[tuple[int, int]]) -> re.Pattern:
        """Pattern of the parts of a run of Chinese characters between proven borders.

        Between two characters lies a border when no token holds the last byte of the one before the first
        byte of the other: nothing is ever merged across it. The few characters whose last byte some token
        continues stay with a following character that begins so.
        """
        leads: dict[int, list[int]] = {}
        for a, b in inside:
            if 0x80 <= a < 0xC0 and 0xE3 <= b <= 0xE9:
                leads.setdefault(a, []).append(b)
        run = range(0x3400, 0xA000)
        by_lead: dict[int, list[int]] = {}
        by_last: dict[int, list[int]] = {}
        for c in run:
            raw = chr(c).encode()
            by_lead.setdefault(raw[0], []).append(c)
            by_last.setdefault(raw[-1], []).append(c)
        joined = [f"[{_ranges(by_last[a])}](?=[{''.join(_ranges(by_lead[b]) for b in sorted(bs) if b in by_lead)}])" for a, bs in sorted(leads.items()) if any(b in by_lead for b in bs)]
        chinese = "\u3400-\u9fff"
        return re.compile(f"(?:{'|'.join(joined) or '(?!)'})*[{chinese}]")

    def __call__(self, word: bytes) -> array:
        ranks = self.ranks
        if word in ranks:
            return array("i", [ranks[word]])
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 64:
            return self._long(parts)
        none = len(ranks) + (1 << 30)
        cost = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while cost:
            low = min(cost)
            if low == none:
                break
            i = cost.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del cost[i]
            if i:
                cost[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(cost):
                cost[i] = ranks.get(parts[i] + parts[i + 1], none)
        return array("i", [ranks[p] for p in parts])

    def _long(self, parts: list) -> array:
        """The same by a heap over linked parts, for runs of any length."""
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, token = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != token:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = token, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := ranks.get(parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left] + parts[right]))
        return array("i", [ranks[p] for p in parts if p is not None])


def merger(name: str, folder: str) -> Merger:
    """The merger of a published vocabulary, one per process."""
    key = (name, folder)
    if key not in _state:
        _state[key] = Merger(ranks(f"{folder}/{name}.tiktoken"))
    return _state[key]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic transducer of ``words`` as one block of bytes.

    Words come in byte order, so a state is complete once the common prefix with the next word
    is shorter than its depth; it is then replaced by an equal registered state, if any.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...))

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    labels: list[int] = []
    outputs: list[list[int]] = []
    for word in sorted(words):
        shared = 0
        while shared < min(len(labels), len(word)) and labels[shared] == word[shared]:
            shared += 1
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][1].append((labels.pop(), freeze(node)))
        for b in word[shared:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
        outputs.append(words[word])
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((labels.pop(), freeze(node)))
    root = freeze(path[0])

    below = [0] * len(states)  # targets are frozen before their sources
    arc_label, arc_target, arc_skip = bytearray(), [], []
    first = [0]
    for i, (final, arcs) in enumerate(states):
        passed = int(final)
        for label, target in arcs:
            arc_label.append(label)
            arc_target.append(target)
            arc_skip.append(passed)
            passed += below[target]
        below[i] = passed
        first.append(len(arc_label))
    ends = np.cumsum([0, *map(len, outputs)])
    parts = [
        np.array([root], np.int32),
        np.array(first, np.int32),
        np.array([f for f, _ in states], np.uint8),
        np.array(arc_target, np.int32),
        np.array(arc_skip, np.int32),
        np.frombuffer(bytes(arc_label), np.uint8),
        np.array(ends, np.int32),
        np.array([x for o in outputs for x in o], np.int32),
    ]
    sizes = np.array([len(p) for p in parts], np.int64)
    body = b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)
    return sizes.tobytes() + body


class Lexicon:
    """A compiled lexicon over any buffer, a memory map as well as bytes."""

    def __init__(self, buffer) -> None:
        sizes = np.frombuffer(buffer, np.int64, 8)
        at, parts = 64, []
        for n, kind in zip(sizes, (np.int32, np.int32, np.uint8, np.int32, np.int32, np.uint8, np.int32, np.int32)):
            part = np.frombuffer(buffer, kind, int(n), at)
            parts.append(part)
            at += part.nbytes + -part.nbytes % 8
        root, first, final, target, skip, label, ends, ids = parts
        self.root = int(root[0])
        self.first, self.final, self.target, self.skip = (memoryview(x) for x in (first, final, target, skip))
        self.label, self.ends, self.ids = label.tobytes(), memoryview(ends), ids

    def get(self, word: bytes) -> bytes | None:
        """Ids of a word as bytes of int32, or None when it isn't in the lexicon."""
        s, passed = self.root, 0
        for b in word:
            a = self.label.find(b, self.first[s], self.first[s + 1])
            if a < 0:
                return None
            passed += self.skip[a]
            s = self.target[a]
        if not self.final[s]:
            return None
        return self.ids[self.ends[passed] : self.ends[passed + 1]].tobytes()

    def __len__(self) -> int:
        return len(self.ends) - 1


#: A run of Chinese characters; it is divided on its own only where it is a whole pre-token.
_CHINESE = re.compile("[\u3400-\u9fff]{2,}")


def parts_of(word: str, units: re.Pattern) -> list[str]:
    """Parts of a pre-token that are encoded one by one: Chinese ones between proven borders, others whole."""
    return units.findall(word) if _CHINESE.fullmatch(word) else [word]


def build_lexicon(texts: Iterable[str], name: str, folder: str, size: int = 30_000) -> bytes:
    """Lexicon of the ``size`` most frequent parts of pre-tokens of the given texts (at least twice)."""
    merge = merger(name, folder)
    count: Counter = Counter()
    for t in texts:
        if t:
            count.update(pretokens(t))
    parts: Counter = Counter()
    for w, n in count.items():
        for p in parts_of(w, merge.units):
            parts[p] += n
    return compile_lexicon({w.encode(): merge(w.encode()).tolist() for w, n in parts.most_common(size) if n > 1})


class Published:
    """Handle of a lexicon: only its name travels with the tasks, the arrays are mapped from the file that Spark brought."""

    def __init__(self, spark, blob: bytes, name: str, folder: str) -> None:
        self.name, self.folder = name, folder
        self.file = f"lexicon-{hashlib.blake2b(blob, digest_size=8).hexdigest()}.bin"
        key = ("published", spark.sparkContext.applicationId, self.file)
        if key not in _state:  # the driver's copy, from which the file server serves executors, also later ones
            path = os.path.join(tempfile.mkdtemp(prefix="benchloom-lexicon-"), self.file)
            with open(path, "wb") as f:
                f.write(blob)
            spark.sparkContext.addFile(path)
            _state[key] = path

    def open(self) -> "Encoder":
        key = ("encoder", self.name, self.folder, self.file)
        if key not in _state:
            from pyspark import SparkFiles

            with open(SparkFiles.get(self.file), "rb") as f:
                buffer = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            _state[key] = Encoder(Lexicon(buffer), merger(self.name, self.folder))
        return _state[key]


#: Pieces at whose borders no pre-token crosses: white space is split as in PATTERN, and a word
#: takes at most one blank before it. Every piece is a whole number of pre-tokens.
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters up to which a string is remembered; longer ones go the same way and hardly ever come again.
_REMEMBERED = 64


class Encoder:
    """Text to ids: every pre-token goes to the lexicon, what it doesn't hold is divided at proven borders and merged by rank.

    The tables of recent strings are only there for speed and are emptied when full.
    """

    def __init__(self, lexicon: Lexicon, merge: Merger, recent: int = 200_000) -> None:
        def encode(word: str) -> bytes:
            raw = word.encode()
            got = lexicon.get(raw)
            if got is None:
                parts = parts_of(word, merge.units)
                got = merge(raw).tobytes() if len(parts) == 1 else b"".join(map(known, parts))
            return got

        class Recent(dict):
            def __init__(self, make: Callable[[str], bytes]) -> None:
                self.make = make

            def __missing__(self, key: str) -> bytes:
                got = self.make(key)
                if len(key) <= _REMEMBERED:
                    if len(self) > recent:
                        self.clear()
                    self[key] = got
                return got

        known = Recent(encode).__getitem__
        self.lexicon, self._word = lexicon, known
        self._piece = Recent(lambda piece: b"".join(map(known, pretokens(piece)))).__getitem__

    def ids(self, text: str | None) -> bytes:
        """Ids of a text as bytes of int32; none for empty and null texts."""
        if not text:
            return b""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return b"".join(map(self._word, pretokens(text)))
        return b"".join(map(self._piece, _PIECE.findall(text)))

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        return len(self.ids(text)) >> 2
