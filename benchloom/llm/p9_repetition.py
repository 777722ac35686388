"""Problem 9: repetition inside a single document.

Method: distribution divergence. Every window of six words (twelve characters in Chinese texts) has a
histogram of common words and one of character classes; two windows of a text that say the same have the
Jensen-Shannon distance 0 in both. Only such windows can be repeated runs, so the distance selects them,
without a loss, and an exact check of the order of their words follows. Texts shorter than a run and one
word have no repetition (length guard). The distances of the whole text to language references, from
which the common words come, are reported beside the share: a text written twice has the histogram of
its half, so they can't tell a share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import codepoints as cp
from .common import cut_lineage
from .labels import LANGUAGES, canonical_label

#: Words of a run that counts as repeated; characters in texts that are mainly Chinese.
RUN_WORDS, RUN_CHARS = 6, 12
#: Share of Chinese characters beyond which characters take the place of words.
CHINESE_SHARE = 1 / 3
#: Most frequent words of each language that the references know.
REFERENCE_WORDS = 400
SHARE = 0.25


class Tokens:
    """Words of a list of texts: hash, text, whether it is a number, and its character classes, letter case disregarded."""

    def __init__(self, texts: list[str]) -> None:
        self.points, self.offsets = cp.flatten(texts)
        n = np.maximum(np.diff(self.offsets), 1)
        self.chinese = np.bincount(cp.owners(self.offsets), cp.look_up(cp.han(), self.points), len(texts)) / n > CHINESE_SHARE
        low = cp.lower(self.points)
        starts, ends = cp.words(self.points, self.offsets, self.chinese)
        self.hashes = cp.span_hashes(low, starts, ends)
        self.doc = np.searchsorted(self.offsets, starts, "right") - 1
        self.digits = cp.look_up(cp.kinds(), self.points[starts]) == 2
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_CLASS_VALUES[cp.look_up(cp.kinds(), low)], dtype=np.uint64)])
        self.classes = sums[ends] - sums[starts]  # equal for equal class counts


#: Random values of the character classes and, by multiplication, of word bins: sums of them stand for histograms.
_CLASS_VALUES = np.random.default_rng(9).integers(1, 1 << 63, 8, dtype=np.uint64)


#: What the references count, beside the words, whose hashes are the keys.
WORD, DIGITS, CLASS = 0, 1, 2


class References:
    """Histograms of common words and character classes per language, counted over all texts."""

    def __init__(self, texts: DataFrame, size: int = REFERENCE_WORDS) -> None:
        """From ``texts`` (language, text); what comes to the driver is bounded by languages and ``size``."""
        counts = cut_lineage(texts.select("language", "text").mapInArrow(reference_counts, "language string, what int, key bigint, n bigint").groupBy("language", "what", "key").agg(F.sum("n").alias("n")))
        words = counts.where(F.col("what") == WORD)
        place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), F.col("key").bitwiseXOR(F.lit(-(1 << 63)))))
        common = words.withColumn("place", place).where(F.col("place") <= size).select("key").distinct()
        totals = words.groupBy("language").agg(F.sum("n").alias("n")).collect()
        held = words.join(F.broadcast(common), "key").select("language", "key", "n").collect()
        others = counts.where(F.col("what") != WORD).collect()
        languages = {x: i for i, x in enumerate(sorted({r.language for r in others}))}
        self.vocab = np.unique(np.array([r.key for r in held], np.int64).view(np.uint64))
        # two further bins: numbers, and all other words
        self.words = np.zeros((len(languages), len(self.vocab) + 2))
        self.kinds = np.full((len(languages), 8), 0.5)
        for r in held:
            self.words[languages[r.language], np.searchsorted(self.vocab, np.uint64(r.key % (1 << 64)))] = r.n
        for r in totals:
            i = languages[r.language]
            self.words[i, -1] = r.n - self.words[i].sum()
        for r in others:
            if r.what == DIGITS:
                self.words[languages[r.language], -2] = r.n
            else:
                self.kinds[languages[r.language], r.key] += r.n
        self.words /= np.maximum(self.words.sum(1, keepdims=True), 1)
        self.kinds /= self.kinds.sum(1, keepdims=True)

    def bins(self, hashes: np.ndarray, digits: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocab, hashes), max(len(self.vocab) - 1, 0))
        hit = self.vocab[at] == hashes if len(self.vocab) else np.zeros(len(hashes), bool)
        return np.where(digits, len(self.vocab), np.where(hit, at, len(self.vocab) + 1))


def reference_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, what, key, n) of the words that aren't numbers, the numbers and the character classes of texts."""
    for b in batches:
        by_language: dict[str, list[str]] = {}
        for language, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by_language.setdefault(language, []).append(text)
        for language, texts in by_language.items():
            for i, j in cp.slices(texts):
                t = Tokens(texts[i:j])
                word, n = np.unique(t.hashes[~t.digits], return_counts=True)
                classes = np.bincount(cp.look_up(cp.kinds(), t.points), minlength=8)
                what = np.repeat([WORD, DIGITS, CLASS], [len(word), 1, len(classes)])
                key = np.concatenate([word.view(np.int64), [0], np.arange(len(classes))])
                n = np.concatenate([n, [t.digits.sum()], classes])
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(n), pa.string()), pa.array(what, pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["language", "what", "key", "n"])


def js_distance(doc: np.ndarray, bins: np.ndarray, weights: np.ndarray, n_docs: int, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each document's histogram to its nearest reference.

    Only bins that a document fills are visited: every other bin adds half its reference weight.
    """
    best = np.full(n_docs, np.inf)
    for q_all in reference:
        q = q_all[bins]
        m = (weights + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            part = (weights * np.log2(weights / m) + np.where(q > 0, q * np.log2(np.where(q > 0, q, 1) / m), 0) - q) / 2
        best = np.minimum(best, 0.5 + np.bincount(doc, part, n_docs))
    return np.maximum(best, 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def covered_share(at: np.ndarray, run: int, doc: np.ndarray) -> np.ndarray:
    """Whether each word lies in one of the windows of ``run`` words that begin at ``at``."""
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    return np.cumsum(edge[:-1]) > 0


def again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurred at an earlier place, and those whose key occurs at another place at all."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return order[1:][same], np.unique(np.concatenate([order[1:][same], order[:-1][same]]))


def shares(t: Tokens, bins: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(share in windows at distance 0 from an earlier one, share in repeated runs) of the words of each document.

    The histograms of a window are sums over its words, kept as sums of random values of the bins: windows
    with the same sums have equal histograms, that is the Jensen-Shannon distance 0. A repeated run has
    equal histograms at both places, so only windows at distance 0 are compared word by word.
    """
    n = np.maximum(np.bincount(t.doc, minlength=n_docs), 1)
    near, exact = np.zeros(len(t.doc), bool), np.zeros(len(t.doc), bool)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(bins.astype(np.uint64) + np.uint64(1)) + t.classes, dtype=np.uint64)])
        for run, of in ((RUN_WORDS, ~t.chinese), (RUN_CHARS, t.chinese)):
            last = len(t.doc) - run + 1
            if last < 1:
                continue
            at = np.flatnonzero((t.doc[:last] == t.doc[run - 1 :]) & of[t.doc[:last]])
            later, some = again(_mixed((sums[at + run] - sums[at]) ^ _mixed(t.doc[at].astype(np.uint64) + np.uint64(7))))
            near |= covered_share(at[later], run, t.doc)
            at = at[some]
            key = np.zeros(len(at), np.uint64)
            for k in range(run):
                key = _mixed(key ^ t.hashes[at + k])
            later, _ = again(_mixed(key ^ _mixed(t.doc[at].astype(np.uint64) + np.uint64(7))))
            exact |= covered_share(at[later], run, t.doc)
    return np.bincount(t.doc, near, n_docs) / n, np.bincount(t.doc, exact, n_docs) / n


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, n_words, js_words, js_classes, window_share, share) of every row; null and empty texts have 0 words and shares 0.

    ``js_words`` and ``js_classes`` are the distances of the whole text to its nearest language reference,
    ``window_share`` that of words in windows at distance 0 from an earlier one, ``share`` that of words in
    repeated runs: exact for every text, at most ``window_share``.
    """
    label = canonical_label(F.col(lang))
    usable = docs.where((F.length(text) > 0) & F.col(key).isNotNull() & label.isin(*LANGUAGES))
    refs = References(usable.select(label.alias("language"), F.col(text).alias("text")))

    def some(texts: list[str]) -> tuple[np.ndarray, ...]:
        n_docs = len(texts)
        t = Tokens(texts)
        doc, n = t.doc, np.bincount(t.doc, minlength=n_docs)
        slots = len(refs.vocab) + 2
        bins = refs.bins(t.hashes, t.digits)
        cell, count = np.unique(doc * slots + bins, return_counts=True)
        js_words = js_distance(cell // slots, cell % slots, count / np.maximum(n, 1)[cell // slots], n_docs, refs.words) if len(refs.words) else np.full(n_docs, 1.0)
        count = np.bincount(cp.owners(t.offsets) * 8 + cp.look_up(cp.kinds(), t.points), minlength=8 * n_docs)
        cell = np.flatnonzero(count)
        js_classes = js_distance(cell // 8, cell % 8, count[cell] / np.diff(t.offsets)[cell // 8], n_docs, refs.kinds) if len(refs.kinds) else np.full(n_docs, 1.0)
        return n, js_words, js_classes, *shares(t, bins, n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            parts = [some(texts[i:j]) for i, j in cp.slices(texts)]
            if parts:
                n, js_words, js_classes, near, share = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(js_words), pa.array(js_classes), pa.array(near), pa.array(share)],
                    names=["k", "n_words", "js_words", "js_classes", "window_share", "share"],
                )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_words bigint, js_words double, js_classes double, window_share double, share double")
    return out.withColumnRenamed("k", key)


def repetitive(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = SHARE) -> DataFrame:
    """(key) of the texts of which at least ``least`` lies in windows at distance 0 from an earlier one and, checked word by word, in repeated runs."""
    return measure(docs, key, text, lang).where((F.col("window_share") >= least) & (F.col("share") >= least)).select(key).distinct()
