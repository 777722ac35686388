"""Language of text pieces: hyperdimensional profiles and character n-gram naive Bayes.

Every letter has a random bipolar vector (8,192 dimensions keep the noise between the thousands of
bundled trigrams small). A letter trigram is bound as the product of the vectors
of its letters, permuted by place; a text is the bundle (sum) of its trigrams, a language the
bundle of its training sentences, damped by the square root of the frequencies and less the mean
of all languages. The dot product of two
bundles is the sum, over the trigrams of one, of their dot products with the other, so a model
carries one number per trigram and language, and a text is compared by looking these up. The sum is
divided by the number of trigrams in place of the norm of the text's bundle: languages are ranked
by cosine all the same, as that norm is one factor for all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp
from .labels import LANGUAGES

DIMENSIONS = 8192
N = cp.N_CLASSES
#: Rounds in which training texts, in the last one sentences, move to the language that they resemble most.
ROUNDS = 3

# Frequent function words that give each profile its start.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with as by on are be this was which from at an it has can not been have its or",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "fr": "le la les de des et en un une du que est pour qui dans par sur au avec ce il sont plus pas ne aux être été cette ou",
    "es": "el la los las de y en un una que del se por con para al es su lo como más o este sus entre fue han ser desde hasta",
    "zh": "的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可",
    "it": "il lo la gli le di del della dei delle che e un una in per con non è sono da al alla nel nella come più questo anche viene si",
    "pt": "o a os as de do da dos das e um uma que em no na por para com não é são ao à se como mais este também foi seu pelo",
}

#: Text in brackets or quotation marks belongs to the sentence around it, whatever its language.
_ASIDE = re.compile(r"[(（\[][^()（）\[\]]{0,400}[)）\]]|“[^”]{0,400}”|„[^“”]{0,400}[“”]|«[^»]{0,400}»|\"[^\"]{0,400}\"|‹[^›]{0,400}›|「[^」]{0,400}」|《[^》]{0,400}》|(?<![^\s(])»(?=\S)[^«»]{0,400}(?<=\S)«")
#: Longer quotations whose closing mark opens elsewhere: whole sentences, which stay.
_LONG = re.compile(r"„([^„“”]{401,})[“”]|(?<![^\s(])»(?=\S)([^«»]{401,})(?<=\S)«")
#: A mark without its other half, up to the end of the sentence.
_OPEN = re.compile(r"[(（\[“„«「《](?:(?![.!?](?:\s|$)|[。！？]).)*", re.DOTALL)
_MARKS = re.compile(r"[(（\[“„«»\"‹「《]")


def without_asides(text: str) -> str:
    """Text without what stands in brackets or quotation marks, or behind an unclosed one up to the end of its sentence."""
    if not _MARKS.search(text):
        return text
    text = _ASIDE.sub(" ", _ASIDE.sub(" ", text)) if "“" in text or "„" in text or "«" in text or '"' in text else _ASIDE.sub(" ", text)
    text = _LONG.sub(lambda m: f" {m[1] or m[2]} ", text)
    closed = 1 + max(text.rfind(c) for c in ")）]”»」》")
    return text[:closed] + _OPEN.sub(lambda m: "" if closed + m.start() > 0 else m[0], text[closed:])


def _vectors(seed: int = 7) -> np.ndarray:
    return np.where(np.random.default_rng(seed).integers(0, 2, (N, DIMENSIONS)), 1, -1).astype(np.int8)


class Profiles:
    """Language bundles over the trigrams that the training sentences hold."""

    def __init__(self) -> None:
        letters = _vectors()
        self.one, self.two, self.three = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters

    def bound(self, trigrams: np.ndarray) -> np.ndarray:
        return (self.one[trigrams >> 12] * self.two[trigrams >> 6 & 63] * self.three[trigrams & 63]).astype(np.float32)

    def products(self, counts: np.ndarray) -> np.ndarray:
        """Cosine of every trigram vector with every language bundle, from counts [trigram, language].

        A trigram that was not counted is as good as orthogonal to every bundle and has 0.
        """
        seen = np.flatnonzero(counts.any(1))
        weight = np.sqrt(counts[seen] / np.maximum(counts.sum(0), 1))
        weight -= weight.mean(1, keepdims=True)
        bundles = np.zeros((DIMENSIONS, counts.shape[1]), np.float32)
        step = 1024
        for i in range(0, len(seen), step):
            bundles += self.bound(seen[i : i + step]).T @ weight[i : i + step]
        bundles /= np.maximum(np.linalg.norm(bundles, axis=0), 1e-9) * np.sqrt(DIMENSIONS)
        out = np.zeros(counts.shape, np.float32)
        for i in range(0, len(seen), step):
            t = seen[i : i + step]
            out[t] = self.bound(t) @ bundles
        return out


class Pieces:
    """Sentences of a list of texts with their trigrams."""

    def __init__(self, texts: list[str], split: bool = True) -> None:
        points, offsets = cp.flatten([t + "\n" for t in texts])
        n = len(points)
        kind = cp.look_up(cp.letters(), points)
        end = np.zeros(n, bool)
        end[offsets[1:] - 1] = True
        if split:
            blank = np.concatenate([cp.look_up(cp.kinds(), points[1:]) == 3, [True]]) if n else end
            end |= (np.isin(points, (0x2E, 0x21, 0x3F)) & blank) | np.isin(points, (0x3002, 0xFF01, 0xFF1F))
        piece = np.cumsum(np.concatenate([[0], end[:-1]])) if n else np.zeros(0, np.int64)
        self.count = int(piece[-1]) + 1 if n else 0
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        self.text = np.searchsorted(offsets, first, "right") - 1
        keep = kind != cp.SKIP
        kind, piece = kind[keep], piece[keep]
        keep = (kind != 0) | (np.concatenate([[1], kind[:-1]]) != 0)
        kind, piece = kind[keep].astype(np.int64), piece[keep]
        self.n_letters = np.bincount(piece[kind > 0], minlength=self.count)
        self.n_han = np.bincount(piece[kind == cp.HAN], minlength=self.count)
        if len(kind) < 3:
            self.trigram = self.piece = np.zeros(0, np.int64)
        else:
            ok = (piece[:-2] == piece[2:]) & (kind[1:-1] != 0)
            self.trigram = (kind[:-2] << 12 | kind[1:-1] << 6 | kind[2:])[ok]
            self.piece = piece[:-2][ok]
        self.n = np.bincount(self.piece, minlength=self.count)

    def sums(self, table: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """Sum of the table rows of each piece's trigrams; with ``only``, of these pieces, 0 for others."""
        out = np.zeros((self.count, table.shape[1]))
        trigram, piece = self.trigram, self.piece
        if only is not None:
            of = only[piece]
            trigram, piece = trigram[of], piece[of]
        if len(trigram):
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            out[piece[starts]] = np.add.reduceat(table[trigram], starts, 0)
        return out


def log_likelihood(counts: np.ndarray) -> np.ndarray:
    """log P(trigram | language), smoothed."""
    smooth = counts + 0.01
    return np.log(smooth / smooth.sum(0)).astype(np.float32)


class LanguageModel:
    """Profiles and naive Bayes of the languages, fitted on labelled texts of which some are wrong."""

    def __init__(self, samples: list[tuple[str, str | None]], languages: tuple[str, ...] = LANGUAGES) -> None:
        self.languages = languages
        n_lang = len(languages)
        seeds = [FUNCTION_WORDS[x] for x in languages]
        labelled = [(without_asides(t), languages.index(c) if c in languages else -1) for t, c in samples if t and t.strip()]
        sentences = Pieces([t for t, _ in labelled] + seeds)
        label = np.array([c for _, c in labelled] + list(range(n_lang)))[sentences.text]
        fixed = sentences.text >= len(labelled)

        def counts(of: np.ndarray) -> np.ndarray:
            cell = np.where(fixed, label, of)[sentences.piece]
            ok = cell >= 0
            flat = np.bincount(sentences.trigram[ok] * n_lang + cell[ok], np.where(fixed, 3.0, 1.0)[sentences.piece[ok]], N**3 * n_lang)
            return flat.reshape(N**3, n_lang).astype(np.float32)

        total = counts(label)
        for k in range(ROUNDS):
            score = sentences.sums(log_likelihood(total))
            if k < ROUNDS - 1:  # whole texts first: their few foreign sentences can't mislead them
                whole = np.zeros((len(labelled) + n_lang, n_lang))
                np.add.at(whole, sentences.text, score)
                score = whole[sentences.text]
            total = counts(np.where(sentences.n_letters >= 8, score.argmax(1), -1))
        self.log_likelihood = log_likelihood(total)
        self.products = Profiles().products(total)

    @classmethod
    def of_all(cls, texts: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> LanguageModel:
        """The model of all rows of ``texts`` (text, code), which are counted where they lie.

        What comes to the driver is bounded by the letters: one number per trigram and language.
        """
        n_lang = len(languages)
        seeds = Pieces([FUNCTION_WORDS[x] for x in languages])
        start = np.bincount(seeds.trigram * n_lang + seeds.text[seeds.piece], np.full(len(seeds.trigram), 3.0), N**3 * n_lang)

        def counts(table: np.ndarray | None, whole: bool) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    rows = [(without_asides(t), languages.index(c) if c in languages else -1) for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and t.strip()]
                    for i, j in cp.slices([t for t, _ in rows]):
                        part = [("", -1), *rows[i:j]]  # every text follows another one, wherever a batch begins
                        pieces = Pieces([t for t, _ in part])
                        of = np.array([c for _, c in part], np.int64)[pieces.text]
                        if table is not None:
                            score = pieces.sums(table)
                            if whole:
                                sums = np.zeros((len(part), n_lang))
                                np.add.at(sums, pieces.text, score)
                                score = sums[pieces.text]
                            of = np.where(pieces.n_letters >= 8, score.argmax(1), -1)
                        of = of[pieces.piece]
                        cell, n = np.unique((pieces.trigram * n_lang + of)[of >= 0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

            got = texts.select("text", "code").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
            flat = start.copy()
            flat[got.column("cell").to_numpy()] += got.column("n").to_numpy()
            return flat.reshape(N**3, n_lang).astype(np.float32)

        total = counts(None, False)
        for k in range(ROUNDS):
            total = counts(log_likelihood(total), k < ROUNDS - 1)
        model = cls.__new__(cls)
        model.languages, model.log_likelihood, model.products = languages, log_likelihood(total), Profiles().products(total)
        return model

    def nearest(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Scores [piece, language] and confidence of the nearest profile for each piece."""
        score = pieces.sums(self.products) / np.maximum(pieces.n, 1)[:, None]
        top = np.maximum(score.max(1, keepdims=True), 1e-9)
        weight = np.exp(-24 * (top - score) / top * np.minimum(1, np.sqrt(pieces.n / 40))[:, None])
        return score, 1 / weight.sum(1)

    def posterior(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Naive Bayes posterior [text, language] from character trigrams, and the number of letters."""
        pieces = Pieces(texts, split=False)
        logs = pieces.sums(self.log_likelihood)
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), pieces.n_letters
