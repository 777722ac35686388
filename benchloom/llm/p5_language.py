"""Problem 5: missing or wrong document language labels.

Method: hyperdimensional profiles, see ``language``. Each sentence is compared with the language
prototypes by cosine; a field is the mix of its sentences. One pass over the texts, no shuffle of
texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp
from .common import bounded_sample
from .labels import LANGUAGES, canonical_label
from .language import LanguageModel, Pieces, without_asides

FIELDS = ("abstract", "description")
#: Labelled rows per language that the prototypes are fitted on.
TRAINING_ROWS = 400
#: A sentence speaks for itself from this many letters and this confidence, else the field decides.
OWN_LETTERS, OWN_CONFIDENCE = 12, 0.8
#: Below this length naive Bayes must agree with the profile before a piece contradicts its label.
SHORT_LETTERS = 40


def fit_languages(corpus: DataFrame, fields: tuple[str, ...] = FIELDS, bound: int = TRAINING_ROWS) -> LanguageModel:
    """Model from at most ``bound`` labelled rows per language; wrong labels are outvoted in the fit."""
    code = canonical_label(F.col("language"))
    rows = corpus.select("id", *fields, F.when(code.isin(*LANGUAGES), code).alias("code"))
    samples = [(r[f], r["code"]) for r in bounded_sample(rows, "id", bound, "code") for f in fields]
    return LanguageModel(samples)


def judge(model: LanguageModel, texts: list[str], labels: list[str | None]) -> tuple[Pieces, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the texts, language number and confidence of each piece (-1: nothing to read), and of each text."""
    pieces = Pieces([without_asides(t) for t in texts])
    n_lang, n_text = len(model.languages), len(texts)
    score, confidence = model.nearest(pieces)
    chinese = (pieces.n_han >= 2) & (2 * pieces.n_han >= pieces.n_letters - pieces.n_han)
    zh = model.languages.index("zh")
    score[chinese, zh] = 2 * np.maximum(score[chinese].max(1), 1e-3)
    confidence = np.where(chinese, 1.0, confidence)
    best = score.argmax(1)
    sure = (chinese | (pieces.n_letters >= OWN_LETTERS)) & (confidence >= OWN_CONFIDENCE)
    number = {c: i for i, c in enumerate(model.languages)}
    named = np.array([number.get(c, -1) for c in labels], int)
    # a short piece (often one cut off) that contradicts the label needs a second opinion
    short = (pieces.n_letters < SHORT_LETTERS) & (pieces.n > 0) & ~chinese & (best != named[pieces.text])
    if short.any():
        second = pieces.sums(model.log_likelihood, short).argmax(1)
        doubt = short & (second != best)
        sure &= ~doubt
        best = np.where(doubt, second, best)

    votes = np.zeros((n_text, n_lang))
    np.add.at(votes, (pieces.text[sure], best[sure]), pieces.n_letters[sure])
    weak = np.zeros((n_text, n_lang))
    np.add.at(weak, pieces.text, np.maximum(score, 0) * pieces.n[:, None])
    np.add.at(weak, (pieces.text, best), np.maximum(score.max(1), 0) * pieces.n)
    has = named >= 0
    weak[np.flatnonzero(has), named[has]] *= 1.25  # between near languages the label decides
    some = votes.any(1)
    main = np.where(some, votes.argmax(1), weak.argmax(1))

    of = main[pieces.text]
    near = score[np.arange(pieces.count), of] >= 0.75 * score.max(1)
    clear = (confidence >= 0.6) & (pieces.n_letters >= 2 * OWN_LETTERS)
    own = sure | (clear & ~near & ~short)
    language = np.where(own, best, of)
    language = np.where(pieces.n_letters >= (1 if n_text else 0), language, -1)
    language = np.where((pieces.n_letters < 4) & ~chinese & some[pieces.text], of, language)
    language = np.where(pieces.n_letters == 0, -1, language)
    total = votes.sum(1)
    mixed = np.zeros(n_text)
    np.add.at(mixed, pieces.text, confidence * pieces.n_letters)
    letters = np.bincount(pieces.text, pieces.n_letters, n_text)
    share = np.where(some, votes.max(1) / np.maximum(total, 1), 0.5)
    text_confidence = share * mixed / np.maximum(letters, 1)
    return pieces, language, confidence, np.where(letters > 0, main, -1), text_confidence


def _texts(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        ids, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
        for k in range(2, b.num_columns):
            field = b.schema.names[k]
            texts = [t or "" for t in b.column(k).to_pylist()]
            for i, j in cp.slices(texts):
                yield field, ids[i:j], labels[i:j], texts[i:j]


def _rows(corpus: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return corpus.where(F.col("id").isNotNull()).select("id", canonical_label(F.col("language")).alias("label"), *fields)


def segments(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, segment, language, confidence) of every sentence that holds a letter; segments count from 0.

    Null, blank and letterless fields have no segment; a row delivered twice counts once.
    """
    model = fit_languages(corpus, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, None], object)
        for field, ids, labels, texts in _texts(batches):
            pieces, language, confidence, _, _ = judge(model, texts, labels)
            first = np.searchsorted(pieces.text, np.arange(len(texts)))
            at = np.flatnonzero(language >= 0)
            of = pieces.text[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, object)[of], pa.string()), pa.array([field] * len(at), pa.string()), pa.array(at - first[of], pa.int32()), pa.array(names[language[at]], pa.string()), pa.array(np.round(confidence[at], 4))],
                names=["id", "field", "segment", "language", "confidence"],
            )

    return _rows(corpus, fields).mapInArrow(run, "id string, field string, segment int, language string, confidence double").distinct()


def documents(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, label, language, confidence): the main language of every field of every id, null where it holds no letter."""
    model = fit_languages(corpus, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, None], object)
        for field, ids, labels, texts in _texts(batches):
            _, _, _, main, confidence = judge(model, texts, labels)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array([field] * len(ids), pa.string()), pa.array(labels, pa.string()), pa.array(names[main], pa.string()), pa.array(np.round(confidence, 4))],
                names=["id", "field", "label", "language", "confidence"],
            )

    out = _rows(corpus, fields).mapInArrow(run, "id string, field string, label string, language string, confidence double")
    return out.dropDuplicates(["id", "field"])


def unnamed_languages(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, language): languages in which a field has a sentence and which its row's label doesn't name."""
    model = fit_languages(corpus, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_lang = len(model.languages)
        number = {c: i for i, c in enumerate(model.languages)}
        for field, ids, labels, texts in _texts(batches):
            pieces, language, _, _, _ = judge(model, texts, labels)
            named = np.array([number.get(c, -1) for c in labels], int)
            ok = (language >= 0) & (language != named[pieces.text])
            cells = np.unique(pieces.text[ok] * n_lang + language[ok])
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[c // n_lang] for c in cells], pa.string()), pa.array([field] * len(cells), pa.string()), pa.array([model.languages[c % n_lang] for c in cells], pa.string())],
                names=["id", "field", "language"],
            )

    return _rows(corpus, fields).mapInArrow(run, "id string, field string, language string").distinct()
