"""Problem 4: broken prompt and response pairs.

Method: language posteriors of prompt and response from character n-gram naive Bayes are compared;
the likelihood of an end after the last n-grams of the answer flags truncation. Refusals are sentences
with a high posterior in a naive Bayes model of words and word pairs; a few phrases start its training
and decide where a wording is too rare. All models are counted over all pairs. Empty answers and copies of the question are found from the words themselves.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import INVISIBLE
from .common import cut_lineage
from .endings import BROKEN, OMISSION, OPEN, OPEN_NAMES, Grams, Open, Vocabulary, decided, open_rows, verdict, vocabulary
from .labels import LANGUAGES, canonical_label
from .language import LanguageModel

#: Posterior from which prompt and response count as being in different languages, and letters needed.
LEAST_POSTERIOR, LEAST_LETTERS = 0.95, 12
#: Share of the answer's words that come from the question in a copy.
COPY_SHARE = 0.85
#: Share of the n-grams at the end of an answer that must be ends.
LEAST_ENDS = 0.25

# Placeholders for nothing, lower-case, without punctuation.
NOTHING = frozenset("na n/a none null nil nan empty unknown tbd tba todo void missing leer keine nichts vide néant aucun aucune nulo ninguno ninguna nada vacío vacio ninguém vazio nessuno nessuna vuoto 无 無 空 没有 不详 暂无".split()) | {"no answer", "not available", "not applicable", "keine antwort", "keine angabe", "pas de réponse", "sans objet", "sin respuesta", "no disponible", "no aplica", "sem resposta", "nessuna risposta", "无答案", "没有答案", "不适用"}

# What answers say when they decline (first person or the request as such, never a fact of the document);
# they label the sentences that the refusal model begins with, and decide on wordings too rare for it.
FIRST_REFUSALS = re.compile(
    r"\bi(?:'m| am) (?:sorry|afraid|unable|not able|not allowed|not permitted)|\bi (?:cannot|can't|can not|won't|will not|must decline|have to decline|decline|refuse|am declining|do not|don't|would rather not|prefer not)\b|\bi'd (?:rather|prefer) not\b|\b(?:apologi[sz]e|as an ai|language model)\b|\bmy (?:guidelines|policies|policy|rules)\b"
    r"|\bno answer (?:will|can) be (?:given|provided)|\bi am allowed to\b|\brequest (?:was|has been|is) (?:denied|rejected|declined|refused)|\bcannot (?:assist|help|comply)\b|\bask (?:me )?(?:something else|a specialist|another question)|\btry another question\b"
    r"|\b(?:es )?tut mir leid\b|\bich (?:kann|darf|möchte|werde|muss)\b[^.]{0,60}\b(?:nicht|keine?|ablehnen)\b|\b(?:nicht|keine?)\b[^.]{0,40}\bich\b|\bmeine[rn]? (?:richtlinien|regeln|vorgaben)\b|\bleider (?:kann|muss|darf) ich\b|\bkeine antwort (?:gegeben|erteilt)|\banfrage wurde (?:abgelehnt|zurückgewiesen)|\bbesprechen darf\b|\bals ki\b|\bstellen sie bitte eine andere\b|\bentschuldig"
    r"|\bje (?:suis désolée?|regrette|ne peux|ne suis pas|ne puis|ne souhaite|préfère ne|refuse|dois (?:décliner|refuser)|m'excuse)|\bdésolée?\b|\bmes (?:règles|consignes|directives)\b|\baucune réponse ne (?:sera|peut)|\bdemande a été (?:rejetée|refusée)|\bposez une autre question|\bce dont (?:je|j')|\bm'est permis|\ben tant qu'ia\b"
    r"|\blo siento\b|\blamento\b|\b(?:no puedo|no debo|no voy a|no me es posible|prefiero no|debo (?:negarme|rechazar|declinar)|me niego)\b|\bmis (?:normas|directrices|reglas|políticas)\b|\bno se dará (?:ninguna )?respuesta|\bsolicitud (?:fue|ha sido|se ha) (?:rechazada|denegada|rechazado)|\bhaga otra pregunta\b|\bse me permite\b|\bdisculp"
    r"|\bmi dispiace\b|\bnon (?:posso|sono in grado)\b|\blinee guida\b|\bdesculpe|\blamento\b|\bnão posso\b|\bminhas (?:diretrizes|regras)\b"
    r"|对不起|抱歉|(?:我|本人)(?:不能|无法|不便|不会|不得|不想|必须拒绝|拒绝)|不便(?:回答|评论|透露)|无法(?:回答|提供(?:答案|帮助|协助)|协助)|拒绝(?:回答|了|该)|请求(?:已)?被拒|(?:我的|本人的)(?:准则|规定|规则|指南|原则)|不予(?:回答|答复)|不(?:提供|给出)答案|换(?:个|一个)问题|另(?:提|问)|允许(?:讨论|我)|出于安全"
    r"|\b(?:for|aus|pour|por) (?:reasons of safety|safety reasons|sicherheitsgründen|des raisons de sécurité|razones de seguridad|motivos de seguridad)\b",
    re.IGNORECASE,
)

_SPACES = re.compile(r"\s+")
_GONE = dict.fromkeys(map(ord, INVISIBLE))
_WORD = re.compile(r"[㐀-鿿]|\d+(?:[.,]\d+)*|[^\W\d_]+")
#: A value: a number with its unit, at most one word before it and so many words in all.
_VALUE = re.compile(r"^\W*(?:[^\W\d_]{1,16}\W+|百分之|约|大约)?[<>≈~±]?\s*\d", re.UNICODE)
VALUE_WORDS = 5
#: Log odds from which a sentence declines, those below which it surely doesn't, and rounds in which the model labels its
#: training sentences anew.
DECLINES, DOUBT, ROUNDS = 3.0, -13.0, 3
#: Sentences that must hold a feature before it speaks for a refusal, and the smoothing of all counts.
LEAST_SENTENCES, SMOOTHING = 2, 0.1
#: ... and one in so many sentences of its kind (others, refusals), which bounds the model and keeps a few wrong labels from
#: speaking; and the sentences that the smoothing is meant for: it grows with more, so the odds are the same at any scale.
SPOKEN_IN, SMOOTHED = (4_000, 400), (7_000, 150)
#: Words of a sentence that the refusal model may judge; the rest of a sentence that was cut off is often shorter.
LEAST_WORDS = 5


@lru_cache(maxsize=4096)
def plain(text: str) -> str:
    """Compatibility form without invisible characters, blanks collapsed."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_GONE))
    return _SPACES.sub(" ", text).strip()


class RefusalModel:
    """Naive Bayes of sentences that decline to answer, over words and word pairs; numbers count as one word."""

    def __init__(self) -> None:
        self.odds: dict[str, float] = {}

    @classmethod
    def of_all(cls, answers: DataFrame) -> RefusalModel:
        """The model of all rows of ``answers`` (answer), fitted in rounds that count them where they lie."""
        model = cls()
        for _ in range(ROUNDS):
            counts = cut_lineage(answers.select("answer").mapInArrow(model._counted, "feature string, no bigint, yes bigint").groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")))
            n = counts.where("feature = ''").first()
            if n is None or not n.yes:
                break
            # a feature speaks by the sentences that hold it; for a refusal only when several do
            least = [max(LEAST_SENTENCES, math.ceil(k / of)) for k, of in zip((n.no, n.yes), SPOKEN_IN)]
            some = counts.where((F.col("feature") != "") & ((F.col("no") >= least[0]) | (F.col("yes") >= least[1])))
            model = cls._fitted([tuple(r) for r in some.collect()], (n.no, n.yes), least)
        return model

    def _counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sentences that hold each feature, and under '' all, by the labels of this model, the first ones of the phrases."""
        for b in batches:
            counts = (Counter(), Counter())
            for t in b.column(0).to_pylist():
                for x in self.sentences(t):
                    f = self.features(x)
                    counts[self.score(f) > DECLINES if self.odds else bool(FIRST_REFUSALS.search(x))].update({"", *f})
            names = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[k] for k in names], pa.int64()) for c in counts)], names=["feature", "no", "yes"])

    @classmethod
    def _fitted(cls, counts: list[tuple[str, int, int]], n: tuple[int, int], least: list[int]) -> RefusalModel:
        model = cls()
        smooth = [SMOOTHING * max(1.0, k / of) for k, of in zip(n, SMOOTHED)]
        for f, no, yes in counts:
            odds = math.log((yes + smooth[1]) / (n[1] + 2 * smooth[1])) - math.log((no + smooth[0]) / (n[0] + 2 * smooth[0]))
            if (odds > 0 and yes >= least[1]) or (odds <= 0 and no >= least[0]):
                model.odds[f] = odds
        model.prior = math.log((n[1] + 1) / (n[0] + 1))
        return model

    @staticmethod
    def sentences(text: str) -> list[str]:
        """Sentences of an answer in plain form; a colon, semicolon or long dash also ends one."""
        return [x for x in re.split(r"(?<=[.!?;:。！？；：])\s*|\s[–—-]\s", plain(text)) if x]

    @staticmethod
    def features(sentence: str) -> set[str]:
        w = ["0" if x[0].isdigit() else x.lower() for x in _WORD.findall(sentence)]
        w = ["^", *w, "$"]
        return {*w[1:-1], *(f"{a} {b}" for a, b in zip(w, w[1:]))}

    def score(self, features: set[str]) -> float:
        """Log odds of a refusal, from the features that say most, at most one per word of the sentence."""
        if sum(" " not in f for f in features) < LEAST_WORDS:
            return -math.inf
        known = sorted((self.odds[f] for f in features if f in self.odds), key=abs, reverse=True)
        return self.prior + sum(known[: max(3, len(features) // 2)]) if known else -math.inf

    def declines(self, text: str) -> bool:
        """Whether a sentence of the text has the odds of a refusal; one that the model is in doubt about is told by its phrase."""
        for x in self.sentences(text):
            odds = self.score(self.features(x)) if self.odds else -math.inf
            if odds > DECLINES or ((odds > DOUBT or odds == -math.inf) and FIRST_REFUSALS.search(x)):
                return True
        return False


def is_nothing(text: str | None) -> bool:
    """Null, blank, only marks, or a placeholder for nothing."""
    if text is None:
        return True
    t = plain(text)
    if not _WORD.search(t) and not any(c.isalnum() for c in t):
        return True
    bare = t.strip(" .,;:!?()[]<>{}\"'-–—_*#/\\。，；：！？（）【】「」").lower()
    return bare in NOTHING


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(plain(text))]


def after_question(question: str, answer: str) -> tuple[str, bool]:
    """What an answer says after giving the question again, and whether it gave it.

    The question may come slightly changed, several times, in quotation marks and after an
    introduction; then the rest is what follows its last occurrence.
    """
    q, a = plain(question), plain(answer)
    core = q.strip(" ¿?？.!\"“”„«»").lower()
    low = a.lower()
    if len(low) != len(a) or not core:
        return a, False
    at, given = 0, False
    while (k := low.find(core, at)) >= 0:
        given, at = True, k + len(core)
    return (a[at:], True) if given else (a, False)


def is_copy(question: str, answer: str) -> bool:
    """The answer gives the question and nothing else."""
    rest, given = after_question(question, answer)
    if given and not words(rest):
        return True
    q, a = words(question), words(answer if not given else rest)
    if not q or not a:
        return False
    known = set(q)
    if any(w[0].isdigit() and w not in known for w in a):
        return False
    # an introduction may stand before the question, not a statement after it
    best = sum(w in known for w in a) / len(a)
    cover = len(known & set(a)) / len(known)
    return best >= COPY_SHARE and cover >= 0.7 and len(a) >= 0.6 * len(q)


def defects(pairs: DataFrame) -> DataFrame:
    """(query_id, defect_type) of every defective pair, one row per query_id.

    Defects are looked for in the order empty, refusal, copied_question, wrong_language, truncated.
    Repeated rows count once; a null or blank question can't be copied and has no language.
    """
    code = canonical_label(F.col("query_language"))
    rows = pairs.select("query_id", "question", "answer", F.when(code.isin(*LANGUAGES), code).alias("code")).where(F.col("query_id").isNotNull())
    once = cut_lineage(rows.distinct())
    languages = LanguageModel.of_all(once.select(F.explode(F.array("question", "answer")).alias("text"), "code"))
    answers = once.select("answer").mapInArrow(with_content, "answer string")
    texts = cut_lineage(answers.select(F.translate("answer", INVISIBLE, "").alias("text")).distinct())
    known, refusals = vocabulary(texts), RefusalModel.of_all(answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(known)
        for b in batches:
            out = []
            open_ = []
            for key, question, answer in zip(*(b.column(k).to_pylist() for k in range(3))):
                question = question or ""
                if is_nothing(answer):
                    out.append((key, "empty", True, ""))
                elif refusals.declines(answer):
                    out.append((key, "refusal", True, ""))
                elif question.strip() and is_copy(question, answer):
                    out.append((key, "copied_question", True, ""))
                else:
                    rest, given = after_question(question, answer)
                    open_.append((key, question, answer, rest if given else plain(answer)))
            if open_:
                asked, _ = languages.posterior([x[1] for x in open_])
                told, letters = languages.posterior([x[3] for x in open_])
                for k, (key, question, answer, rest) in enumerate(open_):
                    q, a = asked[k].argmax(), told[k].argmax()
                    value = bool(_VALUE.match(rest)) and len([w for w in words(rest) if w[0].isalpha()]) <= VALUE_WORDS and not re.search(r"[.。]\s*$", rest)
                    han = sum("㐀" <= c <= "鿿" for c in rest)
                    enough = letters[k] >= LEAST_LETTERS or han >= 4
                    if question.strip() and enough and not value and q != a and asked[k][q] >= LEAST_POSTERIOR and told[k][a] >= LEAST_POSTERIOR:
                        out.append((key, "wrong_language", True, ""))
                    else:
                        got, word = (True, "") if broken_off(rest) else value_end(known, rest) if value else verdict(known, plain_end(answer), question)
                        if got:
                            out.append((key, "truncated", got, word))
            names = [pa.array([x[k] for x in out], pa.string()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*names, *open_rows(grams, [(got, word, LEAST_ENDS) for _, _, got, word in out])], names=["query_id", "defect_type", *OPEN_NAMES])

    found = decided(texts, known, rows.drop("code").mapInArrow(run, f"query_id string, defect_type string, {OPEN}"), ["query_id", "defect_type"])
    rank = F.create_map(*[F.lit(x) for i, d in enumerate(("empty", "refusal", "copied_question", "wrong_language", "truncated")) for x in (d, i)])
    return found.groupBy("query_id").agg(F.min_by("defect_type", rank[F.col("defect_type")]).alias("defect_type"))


def broken_off(text: str) -> bool:
    return bool(OMISSION.search(text) or BROKEN.search(text))


def plain_end(text: str) -> str:
    return "".join(c for c in text if c not in INVISIBLE)


def value_end(known: Vocabulary, text: str) -> tuple[bool | Open, str]:
    """Whether a bare value was cut: its last word is part of a longer known one, unless other answers hold it."""
    m = re.search(r"([^\W\d_]+)\W*$", text)
    if not m or "㐀" <= m[1][-1] <= "鿿":
        return False, ""
    word = m[1].lower()
    return (Open("value", part=True), word) if word not in known.words and known.begins_longer(word) else (False, "")


def with_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers that say anything."""
    for b in batches:
        yield b.filter(pa.array([not is_nothing(t) for t in b.column(0).to_pylist()], pa.bool_()))
