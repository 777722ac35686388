"""Language labels: codes, regions, scripts and names to two-letter codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes (ISO 639-1, 639-2/B, 639-2/T, 639-3) and names, in English and as the language calls itself.
LABELS = {
    "en": "en eng english anglais englisch inglés inglese inglês",
    "de": "de deu ger german deutsch allemand alemán tedesco alemão",
    "fr": "fr fra fre french français francais französisch francés francese francês",
    "es": "es spa spanish español espanol castellano castilian espagnol spanisch spagnolo espanhol",
    "zh": "zh zho chi cmn yue chinese mandarin 中文 汉语 漢語 普通话 chinois chinesisch chino cinese chinês",
    "it": "it ita italian italiano italien italienisch",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese",
    "nl": "nl nld dut dutch nederlands",
    "ja": "ja jpn japanese 日本語",
    "ko": "ko kor korean 한국어",
    "ru": "ru rus russian русский",
}

#: Languages that the operators tell apart.
LANGUAGES = ("en", "de", "fr", "es", "zh", "it", "pt")

TO_CODE = {name: code for code, names in LABELS.items() for name in names.split()}


def canonical_label(label: Column) -> Column:
    """Two-letter code that a label names, null where it names no language or several.

    Region, script and further subtags after ``-``, ``_`` or a blank are ignored, as are letter case and
    white space; otherwise a language's name may stand anywhere in the label.
    """
    low = F.lower(F.trim(label))
    codes = F.create_map(*[F.lit(x) for kv in TO_CODE.items() for x in kv])
    first = F.try_element_at(codes, F.split(low, r"[-_ (]").getItem(0))
    words = F.filter(F.split(low, r"[^\p{L}]+"), lambda w: F.length(w) > 3)
    named = F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(codes, w)), lambda c: c.isNotNull()))
    return F.when(F.size(named) < 2, F.coalesce(first, F.try_element_at(named, F.lit(1))))
