"""Problems 1 to 5 and 9: alignment, truncation, forms, pairs, languages, repetition."""

import itertools

import numpy as np
import pytest

from benchloom.llm import common, endings, p1_alignment, p2_truncation, p3_forms, p4_pairs, p5_language, p9_repetition
from benchloom.llm.labels import canonical_label
from benchloom.llm.language import LanguageModel, without_asides

C = "id string, language string, title string, abstract string, description string, first_claim string, context string, publication_number string, country_code string, publication_date string, source string, ipc_codes string"


def test_sentences():
    text = "One (see e.g. Fig. 2). Zwei? 三。四！x"
    assert [text[a:b].strip() for a, b in common.sentence_spans(text)] == ["One (see e.g.", "Fig.", "2).", "Zwei?", "三。", "四！", "x"]
    assert common.sentence_spans("  ") == [] and common.sentence_spans("") == []


def test_bounded_sample(spark):
    df = spark.range(5000).selectExpr("cast(id as string) id", "if(id % 10 = 0, 'x', 'y') g")
    got = common.bounded_sample(df.repartition(7), "id", 40, "g")
    assert sorted({r.g: sum(q.g == r.g for q in got) for r in got}.items()) == [("x", 40), ("y", 40)]
    assert [r.id for r in got] == [r.id for r in common.bounded_sample(df.repartition(3), "id", 40, "g")]
    assert common.bounded_sample(df.limit(0), "id", 5) == [] and common.bounded_sample(df.limit(0), "id", 5, "g") == []


# ---------------------------------------------------------------- 3


LOOKS = [
    ("Coating with zinc", "Ｃｏａｔｉｎｇ　ｗｉｔｈ　ｚｉｎｃ"),
    ("Coating with zinc", "Cоаting with zinс"),
    ("Coating with zinc", "Coat​ing with zi­nc"),
    ("Système 2", "Système 2"),
    ("purify", "puriﬁ⁠".replace("⁠", "") + ""),
    ("高度用", "⾼度⽤"),
    ("Größe", "Grӧße"),
    ("half-life", "half‑life"),
]


def test_forms(spark):
    rows = [(f"{i}{s}", a, None) for i, pair in enumerate(LOOKS) for s, a in zip("ab", pair)]
    rows[9] = ("4b", "puriﬁy", None)
    rows[8] = ("4a", "purifiy", None)
    rows += [("n1", None, ""), ("n2", "", None), ("k1", "K2CO3", "ab"), ("k2", "K₂CO₃", "aB"), ("s1", "Straße", None), ("s2", "Strasse", None), ("e1", "resume", None), ("e2", "résumé", None)]
    df = spark.createDataFrame([*rows, rows[0]], "id string, title string, abstract string")
    got = {(r.id_1, r.id_2, r.field) for r in p3_forms.same_look(df).collect()}
    want = {(f"{i}a", f"{i}b", "title") for i in range(len(LOOKS))} | set()
    base = [k for k, t, _ in rows if k[0] in "012" and k[1] in "ab"]
    text = {k: t for k, t, _ in rows}
    want |= {(x, y, "title") for x, y in itertools.combinations(sorted(base), 2) if text[x] != text[y]}
    assert got == want
    forms = {(r.id, r.field): r.form for r in p3_forms.consistent(df).collect()}
    assert forms["n1", "title"] is None and forms["n2", "title"] == "" and forms["0b", "title"] == "Coating with zinc"
    assert p3_forms.same_look(df.limit(0)).collect() == []


def test_copies_of_one_form_make_no_pairs(spark):
    df = spark.range(2000).selectExpr("cast(id as string) id", "if(id = 7, 'zinс', 'zinc') title", "cast(null as string) abstract")
    assert p3_forms.same_look(df).count() == 1999
    got = p3_forms.classes(df)
    assert got.count() == 2000 and {(r.n_ids, r.n_texts) for r in got.select("n_ids", "n_texts").distinct().collect()} == {(2000, 2)}
    assert p3_forms.classes(df.where("id != '7'")).count() == 0


# ---------------------------------------------------------------- 9


def brute_share(text):
    import re

    han = sum("㐀" <= c <= "鿿" for c in text)
    words, k = (([c for c in text.lower() if c.isalnum()], 12) if text and han > len(text) / 3 else (re.findall(r"[^\W_]+", text.lower()), 6))
    seen, hit = set(), [False] * len(words)
    for i in range(len(words) - k + 1):
        run = tuple(words[i : i + k])
        if run in seen:
            hit[i : i + k] = [True] * k
        seen.add(run)
    return sum(hit) / len(words) if words else 0


def test_repetition(spark):
    base = "The foam has a density of 15.8 kilograms per cubic metre and sets early."
    texts = [None, "", " \n", base, f"{base} {base.upper()}", " ".join([base, "Other words stand here for a while, not the same at all."]), "催化剂由负载在氧化锌上的氯化钠组成。" * 3, "a " * 40, "x_y 1_2 " * 9, "word " * 5]
    df = spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, share string")
    got = {r.doc_id: r for r in p9_repetition.measure(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_share(t or "")
        assert got[i].share is None and want < 0.25 or got[i].share == pytest.approx(want)
    assert p9_repetition.measure(df.limit(0)).collect() == []


def test_repetition_equals_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in p9_repetition.measure(docs).collect():
        want = brute_share(text[r.doc_id] or "")
        assert (r.share is None and want < 0.25) or r.share == pytest.approx(want)


def test_repetition_is_counted_whatever_the_distance(spark):
    once = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(350))
    df = spark.createDataFrame([(1, f"{once} {once}", "en")], "doc_id bigint, text string, lang string")
    got = p9_repetition.measure(df).first()  # the only reference is the text itself
    assert got.n_words == 700 and got.js_words < 0.08
    assert got.share == pytest.approx(0.5)


def test_windows_at_distance_zero_hold_every_repeated_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = p9_repetition.measure(docs).collect()
    assert all(r.share is not None and r.window_share >= r.share for r in rows) and any(r.window_share < 0.25 for r in rows)
    found = {r.doc_id for r in p9_repetition.repetitive(docs).collect()}
    assert found == {r.doc_id for r in rows if r.share >= p9_repetition.SHARE} != set()
    a, b, c = np.array([0.5, 0.5, 0]), np.array([0.5, 0.5, 0]), np.array([0.5, 0.25, 0.25])
    far = lambda x, y: p9_repetition.js_distance(np.zeros(len(x), int), np.arange(len(x)), x, 1, y[None, :])[0]
    assert far(a[:2], b) == pytest.approx(0) and far(a[:2], c) > 0.05


def test_references_are_counted_over_all_documents(spark):
    """The words of the last 50 of 1,300 documents are as much of the reference as those of the first."""
    texts = ["alpha beta gamma 7"] * 1250 + [f"delta w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)]
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, language string").repartition(5)
    refs = p9_repetition.References(df)
    assert len(refs.vocab) == 54
    total = 4 * 1250 + 2 * 50
    assert sorted(refs.words[0].round(9)) == sorted(round(n / total, 9) for n in [1250] * 4 + [50] + [1] * 50 + [0])
    again = p9_repetition.References(df.repartition(2), 3)
    assert len(again.vocab) == 3 and again.words[0][-2:] == pytest.approx([1250 / total, 100 / total]) and np.array_equal(again.kinds, refs.kinds)


def test_distances_are_those_to_all_documents(spark):
    rows = [(i, "alpha beta gamma 7" if i % 26 else f"delta w{chr(97 + i // 26)}", "en") for i in range(676)]
    got = p9_repetition.measure(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)).where("doc_id = 1").first()
    total = 4 * 650 + 2 * 26
    p, q = np.array([0.25] * 4 + [0] * 27), np.array([650] * 4 + [26] + [1] * 26) / total
    kl = lambda x: np.sum(x[x > 0] * np.log2(x[x > 0] / ((p + q) / 2)[x > 0]))
    assert got.js_words == pytest.approx((kl(p) + kl(q)) / 2, rel=1e-9)


# ---------------------------------------------------------------- 5 and 4


SENTENCES = {
    "en": ["The mixture is heated to 90 degrees and stirred for an hour.", "The catalyst consists of zinc oxide supported on silica.", "Films coated with the product keep their gloss."],
    "de": ["Das Gemisch wird auf 90 Grad erhitzt und eine Stunde gerührt.", "Der Katalysator besteht aus Zinkoxid, aufgebracht auf Kieselgel.", "Mit dem Produkt beschichtete Folien behalten ihren Glanz."],
    "fr": ["Le mélange est chauffé à 90 degrés et agité pendant une heure.", "Le catalyseur se compose d'oxyde de zinc déposé sur silice.", "Les films revêtus du produit conservent leur brillant."],
    "es": ["La mezcla se calienta a 90 grados y se agita durante una hora.", "El catalizador consta de óxido de zinc soportado sobre sílice.", "Las películas recubiertas con el producto conservan su brillo."],
    "zh": ["将混合物加热至90度并搅拌一小时。", "催化剂由负载在硅胶上的氧化锌组成。", "涂有该产品的薄膜保持光泽。"],
    "it": ["La miscela viene riscaldata a 90 gradi e agitata per un'ora.", "Il catalizzatore è costituito da ossido di zinco su gel di silice.", "Le pellicole rivestite con il prodotto conservano la brillantezza."],
    "pt": ["A mistura é aquecida a 90 graus e agitada durante uma hora.", "O catalisador consiste em óxido de zinco suportado em sílica.", "As películas revestidas com o produto mantêm o seu brilho."],
}


def corpus(spark, rows):
    base = dict.fromkeys([c.split()[0] for c in C.split(", ")])
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], C)


def test_labels(spark):
    labels = ["EN", " en-GB", "eng", "zh_Hans", "Deutsch", "français", "por", "und", "", None, "mul", "?", "nl", "Simplified Chinese", "English, German", "en/de", "pt-BR"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string")
    from pyspark.sql import functions as F

    got = [r.c for r in df.select("i", canonical_label(F.col("l")).alias("c")).orderBy("i").collect()]
    assert got == ["en", "en", "en", "zh", "de", "fr", "pt", None, None, None, None, None, "nl", "zh", None, None, "pt"]


def test_unnamed_languages(spark):
    train = [{"id": f"{k}{i}", "language": k, "abstract": " ".join(v), "description": " ".join(reversed(v))} for k, v in SENTENCES.items() for i in range(3)]
    rows = train + [
        {"id": "wrong", "language": "de", "abstract": " ".join(SENTENCES["fr"])},
        {"id": "none", "language": "und", "abstract": " ".join(SENTENCES["es"])},
        {"id": "mixed", "language": "English", "abstract": f"{SENTENCES['en'][0]} {SENTENCES['zh'][1]}", "description": ""},
        {"id": "quoted", "language": "en", "abstract": "The film keeps its gloss for a long time in the light (known as “Verfahren zur Herstellung von Folien aus Zinkoxid”)."},
        {"id": "blank", "language": None, "abstract": " 12 ", "description": None},
        {"id": None, "language": None, "abstract": "The text of a row without an id."},
    ]
    df = corpus(spark, [*rows, rows[0]])
    got = {tuple(r) for r in p5_language.unnamed_languages(df).collect()}
    assert got == {("wrong", "abstract", "fr"), ("none", "abstract", "es"), ("mixed", "abstract", "zh")}
    seg = p5_language.segments(df).where("id = 'mixed'").orderBy("segment").collect()
    assert [(s.segment, s.language) for s in seg] == [(0, "en"), (1, "zh")]
    doc = {(r.id, r.field): r.language for r in p5_language.documents(df).collect()}
    assert doc["wrong", "abstract"] == "fr" and doc["blank", "abstract"] is None
    for f in (p5_language.unnamed_languages, p5_language.segments, p5_language.documents):
        assert f(df.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    corpus_ = spark.read.parquet("/root/testdata/sf0.01/corpus.parquet")
    rows = corpus_.where("language in ('en', 'de', 'fr', 'es', 'zh') and length(abstract) > 80").dropDuplicates(["id"]).select("abstract", "language").collect()
    model = LanguageModel([tuple(r) for r in rows[::2]])
    pieces, _, _, main, _ = p5_language.judge(model, [r.abstract for r in rows[1::2]], [None] * len(rows[1::2]))
    right = np.mean([model.languages[m] == r.language for m, r in zip(main, rows[1::2])])
    assert right > 0.94  # a few labels are wrong


def test_asides():
    assert without_asides("a (b) c “d” e") == "a   c   e" and without_asides("a „b (c) d“ e").split() == ["a", "e"]


def test_unclosed_asides_end_with_their_sentence():
    assert without_asides("One (two three. Four. Five.") == "One . Four. Five."
    assert without_asides("One. Two (cut off") == "One. Two "
    assert without_asides("(one two") == "(one two"
    assert without_asides("Das »Wort« hier. Noch ein Satz.").split() == ["Das", "hier.", "Noch", "ein", "Satz."]
    assert without_asides("a « b » c « d » e").split() == ["a", "c", "e"]
    long = "Ein Satz. " * 50
    for a, b in ("„“", "»«"):
        assert without_asides(f"Vorher {a}{long}Ende{b} nachher. Noch einer.").split() == f"Vorher {long}Ende nachher. Noch einer.".split()


def test_pairs(spark):
    train = [(f"t{k}{i}{n}", k, f"{s} Why is it so?", s) for k, v in SENTENCES.items() for i, s in enumerate(v) for n in range(4)]
    q = "What does the catalyst consist of?"
    rows = [
        ("e1", "en", q, None), ("e2", "en", q, " ​\xa0"), ("e3", "en", q, "N/A"), ("e4", "en", q, "..."), ("e5", None, None, ""),
        ("c1", "en", q, q), ("c2", "en", q, q.lower().rstrip("?")), ("c3", "en", q, f"{q} {q}"), ("c4", "en", q, f'Regarding the question "{q}":'),
        ("r1", "en", q, "I'm sorry, but I cannot answer this question."), ("r2", "de", q, "Leider muss ich die Hilfe ablehnen."), ("r3", "zh", q, "抱歉，我无法回答这个问题。"),
        ("w1", "en", q, SENTENCES["de"][1]), ("w2", "zh", "催化剂由什么组成？催化剂", SENTENCES["fr"][0]),
        ("t1", "en", q, "The catalyst consists of"), ("t2", "en", q, "The mixture is heated to 90 degrees and stirred f…"),
        ("g1", "en", q, SENTENCES["en"][1]), ("g2", "en", q, "47.5 hours"), ("g3", "en", q, f'Regarding the question "{q}": {SENTENCES["en"][1]}'), ("g4", "en", q, "The catalyst cannot be recovered because it dissolves completely."),
    ]
    df = spark.createDataFrame([*train, *rows, rows[0], (None, "en", q, "")], "query_id string, query_language string, question string, answer string")
    got = {r.query_id: r.defect_type for r in p4_pairs.defects(df).collect()}
    name = {"e": "empty", "c": "copied_question", "r": "refusal", "w": "wrong_language", "t": "truncated"}
    got = {k: v for k, v in got.items() if k in {r[0] for r in rows}}
    assert got == {r[0]: name[r[0][0]] for r in rows if r[0][0] in name}
    assert p4_pairs.defects(df.limit(0)).collect() == []


def test_pairs_are_judged_by_all_pairs(spark):
    """Three answers of 6,000 tell that a word is whole and that sentences end after it."""
    q = "Where is the batch stirred?"
    rows = [(str(i), "en", q, f"The mixture of batch number {i} is heated and stirred again.") for i in range(6000)]
    rows += [(f"k{i}", "en", q, f"Batch {i} is stirred in the quixotry. Then it is heated.") for i in range(3)]
    rows += [("whole", "en", q, "Then it is stirred in the quixotry"), ("cut", "en", q, "Then it is stirred in the quixo")]
    df = spark.createDataFrame(rows, "query_id string, query_language string, question string, answer string")
    assert [tuple(r) for r in p4_pairs.defects(df.repartition(5)).collect()] == [("cut", "truncated")]


def test_models_counted_in_tasks_are_whole(spark, sf):
    pairs = spark.read.parquet(f"{sf}/qac.parquet").where("answer is not null").selectExpr("answer", "answer text", "lower(query_language) code")
    rows = [(r.answer, r.code) for r in pairs.collect()]
    want, got = LanguageModel(rows), LanguageModel.of_all(pairs.repartition(5))
    assert np.array_equal(want.log_likelihood, got.log_likelihood) and np.array_equal(want.products, got.products)
    more = pairs.select("answer").union(spark.createDataFrame([("Leider kann ich diese Frage nicht beantworten.",)] * 3, "answer string"))
    a, b = (p4_pairs.RefusalModel.of_all(more.repartition(n)) for n in (3, 7))
    assert a.odds == b.odds != {} and a.prior == b.prior


# ---------------------------------------------------------------- 2


def test_endings():
    text = " ".join(SENTENCES["en"]) + " The yield reaches 5 percent; the yield reaches 7 percent."
    model = endings.EndingModel([text] * 4)
    whole = ["The yield reaches 5 percent.", "The yield reaches 5 percent", "The yield reaches 5 percent  \n", "", "  ", "Done (see “x”)."]
    cut = ["The yield reaches", "The yield rea", "The yield reaches 5 perc…", "The yield [...]", "The yield reaches <p", "The yield &#x2", "The yield \\u00", "The yield (see e.g.", "stirred for Fig.", "a; (b) the yield; (c)", "The mixture is heated to"]
    assert not any(endings.is_cut(model, t) for t in whole)
    assert all(endings.is_cut(model, t) for t in cut)


def test_hidden_limits(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    full = lambda n: " ".join(words[(i * 7 + n) % 11] for i in range(60)) + "."
    rows = [{"id": f"a{n}", "source": "Feed ", "description": (full(n) + "é")[: 200 + n] + "."} for n in range(60)]
    rows += [{"id": f"b{n}", "source": "feed", "description": full(n)[:150]} for n in range(40)]
    rows += [{"id": f"c{n}", "source": "bytes", "first_claim": ("é" * (n % 5) + full(n)).encode()[:120].decode(errors="ignore")} for n in range(40)]
    df = corpus(spark, rows)
    got = {(r.source, r.field, r.encoding, r.limit) for r in p2_truncation.limits(df).collect()}
    assert ("feed", "description", "characters", 150) in got and ("bytes", "first_claim", "utf8_bytes", 120) in got
    rates = {(r.source, r.field): (r.n_values, r.n_cut) for r in p2_truncation.rates(df).collect()}
    assert rates["feed", "description"][0] == 100 and rates["feed", "description"][1] >= 40
    for f in (p2_truncation.limits, p2_truncation.truncated, p2_truncation.rates):
        assert f(df.limit(0)).collect() == []


def test_ends_are_counted_over_all_texts(spark):
    """Three texts of 9,000 tell that a word is whole and that sentences end after it."""
    rows = [(str(i), "feed", None, f"The mixture of batch number {i} is heated and stirred again.", None) for i in range(9000)]
    rows += [(f"k{i}", "feed", None, f"Batch {i} is stirred in the quixotry. Then it is heated.", None) for i in range(3)]
    rows += [("whole", "feed", None, "Then it is stirred in the quixotry", None), ("cut", "feed", None, "Then it is stirred in the quixo", None)]
    df = spark.createDataFrame(rows, "id string, source string, title string, description string, first_claim string")
    assert [tuple(r) for r in p2_truncation.truncated(df.repartition(5)).collect()] == [("cut", "description")]


def test_counts_in_tasks_equal_those_in_memory(spark, sf):
    corpus = spark.read.parquet(f"{sf}/corpus.parquet")
    each = p2_truncation.values(corpus)
    texts = each.select("text").distinct()
    known = endings.vocabulary(texts.repartition(3))
    model = endings.EndingModel([r.text for r in texts.collect()])
    assert known.words == model.vocabulary.words and known.name_endings == model.vocabulary.name_endings
    rows = each.select("id", "text").distinct().collect()
    found = [(*endings.verdict(known, r.text), 0.25) for r in rows]
    open_ = endings.open_rows(endings.Grams(known), found)
    df = spark.createDataFrame([(r.id, *v) for r, *v in zip(rows, *(c.to_pylist() for c in open_))], f"id string, {endings.OPEN}")
    got = sorted(r.id for r in endings.decided(texts.repartition(5), known, df.repartition(3), ["id"]).collect())
    assert got == sorted(r.id for r in rows if endings.is_cut(model, r.text)) != []


# ---------------------------------------------------------------- 1


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = rng.random((rng.integers(1, 5), rng.integers(1, 5))) - 0.3
        got = sum(w[i, j] for i, j in p1_alignment.assign(w))
        n, m = w.shape
        best = 0.0
        for k in range(1, min(n, m) + 1):
            for a in itertools.combinations(range(n), k):
                best = max(best, max(sum(w[i, j] for i, j in zip(a, b)) for b in itertools.permutations(range(m), k)))
        assert got == pytest.approx(best)
    assert p1_alignment.assign(np.zeros((0, 3))) == []
    far = np.full((400, 400), -1.0)  # many small parts: each is solved on its own
    far[np.arange(400), np.arange(400)] = 1.0
    far[1::2, :][np.arange(200), np.arange(0, 400, 2)] = 1.5
    assert len(p1_alignment.assign(far)) >= 200


def test_numbers():
    agree = p1_alignment.agree
    assert agree([46.6], [47.0]) >= 1 and agree([46.6], [46.6]) >= 1 and agree([46.6], [12.0]) < 0.5 and agree([], [3.0]) < 0.5 and agree([], []) == 1


def test_alignment(spark):
    en = ["The yield of the product reaches {} percent", "The mixture is heated to {} degrees", "An excess of zinc speeds up the conversion", "Films keep their gloss after {} days", "The foam has a density of {} grams"]
    de = ["Die Ausbeute an Produkt erreicht {} Prozent", "Das Gemisch wird auf {} Grad erhitzt", "Ein Überschuss an Zink beschleunigt den Umsatz", "Folien behalten ihren Glanz nach {} Tagen", "Der Schaum hat eine Dichte von {} Gramm"]
    rows, truth = [], set()
    for p in range(80):
        facts = [(p + k) % 5 for k in range(3)]
        a = [en[f].format(10 * f + p % 7) for f in facts]
        b = [de[f].format(10 * f + p % 7) for f in reversed(facts)]
        rows.append({"id": f"P{p:03}_en", "language": "en", "publication_number": f"P{p:03}", "abstract": ". ".join(a) + "."})
        rows.append({"id": f"P{p:03}_de", "language": "de", "publication_number": f"P{p:03}", "abstract": f"{b[0]}, und {b[1]}. {b[2]}."})
        truth |= {(f"P{p:03}_de", 1, f"P{p:03}_en", 0), (f"P{p:03}_de", 0, f"P{p:03}_en", 1), (f"P{p:03}_de", 0, f"P{p:03}_en", 2)}
    rows += [{"id": "L1", "language": "en", "publication_number": "EP-0000000-A0", "abstract": rows[0]["abstract"]}, {"id": "L2", "language": "de", "publication_number": "EP-0000000-A0", "abstract": rows[1]["abstract"]}]
    rows += [{"id": "N1", "language": "en", "publication_number": None, "abstract": "x"}, {"id": "N2", "language": "en", "publication_number": "P000", "abstract": None}, rows[0]]
    df = corpus(spark, rows)
    got = {(r.id_1, r.sent_1, r.id_2, r.sent_2) for r in p1_alignment.align(df).collect()}
    assert len(got & truth) > 0.97 * len(truth) and len(got - truth) < 0.03 * len(truth)
    assert p1_alignment.align(df.limit(0)).collect() == []


def test_merged_spans_without_a_joining_word():
    """Two sentences that the other text says in one, by whatever wording, are both paired with it."""
    h = p1_alignment.word_hash
    code = lambda cs: p1_alignment.Document(p1_alignment.encode(" ".join(cs)))
    count = np.full(12, 50.0)
    name = lambda i: "abcdefghijkl"[i] * 4
    ids, partner = np.array([h(name(i)) for i in range(12)]), np.array([h("v" + name(i)) for i in range(12)])
    for cells in (p1_alignment.Lexicon.CELLS, 0):  # as a matrix and as sorted keys
        old, p1_alignment.Lexicon.CELLS = p1_alignment.Lexicon.CELLS, cells
        lexicon = p1_alignment.Lexicon((ids, partner, np.full(12, 255)), p1_alignment._columns(ids, count), p1_alignment._columns(partner, count))
        p1_alignment.Lexicon.CELLS = old
        s = lambda a, b, v="": " ".join(v + name(i) for i in range(a, b))
        x = code([s(0, 4) + ".", s(4, 8) + ".", s(8, 12) + "."])
        y = code([s(8, 12, "v") + ".", f"{s(0, 4, 'v')} whereupon {s(4, 8, 'v')}."])
        assert {(a, b) for a, b, _ in lexicon.align(x, y)} == {(0, 1), (1, 1), (2, 0)}
        z = code([f"{s(0, 4)} whereupon {s(4, 8)}.", s(8, 12) + "."])
        w = code([s(0, 4, "v") + ".", s(4, 8, "v") + "."])
        assert {(a, b) for a, b, _ in lexicon.align(z, w)} == {(0, 0), (0, 1)}


def test_alignment_beyond_the_broadcast_bound(spark, sf, monkeypatch):
    corpus = spark.read.parquet(f"{sf}/corpus.parquet")
    run = lambda: {tuple(r) for r in p1_alignment.align(corpus).collect()}
    want = run()
    monkeypatch.setattr(p1_alignment, "BROADCAST_ENTRIES", 0)
    assert run() == want != set()


def test_a_sample_takes_a_hot_key_once(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) k", "if(id % 2 = 0, 'en', 'de') lang", "cast(id as string) t")
    rows = common.bounded_sample(df, "k", 5000)
    assert len(rows) == 2001 and sum(r.k == "hot" for r in rows) == 1
    assert len(common.bounded_sample(df, "k", 50)) <= 50
    assert max(sum(r.lang == x for r in common.bounded_sample(df, "k", 40, "lang")) for x in ("en", "de")) <= 40
    again = common.bounded_sample(df.repartition(7), "k", 50)
    assert [tuple(r) for r in again] == [tuple(r) for r in common.bounded_sample(df, "k", 50)]
