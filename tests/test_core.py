"""Rules of the core operators on small hand-made frames."""

import gzip
import io
import json
import math
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from benchloom.functions import perturb
from benchloom.functions import text as T
from benchloom.operators import analysis, concepts, corpus, grading, graph, matching, metrics, packaging, variants
from benchloom.plans import registry
from benchloom.sources import archives, files
from benchloom.streaming import ingest


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


# ---------------------------------------------------------------- text


def test_text_functions(spark):
    assert column(spark, ["a  b　c", "", None, " x "], T.word_count) == [3, 0, 0, 1]
    assert column(spark, ["one two three", "short", "unbreakable", None], lambda c: T.truncate_words(c, 9)) == ["one two", "short", "unbreakab", None]
    assert column(spark, ["a &amp;\n b", None], T.clean_text) == ["a & b", ""]
    assert column(spark, ["ﬁlm­ ( x ) , y / z &lt;", None], T.clean_markup_text) == ["film (x), y/z <", ""]
    assert column(spark, ["1. A claim 2. Another", "1) B", None], T.first_claim_of_text) == ["A claim", "B", None]
    assert column(spark, ["<claim n='1'>1. A <b>c</b><chemistry>x</chemistry></claim><claim>2</claim>", "none"], T.first_claim_of_html) == ["A c", ""]
    assert column(spark, ["A61K  9/00 x", "nothing"], T.normalize_code) == ["A61K 9/00", ""]
    assert column(spark, ["EP-1_en", "EP_1_x1", "EP-1-zh", "_"], T.infer_language) == ["en", None, "zh", None]
    assert column(spark, ["Ünïcode Name!", "--"], lambda c: T.name_slug(c)) == ["unicode-name", ""]
    assert column(spark, ["E 290", "R-744", "50-00-0", "200-001-8", "KIH-9201", "CO2", "ethanol"], T.is_code_like) == [True] * 5 + [False] * 2
    assert column(spark, ["zinc (II)", "(x)", "plain"], T.clean_name) == ["zinc", "(x)", "plain"]
    assert column(spark, ["éthanol,", "«x»", "--"], lambda c: F.array_join(T.name_tokens(c), " ")) == ["éthanol", "x", ""]
    assert column(spark, ["```json\n{}\n```", " {} "], T.json_body) == ["{}", "{}"]
    assert column(spark, ["GROẞE ﬁ"], T.nfkc_fold) == ["grosse fi"]


def test_replacement_is_literal(spark):
    df = spark.createDataFrame([("Zinc and zincate, zinc.", "zinc", r"Z$1\n"), ("氧化锌膜", "氧化锌", "ZnO"), ("a.b axb", "a.b", "c"), ("no", "zinc", "x"), (None, "zinc", "x")], "t string, o string, r string")
    got = [r.x for r in df.select(T.replace_term(F.col("t"), F.col("o"), F.col("r")).alias("x")).collect()]
    assert got == [r"Z$1\n and zincate, Z$1\n.", "ZnO膜", "c axb", "no", None]


def test_perturbations(spark):
    one = lambda term, pattern, table: column(spark, [term], lambda c: perturb.exchanged(c, pattern, table))[0]
    assert [one(t, perturb.GREEK_PATTERN, perturb.SPELLINGS) for t in ("β-carotene", "Alpha acid", "x")] == ["beta-carotene", "α acid", None]
    assert [one(t, perturb.CHARGE_PATTERN, perturb.CHARGES) for t in ("iron(II) oxide", "iron(2+)", "x")] == ["iron(2+) oxide", "iron(II)", None]
    terms = ["ethanol", "iron(III) oxide", "ab", None, "", "12"]
    df = spark.createDataFrame([(i, t, f"s{k}") for i, t in enumerate(terms) for k in range(40)], "i int, v string, seed string")
    got = {}
    for r in df.select("i", "v", perturb.perturbed(F.col("v"), F.col("seed")).alias("o")).collect():
        got.setdefault(r.i, set()).add(r.o)
    assert all(None not in got[i] and terms[i] not in got[i] for i in range(3)) and len(got[0]) > 15 and all(got[i] == {None} for i in (3, 4, 5))
    assert any(sorted(x) == sorted("ethanol") for x in got[0]) and any(x.replace("-", "") == "ethanol" for x in got[0]) and any(x.lower() == "ethanol" for x in got[0])


# ---------------------------------------------------------------- corpus


ROW = "id string, language string, title string, abstract string, description string, first_claim string, publication_number string, publication_date string, ipc_codes string"


def test_short_first_record_hides_longer_one(spark):
    df = spark.createDataFrame([("1", "EN", "t", "few", None, None, "P", "1", None), ("2", "en ", "t", "many many words", None, None, "P", "2", None), ("3", "en", None, None, None, None, "Q", "1", None)], ROW)
    assert corpus.preprocess(df, ["en"], 9, 2, ["publication_date"]).count() == 0
    assert corpus.preprocess(df.where("id != '1'"), ["en"], 9, 2, ["publication_date"]).count() == 1


def test_accumulator(spark):
    long = "w " * 60
    rows = [
        ("1", "en", "t", long, None, None, "P", "1", "A61K1/1"), ("2", "en", "t", long + "x", None, None, "P", "2", None), ("3", "de", "t", long, None, None, "P", "1", None),
        ("4", "en", "a solvent", long, None, None, "Q", "1", "B65D1"), ("5", "de", "t", long, None, None, "Q", "1", None), ("6", "en", "t", long, None, None, "R", "1", "B65D1"), ("7", "fr", "t", "short", None, None, "P", "1", None),
    ]
    df = spark.createDataFrame(rows, ROW)
    got = {(r.id, r.label) for r in corpus.materialize(df, ["en", "de", "fr"], 2, False, ["id"]).collect()}
    assert got == {("2", "core"), ("3", "core"), ("4", "related"), ("5", "related")}
    assert {r.id for r in corpus.materialize(df, ["en", "de", "fr"], 2, True, ["id"]).collect()} == {"2", "3"}
    assert corpus.materialize(df.limit(0), ["en"], 2, False, ["id"]).collect() == []


def test_anti_committed_ignores_language(spark):
    new = spark.createDataFrame([("P", "fr"), ("Q", "en")], "publication_number string, language string")
    assert [r.publication_number for r in corpus.anti_committed(new, spark.createDataFrame([("P",)], "publication_number string")).collect()] == ["Q"]


# ---------------------------------------------------------------- graph and names


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def test_closure_of_a_graph_with_many_paths_and_a_cycle(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"), (None, "z")])
    got = {(r.node, r.ancestor): r.depth for r in graph.closure(e).collect()}
    assert got["a", "d"] == 2 and got["a", "e"] == 3 and got["a", "a"] == 0 and got["x", "x"] == 0 and got["x", "y"] == 1
    assert len(got) == 18  # a 5, b 3, c 3, d 2, e 1, x 2, y 2
    assert {r.node for r in graph.leaves(e).collect()} == {"a"}
    assert {r.node for r in graph.descendants(e, "d").collect()} == {"a", "b", "c", "d"}


def test_neighbor_relations(spark):
    got = {(r.node, r.neighbor): r.relation for r in graph.neighbor_relations(edges(spark, [("a", "p"), ("b", "p"), ("b", "a")])).collect()}
    assert got["a", "b"] == "child" and got["b", "a"] == "parent" and got["p", "a"] == "child"
    assert graph.neighbor_relations(edges(spark, [])).collect() == []


def test_terms_at_borders_like_the_pattern(spark):
    """The scan of runs equals the pattern on every pair of a text and a term."""
    texts = ["Zinc-oxide, (x) and ZINC oxide.", "zincate C(2)! xC(2) +a b+a", "氧化锌膜 zinc", "", None, "a  zinc\u00a0oxide", "C(2)", "C(2)x (C(2))", "zinc oxide" * 3, "+a", "zinc " * 50 + "oxide"]
    terms = ["zinc", "Zinc oxide", "(x)", "C(2)", "+a", "锌", "氧化锌", "oxide", "a", "--", "", "zinc-oxide"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    t = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(terms)], "concept string, term string")
    got = {(r.id, r.term) for r in matching.term_hits(docs, t, ("id",)).collect()}
    every = docs.crossJoin(t).where(variants.holds(F.col("text"), F.col("term")))
    assert got == {(r.id, r.term) for r in every.collect() if r.term != "--"} and (0, "(x)") in got and (10, "Zinc oxide") in got


def test_scan_in_compatibility_form_and_beyond_the_broadcast_bound(spark, monkeypatch):
    n = spark.createDataFrame([("c", "en", "zinc oxide", True), ("z", "zh", "氧化锌", False), ("e", "fr", "éthanol", False)], "concept string, lang string, surface string, primary boolean")
    docs = spark.createDataFrame([("1", "ＺＩＮＣ　oxide"), ("2", "含氧化锌的膜"), ("3", "l e\u0301thanol, zinc"), ("4", None), ("5", "zinc oxide zinc oxide")], "id string, text string")
    want = {("1", "c"), ("2", "z"), ("3", "e"), ("5", "c")}
    ix = matching.name_index(n)
    assert {(r.doc, r.concept) for r in matching.scan(docs, ix).collect()} == want
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 0)
    assert {(r.doc, r.concept) for r in matching.scan(docs, ix).collect()} == want
    assert matching.scan(docs.limit(0), ix).collect() == [] and matching.scan(docs, ix.limit(0)).collect() == []


def test_a_swap_is_clean_without_the_whole_word(spark):
    df = spark.createDataFrame([("Aceton", "acetone"), ("sulfate", "Sulfate ion"), ("zinc", "Zinc"), ("zinc", " "), (None, "x"), ("锌", "氧化锌")], "a string, b string")
    assert [r.c for r in df.select(T.clean_swap(F.col("a"), F.col("b")).alias("c")).collect()] == [True, False, False, False, False, False]


def test_lost_publications_share_nothing(spark):
    lost = corpus.LOST_PUBLICATIONS[0]
    df = spark.createDataFrame([("1", "en", "t", "a", None, None, lost, "1", "A61K1"), ("2", "de", "t", "a", None, None, lost, "1", "C07D1")], ROW)
    assert corpus.multilingual(df, 2).count() == 0 and corpus.richest(df, ["id"]).count() == 0 and corpus.merged_codes(df).count() == 0


def test_name_index_rules(spark):
    n = [("c1", "en", "Zinc Oxide", True), ("c2", "en", "Other", True), ("c2", "de", "zinc oxide", False), ("c3", "en", "salt", True), ("c4", "en", "1234", True), ("c5", "en", "abc", True), ("c6", "zh", "锌", False), ("c6", "zh", "氧化锌", False)]
    n += [(f"m{i}", "en", "shared name", False) for i in range(4)] + [(f"n{i}", "en", "nine owners", False) for i in range(9)] + [("u", "en", "family", False), ("v", "en", "family", False)]
    n += [("w", "en", "a b c d e f g h i", False), ("w", "en", "", False)]
    df = spark.createDataFrame(n, "concept string, lang string, surface string, primary boolean")
    closed = graph.closure(edges(spark, [("v", "u")]))
    got = {(r.norm, r.concept) for r in matching.name_index(df, closed).collect()}
    assert got == {("zinc oxide", "c1"), ("other", "c2"), ("氧化锌", "c6"), ("family", "u")}
    assert matching.name_index(df.limit(0), closed).collect() == []


def test_scan(spark):
    index = spark.createDataFrame([("zinc oxide", False, 2, "c1", ["en"]), ("oxide", False, 1, "c2", ["en"]), ("氧化锌", True, 1, "c1", ["zh"])], "norm string, cjk boolean, n_tokens int, concept string, langs array<string>")
    docs = spark.createDataFrame([("1", "A film of Zinc Oxide."), ("2", "oxides"), ("3", "由氧化锌制成"), ("4", None), ("5", ""), ("6", "氧")], "id string, text string")
    hits = matching.scan(docs, index)
    assert {(r.doc, r.concept, r.norm) for r in hits.collect()} == {("1", "c1", "zinc oxide"), ("1", "c2", "oxide"), ("3", "c1", "氧化锌")}
    freq = {r.norm: r.n_docs for r in matching.name_document_frequency(hits).collect()}
    assert freq == {"zinc oxide": 1, "oxide": 1, "氧化锌": 1}
    assert matching.stop_names(matching.name_document_frequency(hits), 6, 1 / 6).collect() == []  # more than, not as many as


def test_hard_negatives_prefer_siblings(spark):
    e = edges(spark, [("a", "p"), ("s", "p")])
    pubs = spark.createDataFrame([("a", "g1"), ("a", "g2"), ("s", "n1"), ("p", "n1"), ("p", "n2"), ("s", "g1")], "concept string, pub string")
    cand = concepts.candidates(pubs, e, 2)
    assert {r.concept for r in cand.collect()} == {"a", "s"}
    got = {(r.concept, r.pub, r.neighbor, r.relation) for r in concepts.hard_negatives(pubs, cand.where("concept = 'a'"), e).collect()}
    assert got == {("a", "n1", "s", "sibling"), ("a", "n2", "p", "parent")}
    assert [r.concept for r in concepts.kept_concepts(pubs, e, 2, 2, 1).collect()] == ["a"]


# ---------------------------------------------------------------- metrics


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([("q", "d1", 0.9), ("q", "d2", 0.8), ("q", "d3", 0.8), ("q", "d4", 0.1), ("z", "d1", 0.5)], "query_id string, corpus_id string, score double")
    rel = spark.createDataFrame([("q", "d2"), ("q", "d4"), ("q", "d9"), ("q", "d2")], "query_id string, corpus_id string")
    hits = metrics.judged(metrics.rank(r, ["query_id"]), rel, ["query_id"])
    (m,) = metrics.per_query(hits, ["query_id"], (2, 10)).collect()
    assert m.recall_2 == pytest.approx(1 / 3) and m.map_2 == pytest.approx((1 / 2) / 2) and m.mrr_2 == 0.5 and m.hit_2 == 1
    assert m.map == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert m.ndcg_10 == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / sum(1 / math.log2(i + 1) for i in (1, 2, 3)))
    assert metrics.per_query(hits.limit(0), ["query_id"]).collect() == []


def test_ranks(spark):
    own = spark.createDataFrame([("q", 0, 0.5), ("q", 1, 0.9)], "query_id string, depth int, score double")
    hay = spark.createDataFrame([("q", 0.5), ("q", 0.6), ("q", 0.7), ("p", 0.99)], "query_id string, score double")
    assert {r.depth: r.rank for r in metrics.rank_against(own, hay, ["query_id"]).collect()} == {0: 3, 1: 1}


def test_confusion(spark):
    r = spark.createDataFrame([("m", "q1", "g", 1), ("m", "q1", "n", 2), ("m", "q2", "n", 1), ("m", "q3", "x", 1), ("m", "q4", "g", 1)], "model string, query_id string, corpus_id string, rank bigint")
    gold = spark.createDataFrame([("q1", "g"), ("q2", "g"), ("q3", "g"), ("q4", "g")], "query_id string, corpus_id string")
    neg = spark.createDataFrame([("q1", "n", "zinc"), ("q2", "n", "tin"), ("q3", "n", "tin")], "query_id string, corpus_id string, neighbor_name string")
    got = {x.query_id: (x.gold_rank, x.negative_rank, x.win, x.neighbor_name) for x in analysis.confusion(r, gold, neg).collect()}
    assert got == {"q1": (1, 2, False, None), "q2": (None, 1, True, "tin")}


def test_cross_language_falls_back_to_all(spark):
    q = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "a"), ("q3", "b")], "`query-id` string, `corpus-id` string").withColumn("score", F.lit(1.0))
    ql = spark.createDataFrame([("q1", "en"), ("q2", "en"), ("q3", None)], "`query-id` string, query_language string")
    cl = spark.createDataFrame([("a", "en"), ("b", "de")], "`corpus-id` string, corpus_language string")
    got = {(r["query-id"], r["corpus-id"]) for r in packaging.cross_language_qrels(q, ql, cl).collect()}
    assert got == {("q1", "b"), ("q2", "a"), ("q3", "b")}


def test_collision_suffix_is_unique(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 3)], "base string, n int")
    assert sorted(r._id for r in packaging.numbered_ids(df, F.col("base"), ["n"]).collect()) == ["a", "a_2", "a_3", "b"]


# ---------------------------------------------------------------- grading


def test_grades(spark):
    body = json.dumps({"scores": [{"grounding": 5, "precision": 4, "numerical_fidelity": None}]})
    df = spark.createDataFrame([("a", f"```json\n{body}\n```"), ("b", "broken"), ("c", None)], "k string, response string")
    got = {(r.k, r.idx): (r.grounding, r.precision, r.numerical_fidelity) for r in grading.normalized_grades(df, ["k"], grading.FAITHFULNESS).collect()}
    assert len(got) == 9 and got["a", 0] == (5, 4, 1) and got["a", 1] == (1, 1, 1) and got["b", 0] == (1, 1, 1)


def test_quotas():
    for n in range(7, 200):
        q = grading.question_quotas(n)
        assert sum(q.values()) == n and q[4] % 4 == 0 and min(q.values()) > 0
    assert grading.question_quotas(52) == {1: 14, 2: 13, 3: 13, 4: 12}
    with pytest.raises(ValueError):
        grading.question_quotas(3)


def test_approval_defaults(spark):
    flags = {**grading.HARD_FLAGS, **grading.SOFT_FLAGS}
    cols = ", ".join(f"{c} boolean" for c in flags) + ", severity string"
    good = dict.fromkeys(flags, True)
    rows = [good | {"severity": "low"}, good | {"fluency_ok": False, "severity": "low"}, good | {"fluency_ok": False, "severity": "odd"}, good | {"terminology_ok": None, "severity": None}, good | {"meaning_ok": None, "severity": "low"}]
    df = spark.createDataFrame([tuple(r[c] for c in [*flags, "severity"]) for r in rows], cols)
    assert [r.approved for r in grading.translation_approval(df).collect()] == [True, True, False, True, False]


def test_provider(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "i int, prompt string")
    assert grading.ask(df, lambda b: b["prompt"].str.upper(), ["i"]).where("response = concat('P', i)").count() == 20
    answers = spark.createDataFrame([(1, "x")], "i int, response string")
    assert grading.offline(df, answers, ["i"]).where("response is not null").count() == 1


# ---------------------------------------------------------------- variants


def test_ladder_properties(spark):
    rows = spark.createDataFrame([("b1", "P", "en", "Zinc, iron and tin", "Iron."), ("b2", "P", "de", "x", "y")], "id string, pub string, language string, title string, abstract string")
    swaps = [(c, "P", "en", c, "b1", "B", "de", f"{c[::-1]}$1") for c in ("zinc", "iron", "tin")] + [("in", "P", "en", "in", "b1", "B", "de", "ni")]
    s = spark.createDataFrame(swaps, "concept string, pub string, anchor_language string, term string, id string, mode string, target string, replacement string")
    labels = spark.createDataFrame([("zinc", "Zinc")], "concept string, name string")
    got = variants.ladder(rows, s.where("concept != 'in'"), labels, 3, 1).orderBy("depth").collect()
    assert [r.depth for r in got] == [0, 1, 2, 3] and got[0].title == "Zinc, iron and tin" and got[3].title == "cniz$1, nori$1 and nit$1" and got[3].abstract == "nori$1."
    assert [len(json.loads(r.replacements_json)) for r in got] == [0, 1, 2, 3]
    assert variants.ladder(rows, s.where("concept in ('tin', 'in')"), labels, 2, 1).collect() == []  # surfaces overlap
    assert variants.ladder(rows, s.limit(0), labels, 2, 1).collect() == []


# ---------------------------------------------------------------- sources


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.xml", "<a/>")
        z.writestr("x__TOC.xml", "<toc/>")
        z.writestr("note.txt", "no")
    outer = io.BytesIO()
    with tarfile.open(fileobj=outer, mode="w") as t:
        for name, data in (("in.zip", inner.getvalue()), ("b.xml", b"<b/>"), ("bad.zip", b"zip?")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "one.tar").write_bytes(outer.getvalue())
    (tmp_path / "two.tgz").write_bytes(gzip.compress(outer.getvalue()))
    (tmp_path / "three.zip").write_bytes(b"broken")
    read = archives.read_archives(spark, str(tmp_path)).collect()
    got = sorted((r.archive.rsplit("/", 1)[1], r.name, bytes(r.content)) for r in read if r.status == "ok")
    assert got == [(a, n, c) for a in ("one.tar", "two.tgz") for n, c in (("a.xml", b"<a/>"), ("b.xml", b"<b/>"))]
    small = list(archives.unpack("one.tar", io.BytesIO(outer.getvalue()), len(outer.getvalue()), most=3))
    assert small and {x[1:] for x in small} == {(None, "oversized")}  # the outer file has no bound
    assert list(archives.unpack("x.zip", io.BytesIO(b"no"), 2)) == [("x.zip", None, "broken")]


def test_snippets_of_all_descriptions(spark, tmp_path):
    long = "[0002] " + "word " * 400
    texts = ["short [0003] text", long, "x" * 1600, "y" * 1500, "", None]
    spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, description string").write.parquet(str(tmp_path / "corpus.parquet"))
    got = {r.id: r.snippet for r in registry.QUERIES["description_snippets"](spark, str(tmp_path)).collect()}
    assert got == {"0": "short text", "1": ("word " * 300)[:-1], "2": "x" * 1500, "3": "y" * 1500, "4": "", "5": None}


def test_round_trips_of_all_rows(spark, tmp_path):
    rows = [
        ("a", "en", "A < B & C", 'x "y" &am', "use of <br"),
        ("b", "zh", "锌", "催化剂", "一种&#x2"),
        ("c", None, " t ", None, "c"),
        ("d", 'n"/a', None, "abstract", " "),
        ("e", "Deutsch", "", " ", None),
    ]
    spark.createDataFrame(rows, "id string, language string, title string, abstract string, first_claim string").write.parquet(str(tmp_path / "corpus.parquet"))
    run = lambda name: {r[0]: tuple(r)[1:] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {k: v[:5] for k, v in run("markup_round_trip").items()} == {
        "a": (True, "en", "A < B & C", 'x "y" &am', "use of <br"),
        "b": (True, "zh", "锌", "催化剂", "一种&#x2"),
        "c": (True, None, "t", None, "c"),
        "d": (False, 'n"/a', None, "abstract", None),
        "e": (False, "Deutsch", None, None, None),
    }
    assert run("record_round_trip") == {
        "a_en": ("A < B & C", 'x "y" &am', "use of <br"),
        "b_en": ("锌", "催化剂", "一种&#x2"),
        "c_en": ("t", "", "c"),
        "d_en": ("", "abstract", ""),
    }
    assert run("html_claims") == {"a": ("use of <br",), "b": ("一种&#x2",), "c": ("c",), "d": ("",), "e": ("",)}


def test_csv_round_trip(spark, tmp_path):
    row = ("1", "en", 'a "quoted"\nline', None, "d,e", "", "c", "P", "EP", "2020", "s", "A|B")
    df = spark.createDataFrame([row], files.CORPUS_SCHEMA)
    files.write_csv(df, str(tmp_path / "c"))
    (got,) = files.read_csv(spark, str(tmp_path / "c")).collect()
    assert tuple(got) == tuple(x or "" for x in row)


def test_records(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"publication_number":"P","title_localized":[{"language":"EN","text":" "},{"language":"en","text":"T"}],"claims_localized":[{"language":"en","text":"1. C 2. D"}],"ipc":[{"code":"A"},{"code":"A"}],"more":1}\n\n{"publication_number":"Q"}\n')
    rows = files.records_to_rows(files.read_records(spark, str(p)), ["en", "de"]).collect()
    assert [(r.id, r.title, r.first_claim, r.ipc_codes, r.context) for r in rows] == [("P_en", "T", "C", "A", "Title: T\n\nFirst claim: C")]


def test_markup(spark):
    good = '<ep-patent-document id="x" doc-number="12" country="EP" kind="A1" date-publ="20200101"><SDOBI><B500><B540><B541>de</B541><B542>Titel</B542><B541>en</B541><B542>Title</B542></B540></B500></SDOBI><abstract lang="en"><p>A  b</p><p>c</p></abstract><abstract lang="en"><p>A b</p><p>c</p></abstract><claims lang="EN"><claim><claim-text>1. One</claim-text></claim><claim><claim-text>2. Two</claim-text></claim></claims><classification-ipcr><text>A61K 9/00 (2006)</text></classification-ipcr></ep-patent-document>'
    df = spark.createDataFrame([(1, good), (2, "<broken"), (3, None)], "i int, xml string")
    got = {r.i: r for r in files.parse_patents(df).collect()}
    r = got[1]
    assert r.valid and r.publication_number == "EP-12-A1" and [(b.language, b.text) for b in r.title_localized] == [("de", "Titel"), ("en", "Title")]
    assert [b.text for b in r.abstract_localized] == ["A b c"] and [b.text for b in r.claims_localized] == ["One"] and r.ipc_codes == ["A61K 9/00"]
    assert not got[2].valid and not got[3].valid


def test_ontology(spark, tmp_path):
    text = 'format-version: 1.2\n\n[Term]\nid: C:1\nname: root\n\n[Term]\nid: C:2\nname: leaf\nalt_id: C:9\nsynonym: "a \\"b\\"" EXACT []\nsynonym: "Brand" RELATED BRAND_NAME []\nsynonym: "no" NARROW []\nis_a: C:1 ! root\nxref: Wikipedia:Leaf "x"\n\n[Term]\nid: C:3\nis_a: C:9\n\n[Term]\nid: C:4\nis_obsolete: true\nis_a: C:1\n\n[Typedef]\nid: t\n'
    with gzip.open(tmp_path / "o.obo.gz", "wt") as f:
        f.write(text)
    nodes, e, alt = files.parse_ontology(files.read_stanzas(spark, str(tmp_path / "o.obo.gz")))
    n = {r.id: r for r in nodes.collect()}
    assert set(n) == {"C:1", "C:2", "C:3"} and n["C:2"].synonyms == ['a "b"'] and n["C:2"].brands == ["Brand"] and n["C:2"].wiki == "Leaf" and n["C:1"].wiki is None
    assert {tuple(r) for r in e.collect()} == {("C:2", "C:1"), ("C:3", "C:2")} and [tuple(r) for r in alt.collect()] == [("C:9", "C:2")]


def test_last_subset_of_predictions_counts(spark):
    body = json.dumps({"mteb_model_meta": {"x": 1}, "s1": {"test": {"q": {"d": 1.0}}}, "s2": {"test": {"q": {"e": 2.0}}}})
    df = spark.createDataFrame([("m", body), ("n", "broken")], "model string, json string")
    assert [tuple(r) for r in files.read_predictions(df).collect()] == [("m", "q", "e", 2.0)]


def test_numeric_metrics(spark):
    df = spark.createDataFrame([(json.dumps({"scores": {"test": [{"ndcg": 0.5, "name": "x", "n": 3}]}}),)], "json string")
    assert files.numeric_metrics(df).first().metrics == {"ndcg": 0.5, "n": 3.0}


def test_parties_and_priorities(spark):
    xml = '<ep-patent-document id="x"><SDOBI><B300><B310>P 1</B310><B320><date>20190101</date></B320></B300><B300><B310>P 2</B310><B310>P 1</B310><B320><date>20190101</date></B320></B300><B700><B710><B711><snm> A </snm></B711><B711><snm>B</snm></B711><B711><snm>A</snm></B711></B710><B720><B721><snm>I</snm></B721></B720></B700><B800><B840><ctry>de</ctry><ctry>FR</ctry><ctry>DE</ctry></B840></B800></SDOBI></ep-patent-document>'
    r = files.parse_patents(spark.createDataFrame([(xml,), ("<x/>",)], "xml string")).collect()
    assert (r[0].applicants, r[0].inventors, r[0].proprietors, r[0].states, r[0].priority_numbers, r[0].priority_dates) == (["A", "B"], ["I"], [], ["DE", "FR"], ["P 1", "P 2"], ["20190101"])
    assert not r[0].valid and r[1].applicants == [] and r[1].priority_dates == []


def test_configs_and_models(spark, tmp_path):
    df = spark.createDataFrame([("1", "t")], "_id string, text string")
    files.write_configs({"corpus": df, "v2-queries": df}, str(tmp_path / "c"))
    assert files.read_config(spark, str(tmp_path / "c"), "corpus", "v2").columns == ["id", "text"]
    assert files.read_config(spark, str(tmp_path / "c"), "queries", "v2").count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_config(spark, str(tmp_path / "c"), "none")
    for m in ("a", "b"):
        (tmp_path / "p" / m).mkdir(parents=True)
        (tmp_path / "p" / m / "x_predictions.json").write_text("{}")
    (tmp_path / "p" / "c").mkdir()
    assert {r.model for r in files.discover_models(spark, str(tmp_path / "p")).collect()} == {"a", "b"}
    assert [r.model for r in files.discover_models(spark, str(tmp_path / "p"), ["b"]).collect()] == ["b"]


def test_alias_graph_files(spark, tmp_path):
    manifest = spark.createDataFrame([("c", "zinc", 2, 3, ["de", "en"], 1)], "concept string, name string, n_gold bigint, n_hard_neg bigint, gold_langs array<string>, n_neighbors bigint")
    gold, neg = spark.createDataFrame([("c", "P")], "concept string, pub string"), spark.createDataFrame([("c", "Q", "d", "sibling")], "concept string, pub string, neighbor string, relation string")
    files.write_alias_graph(manifest, gold, neg, str(tmp_path / "g"))
    back = files.read_alias_graph(spark, str(tmp_path / "g"))
    assert [x.collect() for x in back] == [x.collect() for x in (manifest, gold, neg)]
    doc = {"n_concepts": 1, "concepts": [{"chebi_id": "c", "name": "zinc", "n_gold": 2, "n_hard_neg": 3, "gold_langs": ["de", "en"], "n_neighbors_in_corpus": 1, "gold": ["P"], "hard_negatives": [{"publication_number": "Q", "neighbor_chebi_id": "d", "relation": "sibling"}]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=2))
    assert [x.collect() for x in files.read_alias_graph(spark, str(tmp_path / "g.json"))] == [x.collect() for x in (manifest, gold, neg)]


# ---------------------------------------------------------------- streams


def test_ingest_drops_known_publications_and_repeats_safely(spark, tmp_path):
    src, out, man = (str(tmp_path / x) for x in ("in", "out", "man"))
    schema = "id string, publication_number string"
    for k, rows in enumerate(([("P_en", "P"), ("P_en", "P")], [("P_de", "P"), ("Q_en", "Q")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest(spark, src, schema, out, man, str(tmp_path / "state"))
    assert sorted(r.id for r in spark.read.parquet(f"{out}/batch=*").collect()) == ["P_en", "Q_en"]
    again = spark.createDataFrame([("P_de", "P"), ("Q_en", "Q")], schema)
    assert ingest.append_batch(again, 1, out, man) == 1  # the same batch after a crash
    assert sorted(r.id for r in spark.read.parquet(f"{out}/batch=*").collect()) == ["P_en", "Q_en"]
    assert {r.rows_appended for r in spark.read.parquet(f"{man}/batch=*").collect()} == {1}


def test_windows_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = ingest.tumbling(stream, "1 hour", "10 minutes").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").count() == ingest.tumbling(events, "1 hour", "10 minutes").count()
    once = ingest.without_repeats(stream, "1 day").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == events.select("event_id").distinct().count()


# ---------------------------------------------------------------- generation and reports


def test_generation(spark):
    from benchloom import schemas
    from benchloom.operators import generation as N

    docs = spark.createDataFrame([("d1", "some text"), ("d2", "more")], "doc string, text string")
    pairs = json.dumps({"pairs": [{"question": "Q0", "answer": "A0"}, {"question": "Q1", "answer": "A1"}, {"question": "", "answer": "x"}]})
    score = lambda names, a, b: json.dumps({"scores": [dict.fromkeys(names, a), dict.fromkeys(names, b)]})
    table = lambda body: N.recorded(spark.createDataFrame([("d1", body), ("d2", "broken")], "doc string, response string"))
    graded = N.graded_pairs(docs, ["doc"], "technical", table(pairs), table(score(grading.FAITHFULNESS, 2, 5)), table(score(grading.QUALITY["technical"], 3, 3)))
    assert {(r.idx, r.total_score) for r in graded.collect()} == {(0, 21), (1, 30)}
    assert [r.question for r in N.best_pairs(graded, ["doc"]).collect()] == ["Q1"]
    assert N.with_schema(graded, schemas.graded_qa("technical")).columns == list(schemas.graded_qa("technical"))
    assert (len(schemas.graded_qa("semantic_retrieval")), len(schemas.balanced_qa()), len(schemas.concept_qa())) == (19, 27, 26)  # 29 with the two columns that both modes have
    verdict = lambda b: b.apply(lambda r: json.dumps({"approved": bool(r["attempt"] >= int(r["doc"][1]))}), axis=1)
    done = N.verified(docs, ["doc"], N.live(lambda b: "try " + b["attempt"].astype(str)), N.live(verdict))
    assert {(r.doc, r.attempt, r.response, r.approved) for r in done.collect()} == {("d1", 1, "try 1", True), ("d2", 2, "try 2", True)}
    q = spark.createDataFrame([("Which zinc?", ["Zinc", ""], "zinc"), ("Which metal?", ["Zinc"], "zinc")], "question string, aliases array<string>, term string")
    assert [r.question for r in N.concept_questions(q).collect()] == ["Which metal?"] and [r.question for r in N.term_questions(q).collect()] == ["Which zinc?"]
    v = grading.group_variants(spark.createDataFrame([("s", "c", "t", "B", "1"), ("s", "c", "t", "C", "2"), ("s", "c", "t", "A", "3")], "source_id string, concept string, term string, variant string, id string"))
    one = spark.createDataFrame([("s", "c", "t", "Q")], "source_id string, concept string, term string, question string")
    assert {(r.variant, r.id) for r in N.spread_over_variants(one, v).collect()} == {("B", "1"), ("C", "2")}
    rungs = spark.createDataFrame([("b", 1, "x"), ("b", 0, "y")], "base_id string, depth int, id string")
    assert [r.depth for r in N.spread_over_depths(spark.createDataFrame([("b", "en", "Q")], "base_id string, language string, question string"), rungs).collect()] == [0, 1]


def test_reports(spark, tmp_path):
    from benchloom.operators import reports as P

    m = spark.createDataFrame([("a_1", "main_score", 0.5), ("b", "main_score", 0.7), ("a_1", "zz", 1.0), ("b", "same_language_share@100", 0.2), ("a_1", "same_language_share@100", 0.1)], "model string, metric string, value double")
    lines = P.markdown_table(m).splitlines()
    assert lines[0] == "| # | Model | Main score | same_language_share@100 | zz |" and lines[2] == "| 1 | b | **0.7000** | 0.2000 | - |" and lines[3] == "| 2 | a_1 | 0.5000 | **0.1000** | **1.0000** |"
    assert r"a\_1" in P.latex_table(m) and r"\textbf{0.7000}" in P.latex_table(m)
    P.append_index(P.index_rows(spark, m, "r1", "now", "d", "v", {"corpus": 3}), str(tmp_path / "i"))
    P.append_index(P.index_rows(spark, m, "r2", "now", "d", "v", {"corpus": 3}), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 4
    (tmp_path / "s.json").write_text(json.dumps({"models": [{"model": "a", "main_score": 0.5, "metrics": {"x": 1}}]}))
    assert {tuple(r) for r in P.summary_models(spark, str(tmp_path / "s.json")).collect()} == {("a", "main_score", 0.5), ("a", "x", 1.0)}
    (tmp_path / "res" / "a").mkdir(parents=True)
    (tmp_path / "res" / "a" / "t_cross_language.json").write_text(json.dumps({"scores": {"test": [{"x": 1}]}}))
    assert [(r.model, r.variant, r.metrics) for r in P.raw_results(spark, str(tmp_path / "res")).collect()] == [("a", "cross_language", {"x": 1.0})]
    assert "0.5000" in P.markdown_rows(m.limit(1), "T") and json.loads(P.run_metadata("r", "d", "v", ["a"], {}, {}))["run_id"] == "r" and P.run_id("x").endswith("-x")
