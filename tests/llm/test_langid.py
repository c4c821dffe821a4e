import itertools

import numpy as np
from pyspark.sql import functions as F

from riskbook.llm import langid
from tests.llm.helpers import docs_frame


def best_path(scores, switch):
    n, k = scores.shape
    value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in itertools.pairwise(p))
    return max(value(p) for p in itertools.product(range(k), repeat=n))


def test_viterbi_finds_a_best_labelling():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(0, 7, size=4)
        scores = -rng.exponential(2.0, size=(int(sizes.sum()), 3))
        labels = langid.viterbi(scores, sizes, switch=2.5)
        at = 0
        for n in sizes:
            mine, s = labels[at:at + n], scores[at:at + n]
            if n:
                got = s[np.arange(n), mine].sum() - 2.5 * (mine[1:] != mine[:-1]).sum()
                assert abs(got - best_path(s, 2.5)) < 1e-9
            at += n


def labelled(spark):
    en = "the house and the garden with that thing which they have there through the weather "
    fr = "le château est dans la forêt avec les oiseaux qui étaient très heureux pour cette journée "
    ru = "это дом и сад где они были вчера вечером после работы "
    rows = [(i, t * 3, lang) for i, (t, lang) in enumerate([(en, "en"), (fr, "fr"), (ru, "ru")] * 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_spans_and_awkward_rows(spark):
    model = langid.fit(labelled(spark), F.lit(True))
    mixed = "the garden and the weather through that house, дом и сад где они были вчера"
    texts = [(1, "they have the house and that garden"), (2, "les oiseaux étaient dans la forêt"), (3, mixed), (4, None), (5, ""),
             (6, "12 + 34 !!"), (6, "12 + 34 !!"), (None, "дом и сад"), (8, "the house " * 30_000)]
    got = sorted(((r["id"], r["lang_pred"], r["score"], r["spans"]) for r in langid.identify(docs_frame(spark, texts), model).collect()),
                 key=lambda r: (r[0] is None, r[0]))
    assert [r[1] for r in got] == ["en", "fr", "en", "und", "und", "und", "und", "en", "ru"]
    assert [r[2] for r in got[3:7]] == [0.0] * 4 and all(0 < r[2] <= 1 for r in got[:3])
    spans = got[2][3]
    assert [s["lang"] for s in spans] == ["en", "ru"]
    assert mixed[spans[0]["start"]:spans[0]["end"]].startswith("the garden") and mixed[spans[1]["start"]:spans[1]["end"]] == "дом и сад где они были вчера"


def test_no_training_rows(spark):
    empty = labelled(spark).where("false")
    model = langid.fit(empty, F.lit(True))
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(docs_frame(spark, [(1, "words")]), model).collect()[0]["lang_pred"] == "und"


def test_held_out_accuracy(spark):
    from riskbook.llm.queries import op1_language_id
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    got = op1_language_id(spark, "/root/testdata/sf0.001").join(docs, "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) and (got["lang_pred"] == got["lang"]).mean() > 0.95


def test_unfit_share_is_that_of_letters_in_foreign_words(spark):
    rng = np.random.default_rng(6)
    made = lambda letters, n: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(n))
    rows = [(k, made("abcdefghijklm" if k % 2 else "abcdefghijkln", 200), "xx" if k % 2 else "yy") for k in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    texts = [(1, made("abcdefghijklm", 50)), (2, made("opqrstuvwxyz", 50)), (3, "abcdef дом"), (4, "дом"), (5, "12"), (6, made("abcdefghijkln", 30) + " " + made("opqrstuvwxyz", 10))]
    got = {r["id"]: r["unfit"] for r in langid.identify(docs_frame(spark, texts), model).collect()}
    assert got[1] < 0.05 and got[2] > 0.9 and abs(got[3] - 1 / 3) < 1e-9 and got[4] == got[5] == 1.0 and abs(got[6] - 0.25) < 0.05


def test_spans_keep_their_places_where_lower_case_is_longer(spark):
    of = {"en": "the house and the garden with that thing which they have there hello", "tr": "büyük şehirde yaşayan insanlar her gün işe gidiyor güzel istanbul"}
    model = langid.fit(spark.createDataFrame([(k, of[lang], lang) for k, lang in enumerate(["en", "tr"] * 20)], "doc_id long, text string, lang string"), F.lit(True))
    text = "İSTANBUL güzel büyük şehirde yaşayan insanlar the house and the garden with that thing which they have there İİ"
    row = langid.identify(docs_frame(spark, [(1, text)]), model).collect()[0]
    cut = text.index("the house")
    assert [(s["start"], s["end"], s["lang"]) for s in row["spans"]][0] == (0, cut - 1, "tr") and row["spans"][1]["start"] == cut
    assert row["spans"][-1]["end"] == len(text)


def test_whole_rows_as_ids_never_become_python_objects(spark):
    """Pipeline: ids that are whole rows stay Arrow columns, so a worker holds the texts of one slice."""
    rows = [(1, "the house is big", None), (2, None, [1.5]), (None, "das haus ist gross", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more array<double>")
    model = langid.fit(spark.createDataFrame([(1, "the house is big and old", "en"), (2, "das haus ist gross und alt", "de")], "doc_id long, text string, lang string"),
                       F.lit(True))
    out = langid.identify(docs.select(F.struct(*docs.columns).alias("row")), model, id_col="row", text_col="row.text")
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    got = sorted(out.select("id.*", "lang_pred", "spans").collect(), key=lambda r: str(r["doc_id"]))
    assert [(r["doc_id"], r["text"], r["more"], r["lang_pred"]) for r in got] == [(1, rows[0][1], None, "en"), (2, None, [1.5], "und"), (None, rows[2][1], [], "de")]
    assert [[tuple(s) for s in r["spans"]] for r in got] == [[(0, 16, "en")], [], [(0, 18, "de")]]
