"""The registered queries against their DuckDB oracles, and the pipeline against its operators by hand."""
import os

import duckdb
import pytest

import corpus_pipeline
from riskbook.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), before.schema)
        assert docs.columns == columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        old = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        assert ids <= set(old)
        if name == "near_duplicates":
            from tests.llm.test_jaccard import brute
            comp = brute(list(old.items()))
            assert ids == {int(i) for i, n, c in comp if i == c or not n}
        if name == "decontaminated":
            from tests.llm.test_decontaminate import brute as hit
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert ids == {int(r[0]) for r in hit(list(old.items()), items) if not r[4]}
        if name == "without_secrets":
            from tests.llm.test_secret_ledger import brute as secrets
            assert ids == set(old)
            for r in docs.collect():
                found = secrets(old[r["doc_id"]])
                assert (r["text"] == old[r["doc_id"]]) == (not found)
                assert all(old[r["doc_id"]][a:b] not in r["text"] for a, _, b, _ in found) and r["n_chars"] == len(r["text"])
    last = corpus_pipeline.token_ids(spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.collect()} and all(r["n_tokens"] == len(r["ids"]) for r in last)


def test_pipeline_stands_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the words of a text without id", "en", "s", 30), (4, "the words of a text", "en", "s", 19),
            (4, "the words of a text", "en", "s", 19), (5, "the words of a text", "en", None, 19), (6, "token=abcdef123 and words", "en", "s", 25), (7, "12", "en", "s", 2)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted((r["doc_id"] or -1) for r in docs.collect()) == [-1, 4, 6]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_near_duplicates_judges_rows_that_share_an_id_by_their_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(3, words(1)), (7, words(1) + " end"), (7, words(2)), (7, words(3)), (8, words(3) + " end"), (9, None), (9, " "), (9, ""), (9, words(4)), (9, words(4)),
            (-5, words(5)), (2, words(5)), (10, words(6)), (10, words(6) + " end"), (None, words(1)), (11, words(2) + " end"), (11, words(4) + " end")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", None) for k, (i, t) in enumerate(rows)], schema)
    got = sorted((str(r["doc_id"]), r["text"] or "", r["source"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    of_10 = [r for r in got if r[0] == "10"]
    want = [("None", words(1), "s14"), ("3", words(1), "s0"), ("7", words(2), "s2"), ("7", words(3), "s3"), ("9", "", "s5"), ("9", " ", "s6"), ("9", "", "s7"),
            ("9", words(4), "s8"), ("-5", words(5), "s10")]
    assert len(of_10) == 1 and got == sorted(want + of_10)
    again = corpus_pipeline.near_duplicates(spark, docs.repartition(7, "source"), SF).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", r["source"]) for r in again) == got


def test_language_id_rejects_by_fit_not_by_the_number_of_languages(spark):
    of = {"en": "the house and the garden with that thing which they have there", "fr": "le château est dans la forêt avec les oiseaux heureux",
          "de": "das alte haus steht zwischen den bäumen und wird nicht verkauft", "es": "la casa está cerca del río donde juegan los niños pequeños",
          "it": "gli amici della ragazza vogliono mangiare qualcosa insieme oggi", "tr": "büyük şehirde yaşayan insanlar her gün işe gidiyor",
          "hu": "a régi könyvtárban sokan olvasnak minden délután csendben", "fi": "vanhassa talossa asuu yksinäinen mies joka kirjoittaa kirjoja"}
    strange = ["это дом и сад где они были вчера", "το σπίτι και ο κήπος είναι εδώ", "這是一個很大的房子和花園", "1234 5678"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for langs in (["en", "fr"], ["de", "en", "es", "fr"], sorted(of)):
        learned = [(k, of[lang], lang, "s", None) for k, lang in enumerate(langs * 20)]
        even = " ".join(of[lang] for lang in langs)
        cases = [(None, t, None, "s", None) for t in [*strange, even, f"{of['en']} {strange[0]}", f"это {strange[0]} {strange[0]} the house"]]
        got = {r["text"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(learned + cases, schema), SF).collect()}
        assert got == {*[of[lang] for lang in langs], even, cases[5][1]}


def test_token_ids_are_decoded_and_held_against_the_text(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "naïve <assign> 漢字 \U0001f600", "en", "s", 9), (1, "another", "en", "s", 7), (2, None, "en", "s", None),
                                  (None, "long text " * 9_000, "en", "s", 9)], schema)
    rows = corpus_pipeline.token_ids(spark, docs, SF).collect()
    assert len(rows) == 4 and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    encode = corpus_pipeline.bpe.encode
    monkeypatch.setattr(corpus_pipeline.bpe, "encode", lambda *a, **b: encode(*a, **b).selectExpr("id", "slice(ids, 2, size(ids)) as ids"))
    assert sorted(r["round_trip"] for r in corpus_pipeline.token_ids(spark, docs, SF).collect()) == [False, False, False, True]
