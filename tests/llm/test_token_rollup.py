from pyspark.sql import functions as F

from riskbook.llm import token_rollup
from riskbook.session import scratch_folder


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_batches_add_up_once(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 1), (2, "a, b", "s", None, 1), (2, "a, b", "s", None, 1), (3, None, None, "en", 1)],
                                 "doc_id long, text string, source string, lang string, version int")
    rollup = token_rollup.TokenRollup(spark, scratch_folder(spark, "rollup"))
    assert totals(rollup) == {}
    count = {v: f(F.col("text")) for v, f in token_rollup.TOKENIZERS.items()}
    insert = token_rollup.changes(docs, 1, count)
    assert rollup.commit("one", insert) and not rollup.commit("one", insert)
    assert totals(rollup) == {("s", "en", "words-1"): (1, 3), ("s", None, "words-1"): (2, 4), (None, "en", "words-1"): (1, 0),
                              ("s", "en", "marks-1"): (1, 3), ("s", None, "marks-1"): (2, 6), (None, "en", "marks-1"): (1, 0)}
    rollup.commit("revise", token_rollup.changes(docs.where("doc_id = 1"), -1, count).unionByName(
        token_rollup.changes(docs.where("doc_id = 1"), 1, {"words-1": F.lit(10), "marks-1": F.lit(0)})))
    rollup.commit("delete", token_rollup.changes(docs.where("doc_id != 1"), -1, count))
    rollup.commit("none", insert.where("false"))
    assert totals(rollup) == {("s", "en", "words-1"): (1, 10), ("s", "en", "marks-1"): (1, 0)}


def test_batch_that_died_is_written_anew(spark):
    path = scratch_folder(spark, "rollup")
    rollup = token_rollup.TokenRollup(spark, path)
    rows = token_rollup.changes(spark.createDataFrame([("s", "en")], "source string, lang string"), 1, {"v": F.lit(5)})
    rollup.commit("one", rows)
    fs = rollup._path("").getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(rollup._path("batches/one/_SUCCESS"), False)
    assert totals(rollup) == {}
    assert rollup.commit("one", rows) and totals(rollup) == {("s", "en", "v"): (1, 5)}
