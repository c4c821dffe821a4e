"""Training-corpus pipeline over ``documents``: language, near duplicates, benchmark passages, secrets,
token ids. Counted as part of the subpackage ``riskbook.llm``.

Each stage takes what its predecessor kept, written as Parquet and read again, and calls one operator.
All but the last return the columns of ``documents``.

Defined cases: null texts, texts without letters and texts of which more than half of the letters fit no
learned language, by script or by trigrams, go in the first stage; rows without an id are never
near duplicates, and rows without words neither; rows that share an id are judged by their texts, each for
itself; of a group of near duplicates exactly one row stays, that with the smallest id, then the smallest
hash of the text, then the smallest other columns; an empty table passes through all stages.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbook.llm import bpe, decontaminate, jaccard, langid, secret_ledger
from riskbook.llm.common import remainder_is, table
from riskbook.session import scratch_folder

#: Most of a kept document's letters that may be in words that no learned language fits, as a share.
MOST_UNFIT_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is a learned one; the model is fitted on this stage's input."""
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~remainder_is("doc_id", 5, 0))
    named = docs.select(F.struct(*docs.columns).alias("row"))
    out = langid.identify(named, model, id_col="row", text_col="row.text", with_spans=False)
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("unfit") <= MOST_UNFIT_SHARE)).select("id.*")


def row_key(docs: DataFrame) -> Column:
    """Text that stands for (doc_id, text) and sorts by doc_id first; null without an id."""
    place = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(place, F.md5(F.coalesce("text", F.lit(""))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id. Texts without words stay."""
    keyed = docs.withColumn("key", row_key(docs))
    found = jaccard.jaccard_links(keyed, id_col="key")
    gone = found.where("id is not null and n_shingles > 0 and id != component").select(F.col("id").alias("key")).distinct()
    alone = F.col("key").isNull() | ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = keyed.where(~alone).groupBy("key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return keyed.where(alone).select(docs.columns).unionByName(one.join(gone, "key", "left_anti").select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth."""
    named = docs.select(F.struct(*docs.columns).alias("row"))
    found = decontaminate.find_contamination(named, table(spark, sf_dir, "benchmark"), id_col="row", text_col="row.text")
    return decontaminate.with_decision(found).where(~F.col("contaminated")).select("id.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by its kind; n_chars follows the text."""
    ledger = secret_ledger.BlobLedger(spark, scratch_folder(spark, "blob-ledger"))
    ledger.ingest(docs, "pipeline")
    per_blob = ledger.findings().groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("start", "no", "end", "kind", "version"))).alias("spans"))
    blob = secret_ledger.blob_of(F.coalesce("text", F.lit("")))
    clean = secret_ledger.redact(docs.withColumn("blob", blob).join(per_blob, "blob", "left"), "spans")
    return clean.select(*[F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias(c)
                          if c == "n_chars" else F.col(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document, and whether the ids give its text back byte by byte."""
    import public_tokenizers
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    named = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).alias("row"), "text")
    out = bpe.decode(bpe.encode(named, ranks, public_tokenizers.PATTERN, id_col="row"), ranks)
    return out.select("id.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      (F.sha2("decoded", 256) == F.col("id.sha256")).alias("round_trip"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated),
          ("without_secrets", without_secrets), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's output is a Parquet folder in the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    base = scratch_folder(spark, "corpus-pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


#: The language model can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
