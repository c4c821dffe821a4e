"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch is a set of signed changes: +1 inserts a document's count, -1 takes it back, and a revised count
is both. A batch is summed by its dimensions before anything is kept, and its sums are written to a
folder of the batch's name; totals add up all batches. A batch that comes again under its name replaces
nothing: its folder is there, so it is skipped; one that died in between left no success mark and is
written anew. Batches are never folded together, so reading the totals grows with their number.

Defined cases: null source and language are dimensions of their own; null text has no tokens; repeated
rows each count; dimensions whose documents and tokens come to 0 disappear; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = ("source", "lang", "version")
_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def word_tokens(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_and_mark_tokens(text: Column) -> Column:
    """Runs of letters and digits (ASCII and all beyond it), and single ASCII marks."""
    return F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]")).cast("long")


#: Counts of a text, by version.
TOKENIZERS = {"words-1": word_tokens, "marks-1": word_and_mark_tokens}


def changes(df: DataFrame, sign: int, versions: dict[str, Column], source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One signed change for each row and version; ``versions``: the count columns by name."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for v, c in versions.items()]))
    return (df.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), each.alias("e"))
            .select("source", "lang", "e.version", F.lit(sign).cast("long").alias("n_docs"), (F.col("e.n") * sign).alias("n_tokens")))


def summed(rows: DataFrame) -> DataFrame:
    return (rows.groupBy(*DIMS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs != 0 or n_tokens != 0"))


class TokenRollup:
    """Totals in a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def committed(self, batch: str) -> bool:
        mark = self._path(f"batches/{batch}/_SUCCESS")
        fs = mark.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(mark)

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch of changes; False if it has been added before."""
        if self.committed(batch):
            return False
        summed(rows).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _batches(self) -> list[str]:
        root = self._path("batches")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if fs.exists(self._path(f"batches/{n}/_SUCCESS")))

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens)."""
        paths = [f"{self.path}/batches/{b}" for b in self._batches()]
        return summed(self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA))
