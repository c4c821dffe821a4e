"""Secret scans over an incremental blob ledger; DataFrame and SQL functions only.

Every version of a text is addressed by the SHA-256 of its content (its blob). The ledger holds
which rules, in which version, have scanned which blob. A batch scans only the pairs of blob and
rule version that the ledger lacks; findings belong to the blob and are joined back to all paths
that hold it, so a text that occurs a million times is scanned once.

Defined cases: a null text is the empty blob; repeated rows and ids each get their blob's findings;
columns of the input other than the named ones are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskbook.llm.common import keyed_text


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` from left to right without overlap; those whose ``group`` is shorter
    than ``min_chars`` are dropped afterwards."""
    kind: str
    version: int
    pattern: str
    group: int
    min_chars: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values. A shorter run of hex digits, or of characters after AKIA, can't hold a longer one,
#: so the least length stands in the pattern; for assignments it can't, as failing matches use up text.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+", 0, 20),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (blob, kind, version, start, end) of the columns ``blob``, ``text`` and ``todo``
    (keys of the rules to apply). Offsets are code points, end exclusive.

    No built-in gives the places of all matches: the gaps between them (``split``) and the matches
    alternate, so a running sum over both lengths is the place. Only found matches are shuffled.
    """
    text = F.col("text")
    found = []
    for no, r in enumerate(rules):
        whole = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        group = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)) if r.group else whole
        lengths = F.arrays_zip(
            F.transform(whole, F.length).alias("chars"), F.transform(group, F.length).alias("checked"),
            F.transform(F.split(text, r.pattern, -1), F.length).alias("gap"))
        found.append(F.when(
            F.array_contains("todo", r.key) & text.rlike(r.pattern),
            F.struct(F.lit(no).alias("no"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                     F.lit(r.min_chars).alias("least"), lengths.alias("m"))))
    hits = (blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("r"))
            .select("blob", "r.no", "r.kind", "r.version", "r.least", F.posexplode("r.m").alias("pos", "m"))
            .where(F.col("m.chars").isNotNull()))  # the gap after the last match has none
    upto = Window.partitionBy("blob", "no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (hits.withColumn("end", F.sum(F.col("m.gap") + F.col("m.chars")).over(upto))
            .where(F.col("m.checked") >= F.col("least"))
            .select("blob", "no", "kind", "version", (F.col("end") - F.col("m.chars")).alias("start"), "end"))


class BlobLedger:
    """Ledger in a folder that driver and executors share: ``scanned`` (blob, rules) and
    ``findings`` (blob, no, kind, version, start, end), one sub-folder a batch.

    A batch writes its findings first and ``scanned`` last, whose success mark commits it. A batch that
    died is run again under its name and overwrites its own folders; one that is committed is skipped;
    the same versions under another name hold nothing unseen and change nothing.
    """

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return (self._read("scanned", "blob binary, rules array<string>")
                .groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules")))

    def unseen(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Blobs with the rules (``todo``) that haven't scanned them yet; one row a blob."""
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        blobs = (keyed_text(versions, id_col, text_col).select(blob_of(F.col("text")).alias("blob"), "text")
                 .dropDuplicates(["blob"]))
        return (blobs.join(self.scanned(), "blob", "left")
                .select("blob", "text", F.array_except(keys, F.coalesce("rules", F.array().cast("array<string>"))).alias("todo"))
                .where(F.size("todo") > 0))

    def ingest(self, versions: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> bool:
        """Scan what the ledger hasn't seen of these versions, then record it; False if the batch is
        committed already."""
        if self._exists(f"scanned/{batch}/_SUCCESS"):
            return False
        todo = self.unseen(versions, id_col, text_col)
        (scan(todo, self.rules).write.mode("overwrite").parquet(f"{self.path}/findings/{batch}"))
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        (keyed_text(versions, id_col, text_col).select(blob_of(F.col("text")).alias("blob")).distinct()
         .withColumn("rules", keys).write.mode("overwrite").parquet(f"{self.path}/scanned/{batch}"))
        return True

    def findings(self) -> DataFrame:
        """Findings of the ledger's current rules."""
        current = F.concat_ws("@", "kind", "version").isin([r.key for r in self.rules])
        return (self._read("findings", "blob binary, no int, kind string, version int, start long, end long")
                .where(current).distinct())

    def by_path(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, spans): the findings of each row's blob, ordered by start, then by the rules' order;
        an empty array without findings. All paths of a blob get them."""
        per_blob = (self.findings().groupBy("blob")
                    .agg(F.sort_array(F.collect_list(F.struct("start", "no", "end", "kind", "version"))).alias("spans")))
        empty = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string,version:int>>")
        paths = keyed_text(versions, id_col, text_col).select("id", blob_of(F.col("text")).alias("blob"))
        return paths.join(per_blob, "blob", "left").select("id", F.coalesce("spans", empty).alias("spans"))


def redact(df: DataFrame, spans: str, text_col: str = "text") -> DataFrame:
    """``text_col`` with every finding in the column ``spans`` (as of ``by_path``) replaced by [KIND].

    Overlapping findings become one, named by the first. Rows without findings stay as they are.
    """
    text = F.col(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        keep = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], F.array(keep, mark)).alias("out"))

    whole = F.aggregate(F.col(spans), start, step,
                        lambda acc: F.concat(F.concat_ws("", acc["out"]),
                                             F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text))
