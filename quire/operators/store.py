"""A content-addressed store of versions: each text once, by its hash; a version is a list of ids with hashes; a log says when, why and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import versions as V

MANIFEST = "version long, doc_id long, sha256 string"
TEXTS = "sha256 string, text string"
LOG = "version long, tag string, ts timestamp, message string"


def manifest(docs: DataFrame, version: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """version, id, sha256 of each row; a null text is an empty one."""
    return docs.select(F.lit(version).cast("long").alias("version"), id_col, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("sha256"))


def unseen_texts(docs: DataFrame, texts: DataFrame | None, text_col: str = "text") -> DataFrame:
    """sha256, text of what isn't in ``texts`` yet, each once. Of rows with one hash any text is the same."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.sha2(text, 256).alias("sha256"), text.alias("text"))
    return (rows if texts is None else rows.join(texts.select("sha256"), "sha256", "left_anti")).dropDuplicates(["sha256"])


def restore(manifests: DataFrame, texts: DataFrame, version: int) -> DataFrame:
    """id, text of a version; only hashes are looked up."""
    return manifests.where(F.col("version") == version).drop("version").join(texts, "sha256").drop("sha256")


def changes(manifests: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """version, id, old, new (hashes, null where there is none) of what differs from the version before, for the versions 1 to ``most``. Ids, null among them, are unique in a version."""
    none = F.lit(None).cast("string")
    now = manifests.select("version", id_col, none.alias("old"), F.col("sha256").alias("new"))
    before = manifests.select((F.col("version") + 1).alias("version"), id_col, F.col("sha256").alias("old"), none.alias("new")).where(F.col("version") <= F.lit(most))
    return now.unionByName(before).groupBy("version", id_col).agg(F.max("old").alias("old"), F.max("new").alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))


def diffstats(changed: DataFrame, texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """version, id, status (added, removed, modified), insertions, deletions of ``changes``, by shortest line differences. Each pair of texts is compared once, however many files have it."""
    lines = F.size(F.split("text", "\n")).cast("long")
    pairs = changed.where("old is not null and new is not null").select("old", "new").distinct().withColumn("pair", F.concat_ws("-", "old", "new"))
    side = lambda c: pairs.join(texts.select(F.col("sha256").alias(c), "text"), c).select("pair", "text")
    counts = V.edit_counts(V.line_opcodes(side("old"), side("new"), "pair"), "pair").select("pair", "inserted", "deleted")
    alone = changed.where("old is null or new is null").select(F.coalesce("old", "new").alias("sha256")).distinct().join(texts, "sha256").select("sha256", lines.alias("n"))
    rows = changed.withColumns({"pair": F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.concat_ws("-", "old", "new")), "sha256": F.when(F.col("old").isNull() | F.col("new").isNull(), F.coalesce("old", "new"))})
    found = rows.join(counts, "pair", "left").join(alone, "sha256", "left")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    n = lambda own, other: F.coalesce(own, F.when(F.col("status") == other, F.col("n")), F.lit(0))
    return found.withColumn("status", status).select("version", id_col, "status", n(F.col("inserted"), "added").alias("insertions"), n(F.col("deleted"), "removed").alias("deletions"))


def history(manifests: DataFrame, texts: DataFrame, log: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """version, tag, ts, message, files, added, removed, modified, insertions, deletions; the first version adds all its files."""
    stats = diffstats(changes(manifests, log.agg(F.max("version")).first()[0] or 0, id_col), texts, id_col)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    sums = stats.groupBy("version").agg(n("added"), n("removed"), n("modified"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    files = manifests.groupBy("version").agg(F.count("*").alias("files"))
    return log.join(files, "version", "left").join(sums, "version", "left").fillna(0, ["files", "added", "removed", "modified", "insertions", "deletions"])


class Store:
    """The three tables in a folder that the cluster shares: texts, manifests by version, and the log."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    @property
    def texts(self) -> DataFrame:
        return self._table("texts", TEXTS)

    @property
    def manifests(self) -> DataFrame:
        return self._table("manifests", MANIFEST)

    @property
    def log(self) -> DataFrame:
        return self._table("log", LOG)

    def checkpoint(self, docs: DataFrame, message: str, ts: str | None = None) -> int:
        """Write a version of docs (doc_id, text), with new texts only, and return its number. The log is written last: a version without an entry there doesn't count and is written over."""
        version = (self.log.agg(F.max("version")).first()[0] or 0) + 1
        rows = docs.select("doc_id", "text")
        unseen_texts(rows, self.texts).write.mode("append").parquet(f"{self.folder}/texts")
        manifest(rows, version).drop("version").write.mode("overwrite").parquet(f"{self.folder}/manifests/version={version}")
        when = F.current_timestamp() if ts is None else F.lit(ts).cast("timestamp")
        entry = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(f"V{version:04d}").alias("tag"), when.alias("ts"), F.lit(message).alias("message"))
        entry.write.mode("append").parquet(f"{self.folder}/log")
        return version

    def restore(self, version: int) -> DataFrame:
        # a text that was written twice, by a run that failed, is read once
        return restore(self.manifests, self.texts.dropDuplicates(["sha256"]), version)

    def history(self) -> DataFrame:
        return history(self.manifests.join(self.log.select("version"), "version", "left_semi"), self.texts.dropDuplicates(["sha256"]), self.log)
