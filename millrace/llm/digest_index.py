"""Exact deduplication against a persistent index of digests, in DataFrame functions alone.

The index is a table bucketed and sorted by digest: one row per distinct text that
was ever admitted, with the id of the document that stays. A new batch is

1. digested once (id, digest and length; texts are read by that step alone),
2. reduced to one candidate per digest, combined before the shuffle, so that a text
   with very many copies costs one row per task,
3. anti-joined with the index by sort-merge (the index is read bucket by bucket, not
   shuffled), and
4. appended to the index, dealt by its buckets, one file per bucket.

Each row is then told which document of its text stays by a join on the digest,
whose key is an expression on both sides, so that adaptive execution may split a
digest with very many rows.

Texts are equal if they are identical after all characters of [\\x20\\x09-\\x0D] are
deleted; they are told apart by SHA-256 of that text.

Defined results: a null text counts as empty, and empty texts are copies of each
other. Of equal texts in a batch that with the most code points (before deletion)
stays, then that with the smallest id, ids before null, then the row that comes
first in the digested table: of rows repeated whole exactly one stays. A text that
the index holds already stays where it was first admitted, whatever its length, and
``group_size`` counts the rows of the batch. An empty batch changes nothing. Texts
of any length are hashed whole. Columns besides id and text are never read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, shared_dir

#: The characters [\x20\x09-\x0D], which are deleted before texts are compared.
BLANK = " \t\n\x0b\x0c\r"


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars, row) of each document, written to the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"), F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row")
    )
    return materialize(rows, "digests")


def candidates(rows: DataFrame) -> DataFrame:
    """One row per digest: the document of the batch that would stay, and the rows of the batch."""
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row")
    best = rows.groupBy("digest").agg(F.min_by(F.struct("doc_id", "n_chars", "row"), order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return best.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.n_chars").alias("n_chars"), F.col("best.row").alias("keep_row"), "group_size")


class DigestIndex:
    """A digest index in ``folder``, opened if it exists and created if not.

    The folder holds the rows; the catalog entry ``name`` only tells Spark their
    buckets, and is made anew from the folder in a session that does not know it.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, id_type: str = "bigint", buckets: int = 64):
        self.spark, self.folder, self.name, self.buckets, self.id_type = spark, folder, name, buckets, id_type
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id {id_type}, n_chars BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, found: DataFrame) -> DataFrame:
        """The candidates whose digest the index does not hold: a sort-merge anti-join, bucket by bucket.

        Spark leaves the index where it is if it has at least as many buckets as the session has shuffle
        partitions; with fewer, it deals both sides anew.
        """
        return found.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame) -> None:
        """Write one sorted file per bucket; files of an append that failed are never committed."""
        rows = new.select("digest", F.col("keep_id").cast(self.id_type).alias("keep_id"), "n_chars").repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Admit the documents' new texts; one decision per row.

        (doc_id, text_sha256, n_chars, keep_id, group_size, kept): ``kept`` for the one row of each text that
        was not in the index before.
        """
        rows = digested(docs, id_col, text_col)
        found = materialize(candidates(rows), "candidates")
        new = materialize(self.unknown(found), "admitted")
        old = found.join(self.read().select("digest", F.col("keep_id").alias("held_id"), F.lit(True).alias("held")).hint("merge"), "digest", "left")
        verdicts = materialize(old.select("digest", F.when(F.col("held"), F.col("held_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(F.col("held").isNull(), F.col("keep_row")).alias("keep_row"), "group_size"), "verdicts")
        self.append(new)
        key = lambda df: df.withColumn("digest_key", F.concat("digest", F.lit(b"")))
        out = key(rows).join(key(verdicts).drop("digest"), "digest_key")
        return out.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "n_chars", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))

    def compact(self) -> None:
        """One sorted file per bucket again, after many appends; written beside and swapped in as a new folder."""
        folder = f"{self.folder.rstrip('/')}-{self.buckets}-compact"
        fresh = DigestIndex(self.spark, folder, f"{self.name}_compact", self.id_type, self.buckets)
        fresh.append(self.read())
        self.folder, self.name = fresh.folder, fresh.name


def keep_new(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``DigestIndex.add`` kept, with all their columns.

    Rows repeated whole, id and text, have one kept decision; of them one row is returned.
    """
    digest = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    marks = {"_kept_digest": digest, "_kept_chars": F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")}
    kept = decisions.filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"), F.col("n_chars").alias("_kept_n"))
    marked = docs.withColumns(marks)
    same = marked[id_col].eqNullSafe(kept["_kept_id"]) & (marked["_kept_digest"] == kept["_kept_sha"]) & (marked["_kept_chars"] == kept["_kept_n"])
    return marked.join(kept, same, "left_semi").dropDuplicates([id_col, "_kept_digest", "_kept_chars"]).select(*docs.columns)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Decisions of a whole table against an index of its own, which stays in the shared folder."""
    import uuid

    spark, mark = docs.sparkSession, uuid.uuid4().hex
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, f"{shared_dir(spark)}/millrace/index-{mark}", f"millrace_index_{mark}", dict(docs.dtypes)[id_col], n)
    return index.add(docs, id_col, text_col)
