"""Ranked lexical search: integer BM25 over a term-bucketed table of postings.

The index is built in one pass over the texts. A task inverts its documents some
thousands at a time into rows (term, documents, occurrences), so that a term costs
one row per stretch and not one per posting; these rows are dealt by term and
written sorted by it. A term that very many documents of a stretch hold is dealt by
stretch as well, so that no bucket gathers a frequent term of the whole corpus,
while every other term lies in one bucket.

A query table is joined with the postings by term; each match is scored in 64-bit
integers once, for all items that ask for the term, after its row was dealt by
document. Items are joined to the scored terms next to their document, summed by
(item, document) there, and ``row_number`` over each item, cut per task before the
shuffle, gives the first k.

Defined results: each row of the documents is a document of its own, also if ids or
whole rows are repeated (then equal ones are ranked in any order among themselves);
documents and items of null text have no terms; documents without an id are ranked
after those of equal score with one. Rows that share an item id (also null) are one
item with the terms of all. Equal scores go by ascending id. Items or documents
without terms, and empty tables, give no rows. Texts of any length are read whole.
Other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import size_checked
from .storage import materialize, new_path

#: Bytes of terms: ASCII digits and letters, and all bytes of other characters; A-Z are lower-cased, the rest separates.
KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
FOLD = bytes(c if c in KEPT else ord(chr(c).lower()) if chr(c).isascii() and chr(c).isupper() else 32 for c in range(256))
#: Postings, and documents, that a task inverts together.
STRETCH, STRETCH_DOCS = 1 << 20, 4096
#: A term that more than this share of a stretch's documents hold is dealt by stretch as well.
FREQUENT = 1 / 16
PARTS = "kind string, term string, salt long, df int, rows array<bigint>, counts array<int>, ids array<string>"
K1_TIMES_B, ONE_MINUS_B = 50, 50


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return text.translate(FOLD).split()


def _lists(order: np.ndarray, firsts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(firsts, len(order)).astype(np.int32)), pa.array(values[order], kind))


def _inverted(terms: list[bytes], counts: list[int], rows: np.ndarray, n_docs: int, stretch: int) -> pa.RecordBatch:
    """Rows (term, documents, occurrences) of the postings of a stretch."""
    coded = pa.array(terms, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    firsts = np.searchsorted(codes[order], np.arange(len(coded.dictionary)))
    df = np.diff(np.append(firsts, len(order))).astype(np.int32)
    n = len(df)
    return pa.RecordBatch.from_pydict(
        {
            "kind": pa.repeat("postings", n),
            "term": coded.dictionary.cast(pa.string()),
            "salt": pa.array(np.where(df > max(1, FREQUENT * n_docs), stretch, 0).astype(np.int64)),
            "df": pa.array(df),
            "rows": _lists(order, firsts, rows, pa.int64()),
            "counts": _lists(order, firsts, np.array(counts, np.int32), pa.int32()),
            "ids": pa.nulls(n, pa.list_(pa.string())),
        }
    )


def _documents(rows: list[int], lengths: list[int], ids: list, stretch: int) -> pa.RecordBatch:
    """One row with the ids and lengths of a stretch's documents."""
    return pa.RecordBatch.from_pydict(
        {
            "kind": pa.array(["documents"]), "term": pa.array([""]), "salt": pa.array([stretch], pa.int64()), "df": pa.array([len(rows)], pa.int32()),
            "rows": pa.array([rows], pa.list_(pa.int64())), "counts": pa.array([lengths], pa.list_(pa.int32())), "ids": pa.array([ids], pa.list_(pa.string())),
        }
    )


def _inverter(stretch_postings: int, stretch_docs: int):
    """Task function: postings and document lengths of (id as text, UTF-8 text) rows, some thousands of documents together."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        stretch = row
        terms: list[bytes] = []
        counts: list[int] = []
        docs: list[tuple[int, int, str | None, int]] = []  # row, length, id, postings

        def flush():
            if terms:
                yield _inverted(terms, counts, np.repeat([d[0] for d in docs], [d[3] for d in docs]), len(docs), stretch)
            if docs:
                yield _documents([d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], stretch)
            terms.clear(), counts.clear(), docs.clear()

        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                raw = text.as_py()
                found = Counter(terms_of(raw)) if raw else {}
                if found:
                    terms.extend(found.keys())
                    counts.extend(found.values())
                    docs.append((row, sum(found.values()), id_, len(found)))
                row += 1
                if len(terms) >= stretch_postings or len(docs) >= stretch_docs:
                    stretch += 1
                    yield from flush()
        stretch += 1
        yield from flush()

    return run


class TermIndex:
    """``postings`` (term, salt, df, rows, counts) and ``documents`` (row, n, doc_id) with their totals."""

    def __init__(self, path: str, spark, id_type: str):
        stored = spark.read.schema(PARTS).parquet(path)
        self.path = path
        self.postings = stored.filter("kind = 'postings'").select("term", "df", "rows", "counts")
        flat = stored.filter("kind = 'documents'").select(F.explode(F.arrays_zip("rows", "counts", "ids")).alias("d"))
        self.documents = flat.select(F.col("d.rows").alias("row"), F.col("d.counts").cast("long").alias("n"), F.col("d.ids").cast(id_type).alias("doc_id"))
        totals = self.documents.agg(F.count(F.lit(1)), F.sum("n")).first()
        self.n_documents, self.n_terms = totals[0], totals[1] or 0


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stretch_postings: int = STRETCH, stretch_docs: int = STRETCH_DOCS) -> TermIndex:
    """Invert ``docs`` and write the index to the shared folder."""
    raw = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    path = new_path(docs.sparkSession, "postings")
    dealt = raw.mapInArrow(_inverter(stretch_postings, stretch_docs), PARTS).repartition("term", "salt").sortWithinPartitions("kind", "term")
    dealt.write.partitionBy("kind").parquet(path)
    return TermIndex(path, docs.sparkSession, dict(docs.dtypes)[id_col])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each pair once."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select(F.col(id_col).alias("item_id"), F.explode(F.array_distinct(found)).alias("term")).distinct()


def term_weights(index: TermIndex, wanted: DataFrame) -> DataFrame:
    """(term, term_no, weight) of the wanted terms that the corpus holds, those of weight 0 left out."""
    terms = size_checked(wanted.select("term").distinct())
    df = index.postings.select("term", "df").join(terms, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return df.select("term", F.monotonically_increasing_id().alias("term_no"), weight.alias("weight")).filter("weight > 0")


def search(index: TermIndex, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    wanted = materialize(item_terms(items, id_col, text_col), "item-terms")
    weights = materialize(term_weights(index, wanted), "term-weights")
    matches = (
        index.postings.join(size_checked(weights), "term")
        .select("term_no", "weight", F.explode(F.arrays_zip("rows", "counts")).alias("p"))
        .select("term_no", "weight", F.col("p.rows").alias("row"), F.col("p.counts").alias("tf"))
    )
    # 50 * n * N passes 64 bits for the longest documents of a very large corpus, so it is computed in decimals
    norm = F.expr(f"{ONE_MINUS_B}L + CAST((CAST({K1_TIMES_B} AS DECIMAL(38,0)) * n * {index.n_documents}) div {max(1, index.n_terms)} AS BIGINT)")
    lengths = index.documents.select("row", "doc_id", norm.alias("m")).hint("shuffle_hash")
    part = F.expr("weight * ((1000000000L * tf) div (1000L * tf + 20L * m))")
    scored = matches.join(lengths, "row").select("row", "doc_id", "term_no", part.alias("part"))
    asked = materialize(wanted.join(size_checked(weights.select("term", "term_no")), "term").select("item_id", "term_no"), "asked-terms")
    sums = scored.join(size_checked(asked), "term_no").groupBy("item_id", "row", "doc_id").agg(F.sum("part").alias("score")).filter("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    best = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
