"""Product codes of vectors, with entries found by annular norm pruning.

A vector is quantised to integers and cut into equal parts; each part position has
a codebook. To find the nearest entry of a part, the entries are sorted by norm.
An entry can only be nearer than the best one known, at distance d, if its norm
is within d of the part's own (triangle inequality), so the walk starts at the
entry of nearest norm, binary-searches the interval of norms that d allows, and
evaluates only that annulus, its ends included, in exact integers; each better
entry narrows the interval.

Spark scans the vectors once a round. Every task adds up the parts of each entry,
so that what is shuffled and collected is at most ``entries`` rows of the vector's
length per task, and the codebooks on the driver are ``entries`` vectors, however
many rows the table has.

Defined results: rows whose vector is null or holds a null, NaN, infinite or
unrepresentable component (1024 times it beyond 62 bits) are dropped, and so are
vectors of another length than the most frequent one (the longest of equally
frequent ones). Where the length is no multiple of the parts, part k takes the
components from floor(k*length/parts) on. Rows without an id are coded but never
seed a codebook; rows that repeat an id are coded each, and of different vectors
under one id the least in array order is the seed. Fewer ids than entries give
fewer entries. Equal distances go to the lower index. Distances are exact at any
magnitude; an error beyond 63 bits is stated as 2**63 - 1. An empty table gives an
empty result. Other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import size_checked
from .storage import materialize

#: What a component is multiplied by before it is floored.
SCALE = 1024
#: Magnitude of components from which a row counts as not finite.
LIMIT = float(1 << 52)
MOST = (1 << 63) - 1
SUMS = "part int, entry int, position int, total decimal(38,0), n long"


def usable(vector):
    """True for vectors without null, infinite or unrepresentable components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < LIMIT))


def cuts(length: int, parts: int) -> list[int]:
    return [k * length // parts for k in range(parts + 1)]


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE).astype(np.int64)


def exact(x: np.ndarray, entries: np.ndarray) -> type:
    """int64 where no squared distance can overflow, else Python's integers."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))
    return np.int64 if max(1, x.shape[1]) * most * most < 1 << 62 else object


class NormOrder:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(object) ** 2).sum(1).astype(float)) if entries.shape[1] else np.zeros(len(entries))
        self.index = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.index], norms[self.index]
        self.evaluated = 0

    def _annulus(self, norm: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last position (exclusive) that may hold an entry at distance ``best`` or less.

        The margin covers the rounding of the norms, so that no entry at the very distance is lost.
        """
        reach = np.sqrt(best.astype(float))
        reach += 1e-9 * (norm + reach + 1)
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lowest of equally near ones) and its squared distance, for every row of ``x``."""
        kind = exact(x, self.entries)
        x, entries = x.astype(kind, copy=False), self.entries.astype(kind, copy=False)
        norm = np.sqrt((x * x).sum(1).astype(float)) if x.shape[1] else np.zeros(len(x))
        after = np.searchsorted(self.norms, norm)
        before = np.maximum(after - 1, 0)
        after = np.minimum(after, len(entries) - 1)
        start = np.where(norm - self.norms[before] <= self.norms[after] - norm, before, after)
        best, who = np.full(len(x), 0, kind), self.index[start].copy()

        def distance(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            self.evaluated += len(rows)
            gap = x[rows] - entries[at]
            return (gap * gap).sum(1).astype(kind)

        everyone = np.arange(len(x))
        best[:] = distance(everyone, start)
        low, high = self._annulus(norm, best)
        live = {-1: everyone, 1: everyone}
        step = 0
        while len(live[-1]) or len(live[1]):
            step += 1
            for side, rows in live.items():
                at = start[rows] + side * step
                inside = (at >= low[rows]) & (at < high[rows])
                rows, at = rows[inside], at[inside]
                live[side] = rows
                if not len(rows):
                    continue
                d, entry = distance(rows, at), self.index[at]
                better = (d < best[rows]) | ((d == best[rows]) & (entry < who[rows]))
                rows, d, entry = rows[better], d[better], entry[better]
                best[rows], who[rows] = d, entry
                low[rows], high[rows] = self._annulus(norm[rows], best[rows])
        return who, best


def _batches(batches, length: int):
    """Integer matrices of the Arrow batches, with their batch."""
    for batch in batches:
        if batch.num_rows:
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            yield batch, integers(values.reshape(batch.num_rows, length))


def _added(codes: np.ndarray, x: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact componentwise sums of the rows of each code, and their counts."""
    order = np.argsort(codes, kind="stable")
    found, first = np.unique(codes[order], return_index=True)
    most = int(np.abs(x).max(initial=0)) * len(x)
    sums = np.add.reduceat(x[order] if most < 1 << 62 else x[order].astype(object), first, axis=0)
    total = np.zeros((entries, x.shape[1]), object)
    total[found] = sums.astype(object)
    return total, np.bincount(codes, minlength=entries)


def _sums_of(codebooks: list[np.ndarray], length: int):
    """Task function: one row of sums for each entry and component that the task has met."""
    at = cuts(length, len(codebooks))

    def run(batches):
        orders = [NormOrder(b) for b in codebooks]
        totals = [np.zeros(b.shape, object) for b in codebooks]
        counts = [np.zeros(len(b), np.int64) for b in codebooks]
        for _, x in _batches(batches, length):
            for k, order in enumerate(orders):
                part = x[:, at[k] : at[k + 1]]
                total, n = _added(order.nearest(part)[0], part, len(codebooks[k]))
                totals[k] += total
                counts[k] += n
        for k, (total, n) in enumerate(zip(totals, counts)):
            used = np.flatnonzero(n)
            width = total.shape[1]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.full(len(used) * width, k, np.int32)),
                    "entry": pa.array(np.repeat(used, width).astype(np.int32)),
                    "position": pa.array(np.tile(np.arange(width), len(used)).astype(np.int32)),
                    "total": pa.array([Decimal(int(v)) for v in total[used].ravel()], pa.decimal128(38, 0)),
                    "n": pa.array(np.repeat(n[used], width)),
                }
            )

    return run


def _codes_of(codebooks: list[np.ndarray], length: int):
    """Task function: the code and the error of each row."""
    at = cuts(length, len(codebooks))
    digits = max(2, len(f"{max(1, len(codebooks[0])) - 1:x}"))

    def run(batches):
        orders = [NormOrder(b) for b in codebooks]
        for batch, x in _batches(batches, length):
            found = [order.nearest(x[:, at[k] : at[k + 1]]) for k, order in enumerate(orders)]
            error = sum(d.astype(object) for _, d in found)
            code = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*(w.tolist() for w, _ in found))]
            kept = [n for n in batch.schema.names if n != "vector"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(code, pa.string()), pa.array([min(int(e), MOST) for e in error], pa.int64())],
                names=[*kept, "code", "error"],
            )

    return run


def seed_codebooks(vectors: DataFrame, length: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the ``entries`` smallest ids, ascending."""
    ids = [r["vec_id"] for r in vectors.filter("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    rows = vectors.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect() if ids else []
    seeds = integers(np.array([r["vector"] for r in rows], float).reshape(len(rows), length))
    at = cuts(length, parts)
    return [seeds[:, at[k] : at[k + 1]] for k in range(parts)]


def train_round(vectors: DataFrame, codebooks: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Every part to its nearest entry, every used entry to the floored mean of its parts."""
    sums = vectors.select("vector").mapInArrow(_sums_of(codebooks, length), SUMS)
    means = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = [b.copy() for b in codebooks]
    for r in means.toLocalIterator():  # as many rows as the codebooks have components
        new[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return new


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in codebooks for v in b.ravel()).encode()).hexdigest()


def compress_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every usable row, and the codebooks, one array of entries per part position."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    lengths = vectors.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    types = dict(vectors.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint"
    if lengths is None:
        return spark.createDataFrame([], schema), [np.zeros((0, 0), np.int64)] * parts
    length = lengths["length"]
    vectors = vectors.filter(F.size("vector") == length)
    codebooks = seed_codebooks(vectors, length, parts, entries)
    if not len(codebooks[0]):
        raise ValueError("no row has an id, so that no codebook can be seeded")
    for _ in range(rounds):
        codebooks = train_round(vectors, codebooks, length)
    return vectors.mapInArrow(_codes_of(codebooks, length), schema), codebooks


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of the errors of equal labels (nulls together).

    Sums are combined before the shuffle. They are broadcast if few; else the key
    is an expression of the label, so that adaptive execution may split a label
    that holds a large share of the rows.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    sums = coded.groupBy("label").agg(total.alias("label_error")).select(key.alias("label_key"), "label_error")
    return coded.withColumn("label_key", key).join(size_checked(sums), "label_key").drop("label_key")


def code_table(embeddings: DataFrame, **names) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row."""
    coded, codebooks = compress_vectors(embeddings, **names)
    out = with_label_errors(materialize(coded, "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
