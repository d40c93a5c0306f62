"""MinHash near-duplicates with sequential Bayesian verification.

1. Documents with equal shingle sets collapse to one.
2. Banded MinHash keys give candidates. In each bucket every member is compared
   with the smallest member first (a star), so large groups cost one comparison
   per member; signatures are compared batch by batch, and a pair is dropped
   once the posterior chance of reaching the threshold falls below
   ``miss``. Survivors are confirmed on their full shingle sets.
3. Connected components of the confirmed links.
4. Buckets that still hold several components compare the other pairs across
   components in the same way, likeliest first, until they are joined; buckets
   above ``block`` members do so block against block, in tasks of their own.
   Only links that join components leave a task.

Pairs inside one component need no comparison, so no link that changes the
result is lost but by the banding (about 5e-6 at the threshold) and ``miss``.

Defined results: null or empty texts have no shingles, are linked with nothing
and are kept; so are rows without an id; rows that repeat a doc_id share its
component and are all kept or all dropped; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, dealt_anew, merge_components, size_checked
from .storage import materialize

WIDTH, BANDS, ROWS = 5, 32, 4
HASHES = BANDS * ROWS
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def constants():
    rng = np.random.default_rng(20240501)
    table = rng.integers(0, 1 << 64, 256, np.uint64)
    a = rng.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 64, HASHES, np.uint64)
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return table, a, b, space


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of lower-cased bytes."""
    table, _, _, space = constants()
    data = np.frombuffer(raw, np.uint8)
    blank = np.concatenate(([True], space[data], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(1 << max(12, int(len(data)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(table[data] * up[: len(data)])))
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of the 5-word shingles, or of the whole sequence of fewer words."""
    n = len(words)
    if not n:
        return words
    width = min(n, WIDTH)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : n - width + 1 + k])
    return np.unique(h)


def hashed_sets(texts: list[str | None]):
    """The distinct shingle hashes of each text; short texts are hashed together."""
    limit, out, group, held = 1 << 21, [], [], 0

    def flush():
        starts, hashes = word_hashes(b"\n".join(group))
        ends = np.cumsum([len(g) + 1 for g in group])
        cuts = np.searchsorted(starts, ends[:-1])
        return [shingle_hashes(w) for w in np.split(hashes, cuts)]

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
        if group and held + len(raw) > limit:
            out += flush()
            group, held = [], 0
        group.append(raw)
        held += len(raw) + 1
    return out + flush() if group else out


def signature(shingles: np.ndarray) -> np.ndarray:
    _, a, b, _ = constants()
    least = np.full(HASHES, (1 << 32) - 1, np.uint64)
    for k in range(0, len(shingles), 2048):
        part = shingles[None, k : k + 2048] * a[:, None] + b[:, None]
        least = np.minimum(least, (part >> np.uint64(32)).min(1))
    return least.astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.astype(np.uint64).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return h.view(np.int64)


@lru_cache(maxsize=4)
def least_matches(threshold: float, miss: float, batch: int = 16) -> dict[int, int]:
    """For each number of hashes seen: the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n leave the posterior Beta(m + 1, n - m + 1).
    """

    def above(m: int, n: int) -> float:  # P(similarity >= threshold)
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return {n: next(m for m in range(n + 1) if above(m, n) >= miss) for n in range(batch, HASHES + 1, batch)}


def plausible(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which pairs of signature rows survive the batches."""
    alive, matches, before = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in least_matches(threshold, miss).items():
        matches = matches + (left[alive, before:n] == right[alive, before:n]).sum(1)
        go = matches >= least
        alive, matches, before = alive[go], matches[go], n
        if not len(alive):
            break
    return alive


def exact_set(text: str | None) -> set:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WIDTH))))


def _sets_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), 512):
                rows = []
                for doc, x in zip(ids[k : k + 512], hashed_sets([t.as_py() for t in texts[k : k + 512]])):
                    n = len(x)
                    prints = [int(mix(x).sum(dtype=np.uint64)), int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))] if n else [0, 0]
                    rows.append((doc, n, *(p - (1 << 64) if p >> 63 else p for p in prints), band_keys(signature(x)) if n else None))
                arrays = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([r[4] for r in rows], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "print_a", "print_b", "bands"])

    schema = "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def _signed(docs: DataFrame) -> DataFrame:
    """(id, sig, n, text) of documents."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = hashed_sets([t.as_py() for t in part.column(1)])
                sigs = pa.array([signature(x).tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sigs, pa.array([len(x) for x in sets], pa.int64()), part.column(1)], ["id", "sig", "n", "text"])

    return docs.mapInArrow(run, "id long, sig binary, n long, text string")


def _confirm(pairs: DataFrame, signed: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that pass the batches and then, on full sets, the threshold."""
    left = signed.select(F.bitwise_not("id").alias("left_key"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"), F.col("text").alias("text_a"))
    right = signed.select(F.bitwise_not("id").alias("right_key"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"), F.col("text").alias("text_b"))
    keyed = pairs.select("a", "b", F.bitwise_not("a").alias("left_key"), F.bitwise_not("b").alias("right_key"))
    sized = (100 * F.least("n_a", "n_b")) >= (percent * F.greatest("n_a", "n_b"))
    both = keyed.join(left, "left_key").join(right, "right_key").filter(sized)

    def run(batches):
        last, cached = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = lambda c: np.stack([np.frombuffer(s.as_py(), np.uint32) for s in batch.column(batch.schema.get_field_index(c))])
            texts = [batch.column(batch.schema.get_field_index(c)) for c in ("text_a", "text_b")]
            ids = batch.column(batch.schema.get_field_index("a"))
            good = []
            for k in plausible(sig("sig_a"), sig("sig_b"), percent / 100, miss):
                if (a := ids[int(k)].as_py()) != last:
                    last, cached = a, exact_set(texts[0][int(k)].as_py())
                other = exact_set(texts[1][int(k)].as_py())
                shared = len(cached & other)
                if 100 * shared >= percent * (len(cached) + len(other) - shared):
                    good.append(int(k))
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return both.select("a", "b", "sig_a", "sig_b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _groups(batches, columns):
    """(group, lists of columns) of consecutive rows with equal ``group``."""
    held, key = [[] for _ in columns], None
    for batch in batches:
        data = batch.to_pydict()
        for group, *row in zip(data["group"], *(data[c] for c in columns)):
            if held[0] and group != key:
                yield key, held
                held = [[] for _ in columns]
            key = group
            for h, x in zip(held, row):
                h.append(x)
    if held[0]:
        yield key, held


class _Group:
    """One bucket, or one pair of blocks of a large one: which rows are still to be compared with row i."""

    def __init__(self, ids, parts, comps, sizes, sigs, threshold: float, miss: float):
        self.ids, self.parts, self.comps, self.sizes = map(np.array, (ids, parts, comps, sizes))
        self.sigs = np.stack([np.frombuffer(s, np.uint32) for s in sigs])
        self.threshold, self.miss, self.split = threshold, miss, bool(self.parts.any())

    def partners(self, i: int) -> np.ndarray:
        """Later rows of other components whose size and signature allow the threshold, likeliest first."""
        rest = np.arange(i + 1, len(self.ids))
        rest = rest[self.comps[rest] != self.comps[i]]
        small, large = np.minimum(self.sizes[rest], self.sizes[i]), np.maximum(self.sizes[rest], self.sizes[i])
        rest = rest[small >= self.threshold * large - 1e-9]
        if self.split:
            rest = rest[self.parts[rest] != self.parts[i]]
        if len(rest):
            rest = rest[plausible(np.broadcast_to(self.sigs[i], (len(rest), HASHES)), self.sigs[rest], self.threshold, self.miss)]
            rest = rest[np.argsort(-(self.sigs[rest] == self.sigs[i]).sum(1), kind="stable")]
        return rest

    def join(self, i: int, j: int) -> None:
        self.comps[self.comps == self.comps[j]] = self.comps[i]


MEMBER = ["part", "id", "component", "n", "sig"]


def _with_partners(members: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The rows (group, part, id, component) that have a plausible partner in another component of their group."""

    def run(batches):
        for key, held in _groups(batches, MEMBER):
            ids, parts, comps, sizes, sigs = held[1], held[0], held[2], held[3], held[4]
            group = _Group(ids, parts, comps, sizes, sigs, threshold, miss)
            seen = set()
            for i in range(len(ids) - 1):
                if len(found := group.partners(i)):
                    seen.update([i, *found.tolist()])
            rows = [(key, parts[k], ids[k], comps[k]) for k in sorted(seen)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["group", "part", "id", "component"])

    dealt = members.select("group", *MEMBER).repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "group long, part int, id long, component long")


def _joining_links(members: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b), confirmed on full sets, that join the components of each group: fewer than it has rows.

    Rows are compared until they are joined, so a group that is one component
    in the end needs few comparisons, and no pairs leave the task but links.
    """

    def run(batches):
        for _, held in _groups(batches, [*MEMBER, "text"]):
            ids, texts = held[1], held[5]
            group = _Group(ids, held[0], held[2], held[3], held[4], percent / 100, miss)
            sets: dict[int, set] = {}
            full = lambda k: sets[k] if k in sets else sets.setdefault(k, exact_set(texts[k]))
            links = []
            for i in range(len(ids) - 1):
                for j in group.partners(i).tolist():
                    if group.comps[i] != group.comps[j]:
                        shared = len(full(i) & full(j))
                        if 100 * shared >= percent * (len(full(i)) + len(full(j)) - shared):
                            links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                            group.join(i, j)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    dealt = members.select("group", *MEMBER, "text").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    miss: float = 1e-6,
    block: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``."""
    sets = materialize(_sets_table(docs, id_col, text_col), "sets")
    first = sets.filter("n_shingles > 0").groupBy("print_a", "print_b").agg(F.min("doc_id").alias("rep"))
    first = dealt_anew(first, "print_a").select("join_key", F.col("print_b").alias("other_b"), "rep")
    keyed = dealt_anew(sets, "print_a", "set_key")
    joined = keyed.join(first, (keyed["set_key"] == first["join_key"]) & (keyed["print_b"] == first["other_b"]) & (keyed["n_shingles"] > 0), "left")
    rep = F.coalesce("rep", "doc_id")
    table = materialize(joined.select("doc_id", "n_shingles", rep.alias("rep"), F.when(rep == F.col("doc_id"), F.col("bands")).alias("bands")), "collapsed")

    buckets = table.filter("bands IS NOT NULL").select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    crowded = buckets.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count(F.lit(1)).alias("members")).filter("leader <> last")
    crowded = dealt_anew(crowded, "key").select("join_key", "leader", "members")
    members = materialize(dealt_anew(buckets, "key").join(crowded, "join_key").select("key", "id", "leader", "members").distinct(), "members")

    ids = size_checked(members.select(F.col("id").alias("wanted")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(_signed(texts.join(ids, F.col("id") == F.col("wanted"), "left_semi").dropDuplicates(["id"])), "signed")

    star = members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(_confirm(star, signed, percent, miss), "links")
    comps = connected_components(links)

    placed = dealt_anew(members, "id").join(comps.select(F.bitwise_not("id").alias("join_key"), "component"), "join_key", "left")
    placed = materialize(placed.select("key", "id", "leader", "members", F.coalesce("component", "id").alias("component")), "placed")
    # Only buckets with several components have pairs left; the leader's own pairs are done.
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select(F.bitwise_not("key").alias("join_key"))
    rest = dealt_anew(placed.filter("members > 2 AND id <> leader"), "key").join(mixed, "join_key", "left_semi")
    rest = rest.withColumn("blocks", F.ceil((F.col("members") - 1) / F.lit(block)).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A member of block i meets block j in the group of the pair (i, j); equal blocks meet once.
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    rest = rest.select(group.alias("group"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("part"), "id", "component", F.bitwise_not("id").alias("join_key"))
    sketch = signed.select(F.bitwise_not("id").alias("join_key"), "n", "sig")
    open_ = materialize(_with_partners(rest.join(sketch, "join_key"), percent / 100, miss), "open")
    whole = signed.select(F.bitwise_not("id").alias("join_key"), "n", "sig", "text")
    more = materialize(_joining_links(dealt_anew(open_, "id").join(whole, "join_key"), percent, miss), "links")
    if more.limit(1).count():
        comps = merge_components(comps, more)

    final = dealt_anew(table, "rep").join(comps.select(F.bitwise_not("id").alias("join_key"), "component"), "join_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return final.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that open their component; rows without an id stay."""
    found = materialize(near_duplicates(docs, id_col=id_col, **options).select("doc_id", "kept"), "near")
    gone = size_checked(found.filter("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(gone, docs[id_col].cast("long") == gone["gone_id"], "left_anti")
