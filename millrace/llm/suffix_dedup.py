"""Removal of repeated substrings by distributed prefix doubling.

A byte goes if a ``LENGTH``-byte string over it also starts in a document with
a smaller id. Positions get ranks for prefixes of growing length: 16, 32, 50
bytes. Spark deals positions by rank; tasks sort them, and a position whose
rank is unique to its document leaves the race before its prefix grows.

Ranking every position would shuffle some 16 times the text. Windows of 50
bytes therefore share positions: each window is led by the 16-byte string of
least hash inside it (its leader), which depends on the window's bytes alone,
so equal windows have equal leaders at equal offsets. About one position in 18
leads, and a leader's neighbourhood of at most 84 bytes holds all its windows.

1. Documents equal to an earlier one go whole; their texts take no further part.
2. First ranks: leaders are dealt by the rank of their 16 bytes. Those in one
   document only are unique and dropped. Leaders that several documents of one
   batch share are known to stay and send one entry for all, so a rank that
   very many documents share reaches its task as one entry per batch.
3. Ranks grow: the remaining leaders bring their neighbourhoods and are dealt by
   rank again; pairs of ranks at offsets 16 and 18 make the ranks of 32 and 50
   bytes, sorting finds the smallest document of each, and windows of others
   are marked. Neighbourhoods that repeat within a batch are sent once.
4. Marked windows are merged per document and cut out.

Ranks are 64-bit names of their strings, compared within one leader's class.

Defined results: null text is empty; texts below 50 bytes and rows without an
id lose nothing; rows that repeat id and text are judged alike; one id must not
stand for two texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import dealt_anew, size_checked
from .storage import materialize

LENGTH, FIRST = 50, 16
REACH = LENGTH - FIRST  # offsets of a leader in its window: 0 to REACH
CONTEXT = LENGTH + REACH
BUFFER = 1 << 22  # bytes ranked at once; positions in it take 22 bits
C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def first_ranks(data: np.ndarray) -> np.ndarray:
    """The name of the 16 bytes from each position."""
    n = len(data) - FIRST + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray(n + 8, "<u8", data, strides=(1,))
    return mix(words[:n] * C[0] + mix(words[8:] + C[1]))


def leaders(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(rank, leader, first window, windows) of all windows that stay within [start, end)."""
    ranks = first_ranks(data)
    n = len(data) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), empty, empty, empty
    place = np.uint64(BUFFER - 1)
    least = (ranks & ~place) | np.arange(len(ranks), dtype=np.uint64)  # ties: the leftmost
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH + 1:
        least = np.minimum(least[: n], least[REACH + 1 - width :][:n])
    marks = np.zeros(n + 1, np.int32)
    valid = ends - starts >= LENGTH
    np.add.at(marks, starts[valid], 1)
    np.add.at(marks, np.minimum(ends[valid] - LENGTH + 1, n), -1)
    windows = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    if not len(windows):
        return np.zeros(0, np.uint64), empty, empty, empty
    at = (least[windows] & place).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    counts = np.diff(np.append(heads, len(windows)))
    return ranks[at[heads]], at[heads], windows[heads], counts


def _segments(ids, texts):
    """Lists of (id, base, bytes) of at most BUFFER bytes together; long texts overlap by 49 bytes."""
    group, held = [], 0
    for doc, text in zip(ids, texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for base in range(0, max(len(raw) - LENGTH + 1, 1), BUFFER - LENGTH + 1):
            part = raw[base : base + BUFFER]
            if len(part) < LENGTH:
                continue
            if held + len(part) > BUFFER:
                yield group
                group, held = [], 0
            group.append((doc, base, part))
            held += len(part)
    if group:
        yield group


def _packed(*columns) -> list[bytes]:
    return [np.ascontiguousarray(c).tobytes() for c in columns]


FIRST_SCHEMA = "bucket int, known boolean, rank binary, doc binary, code binary"


def _code(first, lead, count):
    """first window, the leader's offset in it, and the number of windows, in one number."""
    return (first << 16) | ((lead - first) << 8) | count


def _deal_first(docs: DataFrame, buckets: int) -> DataFrame:
    """Leaders of all documents, as packed columns for each bucket of ranks."""

    def run(batches):
        def rows(bucket, known, rank, doc, code):
            out = [[bucket], [known], *([x] for x in _packed(rank, doc, code))]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "known", "rank", "doc", "code"])

        for batch in batches:
            for group in _segments(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))):
                data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
                ends = np.cumsum([len(g[2]) for g in group])
                starts = ends - [len(g[2]) for g in group]
                rank, lead, first, count = leaders(data, starts, ends)
                if not len(rank):
                    continue
                of = np.searchsorted(starts, first, side="right") - 1
                doc = np.array([g[0] for g in group], np.int64)[of]
                shift = np.array([g[1] for g in group], np.int64)[of] - starts[of]
                code = _code(first + shift, lead + shift, count)
                order = np.lexsort((doc, rank))
                rank, doc, code = rank[order], doc[order], code[order]
                head = np.concatenate(([True], rank[1:] != rank[:-1]))
                cls = np.cumsum(head) - 1
                at = np.flatnonzero(head)
                last = np.append(at[1:], len(rank)) - 1
                shared = (doc[at] < doc[last])[cls]
                if shared.any():  # known to stay; these need no further look at their rank
                    yield rows(int(code[0]) % buckets, True, rank[:0], doc[shared], code[shared])
                send = ~shared | head  # of a shared rank one entry tells the other batches
                rank, doc, code = rank[send], doc[send], np.where(shared[send], -1, code[send])
                bucket = (rank >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in range(buckets):
                    if cuts[b] < cuts[b + 1]:
                        part = order[cuts[b] : cuts[b + 1]]
                        yield rows(b, False, rank[part], doc[part], code[part])

    return docs.mapInArrow(run, FIRST_SCHEMA)


def _survivors(dealt: DataFrame) -> DataFrame:
    """(doc, code) of the leaders whose rank several documents have."""

    def run(batches):
        ranks, docs, codes = [], [], []
        out = lambda d, c: pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(c, pa.int64())], ["doc", "code"])
        for batch in batches:
            for known, r, d, c in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                d, c = np.frombuffer(d, np.int64), np.frombuffer(c, np.int64)
                if known:
                    yield out(d, c)
                else:
                    ranks.append(np.frombuffer(r, np.uint64))
                    docs.append(d)
                    codes.append(c)
        if ranks:
            rank, doc, code = map(np.concatenate, (ranks, docs, codes))
            ranks.clear(), docs.clear(), codes.clear()
            order = np.argsort(rank)
            rank, doc, code = rank[order], doc[order], code[order]
            at = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
            several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
            told = np.minimum.reduceat(code, at) < 0  # shared within a batch already
            stay = np.repeat(several | told, np.diff(np.append(at, len(rank)))) & (code >= 0)
            doc, code = doc[stay], code[stay]
            for k in range(0, len(doc), 1 << 17):
                yield out(doc[k : k + (1 << 17)], code[k : k + (1 << 17)])

    return dealt.mapInArrow(run, "doc long, code long")


NEAR_SCHEMA = "bucket int, rank binary, doc binary, first binary, windows binary, near binary, done_doc binary, done_from binary, done_to binary"


def _deal_neighbourhoods(texts: DataFrame, buckets: int) -> DataFrame:
    """Neighbourhoods of the leaders of (doc, codes, text) rows, packed for each bucket of ranks."""

    def run(batches):
        def emit(held):
            doc, first, lead, count = (np.concatenate([h[j] for h in held]) for j in range(4))
            near = np.concatenate([h[4] for h in held])
            rank = first_ranks_at(near, lead - first)
            # equal neighbourhoods of one batch: the smallest document stands for all, the others are marked whole
            name = mix(np.ndarray((len(near), CONTEXT // 4), "<u4", near).astype(np.uint64) @ weights + (lead - first).astype(np.uint64) * C[3] + count.astype(np.uint64) * C[4])
            order = np.lexsort((doc, name))
            head = np.concatenate(([True], name[order][1:] != name[order][:-1]))
            smallest = np.empty(len(doc), np.int64)
            smallest[order] = doc[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
            mine = np.zeros(len(doc), bool)
            mine[order] = head
            done = doc > smallest
            keep = mine | ~done
            bucket = (rank >> np.uint64(20)) % np.uint64(buckets)
            for b in np.unique(bucket):
                k = keep & (bucket == b)
                d = done & (bucket == b)
                packed = _packed(rank[k], doc[k], first[k], count[k].astype(np.uint8), near[k], doc[d], first[d], (first + count)[d] + LENGTH - 1)
                yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], NAMES)

        weights = np.random.default_rng(3).integers(0, 1 << 64, CONTEXT // 4, np.uint64) | np.uint64(1)
        held, size = [], 0
        for batch in batches:
            for doc, codes, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                code = np.asarray(codes.values, np.int64)
                first, lead, count = code >> 16, (code >> 16) + ((code >> 8) & 255), code & 255
                data = np.frombuffer(raw + bytes(CONTEXT), np.uint8)
                near = data[first[:, None] + np.arange(CONTEXT)]
                near[np.arange(CONTEXT) >= (count + LENGTH - 1)[:, None]] = 0  # only what the windows cover
                held.append((np.full(len(code), doc, np.int64), first, lead, count, near))
                size += len(code)
                if size > 1 << 17:
                    yield from emit(held)
                    held, size = [], 0
        if size:
            yield from emit(held)

    NAMES = [c.split()[0] for c in NEAR_SCHEMA.split(", ")]
    return texts.mapInArrow(run, NEAR_SCHEMA)


def first_ranks_at(near: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The 16-byte rank at one offset of each neighbourhood."""
    take = near[np.arange(len(near))[:, None], offset[:, None] + np.arange(FIRST)]
    words = np.ndarray((len(near), 2), "<u8", np.ascontiguousarray(take))
    return mix(words[:, 0] * C[0] + mix(words[:, 1] + C[1]))


def grown_ranks(near: np.ndarray) -> np.ndarray:
    """Ranks of the 50-byte strings from offsets 0 to REACH, by doubling: pairs at offset 16, then at 18."""
    rows = len(near)
    padded = np.ascontiguousarray(near)
    words = np.ndarray((rows, CONTEXT - 7), "<u8", padded, strides=(CONTEXT, 1))
    of16 = mix(words[:, : CONTEXT - FIRST + 1] * C[0] + mix(words[:, 8:] + C[1]))
    of32 = mix(of16[:, :-16] * C[2] + of16[:, 16:])
    return mix(of32[:, : REACH + 1] * C[3] + of32[:, 18 : 18 + REACH + 1])


def mark_windows(rank, doc, first, count, near):
    """(doc, from, to) of bytes whose windows a smaller document has, one row per run of windows."""
    keys, owners, chunk = [], [], 1 << 14
    inside = np.arange(REACH + 1)[None, :] < count[:, None]
    for k in range(0, len(rank), chunk):
        part = slice(k, k + chunk)
        grown = mix(grown_ranks(near[part]) + rank[part, None] * C[4])
        keys.append(grown[inside[part]])
    keys = np.concatenate(keys)
    owners = np.repeat(doc, count)
    order = np.argsort(keys)
    head = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    at = np.flatnonzero(head)
    smallest = np.minimum.reduceat(owners[order], at)
    marked = np.empty(len(keys), bool)
    marked[order] = owners[order] > np.repeat(smallest, np.diff(np.append(at, len(keys))))
    grid = np.zeros((len(rank), REACH + 3), bool)
    grid[:, 1:-1][inside] = marked
    rise = np.argwhere(grid[:, 1:] & ~grid[:, :-1])
    fall = np.argwhere(~grid[:, 1:] & grid[:, :-1])
    who = rise[:, 0]
    return doc[who], first[who] + rise[:, 1], first[who] + fall[:, 1] - 1 + LENGTH


def _marked(dealt: DataFrame) -> DataFrame:
    def run(batches):
        out = lambda d, a, b: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, a, b)], ["doc", "from", "to"])
        held = [[], [], [], [], []]
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(1, 9))):
                for h, x, t in zip(held, row[:5], (np.uint64, np.int64, np.int64, np.uint8, np.uint8)):
                    h.append(np.frombuffer(x, t))
                done = [np.frombuffer(x, np.int64) for x in row[5:]]
                if len(done[0]):
                    yield out(*done)
        if held[0]:
            rank, doc, first, count, near = map(np.concatenate, held)
            held.clear()
            near, count = near.reshape(-1, CONTEXT), count.astype(np.int64)
            # classes are independent, so they are ranked a few million windows at a time
            order = np.argsort(rank, kind="stable")
            sizes = np.cumsum(count[order])
            begin = 0
            while begin < len(order):
                end = int(np.searchsorted(sizes, sizes[begin] + (1 << 21), side="right"))
                end = max(end, begin + 1)
                while end < len(order) and rank[order[end]] == rank[order[end - 1]]:
                    end += 1
                part = order[begin:end]
                yield out(*mark_windows(rank[part], doc[part], first[part], count[part], near[part]))
                begin = end

    return dealt.mapInArrow(run, "doc long, `from` long, `to` long")


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(rest, bytes removed, maximal runs removed)."""
    rest, removed, runs, done = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > done:
            runs += 1
            rest.append(raw[max(done, 0) : a])
            removed += b - a
            done = b
        elif b > done:
            removed += b - done
            done = b
    rest.append(raw[max(done, 0) :])
    return b"".join(rest), removed, runs


def repeated_spans(docs: DataFrame, bucket_bytes: int = 24 << 20) -> tuple[DataFrame, DataFrame]:
    """For docs (doc_id, text): the copies (doc_id, n_bytes) of earlier texts of 50 bytes and more, and (doc_id, spans) of the other repeats."""
    sized = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    prints = materialize(sized.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("p"), F.sha2("text", 256).alias("q")), "prints")
    firsts = prints.groupBy("p", "q").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id")
    firsts = dealt_anew(firsts, "p").select("join_key", F.col("q").alias("q_"), "first_id")
    copies = dealt_anew(prints, "p").join(firsts, "join_key").filter("q = q_ AND doc_id > first_id").select("doc_id", "n_bytes").distinct()
    copies = materialize(copies, "copies")
    total = prints.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total / 18 * 24 / bucket_bytes))  # a leader in 18 bytes, 24 bytes each
    copy_ids = size_checked(copies.select(F.col("doc_id").alias("copy_id")))
    singles = sized.join(copy_ids, F.col("doc_id") == F.col("copy_id"), "left_anti").select("doc_id", "text")
    stay = materialize(_survivors(_deal_first(singles, buckets).repartition(buckets, "bucket")), "survivors")
    codes = stay.groupBy("doc").agg(F.collect_list("code").alias("codes"))  # at most one per byte of the text
    wanted = size_checked(materialize(stay.select(F.col("doc").alias("wanted")).distinct(), "wanted"))
    near = singles.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
    near = near.join(codes, F.col("doc_id") == F.col("doc")).select("doc_id", "codes", "text")
    n_near = max(1, math.ceil(stay.count() * (CONTEXT + 40) / bucket_bytes))
    marked = _marked(_deal_neighbourhoods(near, n_near).repartition(n_near, "bucket"))
    spans = marked.groupBy("doc").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    return copies, materialize(spans.select(F.col("doc").alias("doc_id"), "spans"), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of each row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    copies, spans = repeated_spans(docs)
    touched = materialize(copies.select(F.col("doc_id").alias("touched")).unionByName(spans.select(F.col("doc_id").alias("touched"))).distinct(), "touched")
    touched = size_checked(touched)
    zero = F.lit(0).cast("long")
    body = F.col("text").cast("binary")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    clean = docs.join(touched, F.col("doc_id") == F.col("touched"), "left_anti")
    clean = clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), body.alias("kept"))
    copied = docs.join(size_checked(copies.select(F.col("doc_id").alias("copy_id"), "n_bytes")), F.col("doc_id") == F.col("copy_id"))
    copied = copied.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(b"").alias("kept"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, found, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                kept, removed, runs = cut_out(raw, [(s["from"], s["to"]) for s in found])
                rows.append((doc, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    cut = docs.join(touched, F.col("doc_id") == F.col("touched"), "left_semi").join(spans, "doc_id").select("doc_id", "spans", "text")
    cut = cut.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return clean.unionByName(copied.select(*names)).unionByName(cut)
