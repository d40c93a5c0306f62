"""Shortest-pack-first packing over the length histogram.

Documents become token ids, are cut into pieces of at most one sequence, and
only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver. Lengths are placed longest first into the pack with the most room, as
counts of packing patterns; pieces then find their place by their rank among
the pieces of their length.

Defined results: null text is empty and yields the end id alone; a document of
more than ``capacity`` ids is cut every ``capacity`` ids; repeated rows are
packed once each; an empty table yields no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoder(path: str):
    """text -> list of ids of the byte-level BPE in a tokenizers JSON file.

    The merges of such a vocabulary are ranked by id, so the file's vocabulary
    serves as ranks; this runs several times faster and gives the same ids.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of = byte_level_alphabet()
    ranks = {bytes(of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    coder = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return coder.encode(text, allowed_special="all")
        return coder.encode_ordinary(text)

    return encode


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, block int, ordinal long"


def cut_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ``ordinal`` counts the pieces of that length in the task ``block``."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        encode = load_encoder(path)
        block = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                raw, n = np.array(ids, "<u4"), len(ids)
                for start in range(0, n, capacity):
                    part = raw[start : start + capacity]
                    rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), n, block, int(seen[len(part)])))
                    seen[len(part)] += 1
            if rows:
                types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block", "ordinal"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, tuple[int, ...]]]:
    """[(packs, lengths in one such pack)] for a histogram of lengths.

    Longest lengths go first; each goes to the shortest pack so far, which is
    the one with the most room, whole groups of equal packs at a time.
    """
    open_packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by room left
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], capacity
        while left > 0:
            while room >= length and not open_packs.get(room):
                room -= 1
            if room < length:
                open_packs[capacity - length].append((left, (length, None)))
                break
            count, pattern = open_packs[room].pop()
            used = min(count, left)
            if count > used:
                open_packs[room].append((count - used, pattern))
            open_packs[room - length].append((used, (length, pattern)))
            left -= used
    out = []
    for groups in open_packs.values():
        for count, pattern in groups:
            lengths = []
            while pattern is not None:
                lengths.append(pattern[0])
                pattern = pattern[1]
            out.append((count, tuple(reversed(lengths))))
    return sorted(out, key=lambda p: (-sum(p[1]), p[1], p[0]))


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, as ranges of their rank, ordered by (length, first rank)."""
    ranks, rows, base = defaultdict(int), [], 0
    for count, lengths in patterns:
        offset, total = 0, sum(lengths)
        for length in lengths:
            rows.append((length, ranks[length], base, offset, total))
            ranks[length] += count
            offset += length
        base += count
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "offset", "total"), columns))


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with ``sequence_id``, ``offset`` and ``padded_length`` of their sequence.

    A sequence is padded to ``capacity`` unless its length is a power of two.
    """
    pieces = materialize(cut_pieces(docs, capacity, end_id, tokenizer, id_col, text_col), "pieces")
    per_block = materialize(pieces.groupBy("block", "length").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    slots = slots_of(shortest_pack_first(histogram, capacity))
    before = per_block.select(
        "block", "length", F.expr("sum(count) OVER (PARTITION BY length ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count").alias("before")
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = pieces.join(before, ["block", "length"]).select(*names, (F.col("before") + F.col("ordinal")).alias("rank"))

    def place(batches):
        # ranks stay below 2^51: more pieces of one length than any corpus has
        keys = (slots["length"] << 51) | slots["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 51) | rank, side="right") - 1
            total = slots["total"][at]
            padded = np.where(total & (total - 1), capacity, total)
            made = [slots["sequence"][at] + rank - slots["rank"][at], slots["offset"][at], padded]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, made)], [*names, "sequence_id", "offset", "padded_length"])

    return ranked.mapInArrow(place, ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset", "padded_length"]))
