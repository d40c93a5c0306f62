"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage by k = floor(rate * n)
edits. Cut into k + 1 pieces, at least one piece survives k edits unchanged, so
exact hits of pieces (one Aho-Corasick pass over the text) find every match;
Myers' bit-parallel edit distance then verifies the text around each hit.

The documents are never shuffled. The items are read in blocks of about
``block_bytes``, each block being one pass over the documents, which bounds
what is broadcast however large the benchmark is.

Defined results: letter case and kinds of white space do not count; null and
empty texts match nothing, nor do null and blank items; items shorter than
``min_chars`` are found unchanged only, and between characters that are no letters or
digits, as they would match ordinary prose otherwise; of equally good places the
first counts; repeated items and documents are reported once each; a text of any
length is searched whole; an empty benchmark or corpus gives no rows. Columns of
``docs`` besides id and text do not matter to the search and stay in
``drop_contaminated``.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

HITS = "doc_id long, item_id long, distance int, item_chars int, start long, end long"


def normalize(text: str) -> str:
    """Lower case and plain spaces, one character for each, so that offsets stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    for space in "\n\t\r\x0b\x0c\xa0":
        low = low.replace(space, " ")
    return low


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 pieces (start, end) of nearly equal length that cover the item."""
    cuts = [length * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:]))


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def best_end(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of ``text``, its first end), bit-parallel."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    up, down, score, best, at = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, at = score, j
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
    return best, at


class Matcher:
    """The pieces of one block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        import ahocorasick

        self.items, self.min_chars, found = [], min_chars, defaultdict(list)
        for item_id, text in items:
            errors = math.floor(rate * len(text)) if len(text) >= min_chars else 0
            for start, end in pieces(len(text), errors):
                found[text[start:end]].append((len(self.items), start))
            self.items.append((item_id, text, errors, letter_masks(text), letter_masks(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, text: str):
        """(item_id, distance, item length, start, end) of the best match of each item that occurs."""
        low = normalize(text)
        if not self.items:
            return
        shifts = defaultdict(set)
        for end, (length, where) in self.automaton.iter(low):
            for item, offset in where:
                shifts[item].add(end + 1 - length - offset)
        for item, places in shifts.items():
            item_id, pattern, errors, masks, backward = self.items[item]
            m = len(pattern)
            if m < self.min_chars:
                apart = lambda i: not low[i : i + 1].isalnum() if i >= 0 else True
                place = min((p for p in places if apart(p - 1) and apart(p + m)), default=None)  # one piece: every hit is whole
                if place is not None:
                    yield item_id, 0, m, place, place + m
                continue
            exact = next((p for p in sorted(places) if p >= 0 and low.startswith(pattern, p)), None)
            if exact is not None:
                yield item_id, 0, m, exact, exact + m
                continue
            best = (errors + 1, 0)
            ordered = sorted(places)
            first = last = ordered[0]
            for place in [*ordered[1:], None]:
                if place is not None and place - last <= 2 * errors:
                    last = place
                    continue
                begin = max(0, first - errors)
                distance, at = best_end(masks, m, low[begin : last + m + errors])
                best = min(best, (distance, begin + at))
                first = last = place
            distance, end = best
            if distance <= errors:
                length = best_end(backward, m, low[max(0, end - m - errors) : end][::-1])[1]
                yield item_id, distance, m, end - length, end


def _blocks(benchmark: DataFrame, block_bytes: int):
    """(broadcast of the items, whether it is the last) block by block."""
    spark = benchmark.sparkSession
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length(F.trim("text")) > 0).dropDuplicates()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        rows = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about block_bytes
        items = [(r["item_id"], t) for r in rows if (t := normalize(r["text"]).strip())]
        yield spark.sparkContext.broadcast(items), k == n - 1


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_chars: int = 40, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per (document, item) that match: distance, and the code points that match."""
    out = None
    for block, last in _blocks(benchmark, block_bytes):

        def run(batches, block=block):
            matcher = Matcher(block.value, rate, min_chars)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) if text.is_valid for hit in matcher.search(text.as_py())]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "item_id", "distance", "item_chars", "start", "end"])

        hits = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, HITS)
        if not last:  # one block at a time is in memory
            hits = materialize(hits, "hits")
            block.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_chars: int = 40, block_bytes: int = 8 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    at = docs.columns.index(text_col)
    for block, last in _blocks(benchmark, block_bytes):

        def run(batches, block=block):
            matcher = Matcher(block.value, rate, min_chars)
            for batch in batches:
                clean = [not text.is_valid or next(matcher.search(text.as_py()), None) is None for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = materialize(docs, "clean")
            block.destroy()
    return docs
