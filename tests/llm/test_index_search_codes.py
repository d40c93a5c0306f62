"""Digest index, lexical search and vector codes against brute force on small tables with every awkward case."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, frame

from millrace.llm import digest_index, lexical_search, vector_codes

# ---- digest index


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected_decisions(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[squeezed(text)].append((doc, text))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        first = True
        for doc, text in sorted(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)):
            out.append((doc, keep[0], len(members), first, hashlib.sha256(key.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


def decided(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def copies():
    rng = random.Random(2)
    rows = documents() + [(None, "one"), (None, "only here, without an id"), (7000, "o n e"), (7001, " o n e\u0085"), (7002, " one")]
    rows += [(8000 + i, "hot text " + " " * (i % 7)) for i in range(300)]  # a third of all rows, several of the longest
    rng.shuffle(rows)
    return rows


def test_digest_decisions_equal_brute_force(spark):
    rows = copies()
    assert decided(digest_index.deduplicate(frame(spark, rows), buckets=3)) == expected_decisions(rows)


def test_digest_index_admits_only_new_texts(spark, tmp_path):
    rows = copies()
    first, second = rows[:200], rows[100:]
    index = digest_index.DigestIndex(spark, f"file://{tmp_path}/index", "digest_index_test", buckets=3)
    a = index.add(frame(spark, first)).collect()
    held = {r["text_sha256"]: r["keep_id"] for r in a}
    assert index.read().count() == len(held)
    b = index.add(frame(spark, second)).collect()
    for r in b:
        if r["text_sha256"] in held:
            assert (r["keep_id"], r["kept"]) == (held[r["text_sha256"]], False)
    new = {r["text_sha256"] for r in b} - held.keys()
    assert sorted(r["text_sha256"] for r in b if r["kept"]) == sorted(new)
    assert index.read().count() == index.read().select("digest").distinct().count() == len(held) + len(new)
    index.add(frame(spark, second))
    assert index.read().count() == len(held) + len(new)

    # a session that does not know the table reads it from its folder
    spark.sql("DROP TABLE digest_index_test")
    again = digest_index.DigestIndex(spark, f"file://{tmp_path}/index", "digest_index_test", buckets=3)
    assert again.read().count() == len(held) + len(new)
    assert not any(r["kept"] for r in again.add(frame(spark, rows)).collect())
    again.compact()
    assert again.read().count() == len(held) + len(new)


def test_digest_index_is_anti_joined_without_being_shuffled(spark, tmp_path):
    index = digest_index.DigestIndex(spark, f"file://{tmp_path}/plan", "digest_index_plan", buckets=4)
    index.add(frame(spark, copies()))
    found = digest_index.materialize(digest_index.candidates(digest_index.digested(frame(spark, copies()))), "candidates")
    plan = index.unknown(found)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: false") == 0


def test_kept_documents_have_their_texts_and_columns(spark):
    rows = copies()
    docs = frame(spark, rows)
    kept = digest_index.keep_new(docs, digest_index.deduplicate(docs, buckets=3))
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = [(d, k) for d, _, _, keep, k in expected_decisions(rows) if keep]
    assert sorted(((d, hashlib.sha256(squeezed(t).encode()).hexdigest()) for d, t in got), key=str) == sorted(want, key=str)


def test_digest_of_empty_table(spark):
    assert digest_index.deduplicate(frame(spark, []), buckets=3).collect() == []


# ---- lexical search


def terms(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def expected_ranks(docs, items, k):
    found = [(doc, Counter(terms(text))) for doc, text in docs]
    found = [(doc, c) for doc, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for doc, c in found:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def ranks(spark, docs, items, k, **stretches):
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS term", "4 AS doc_id")
    found = lexical_search.search(lexical_search.build_index(frame(spark, docs), **stretches), table, k)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)


ITEMS = [(1, "This very LINE is found in many documents"), (2, None), (3, ""), (4, "one two, three! one"), (5, "É é ß \U0001f600 ok"), (5, "a b c"), (None, "wa1 wbb22 changed"), (6, "nowhere-to-be-found"), (7, "a" * 5000)]


def test_terms_of_bytes_are_those_of_the_pattern():
    every = "".join(map(chr, range(0x250))) + "x\u0085y z   \U0001f600"
    assert [t.decode() for t in lexical_search.terms_of(every.encode())] == terms(every)


@pytest.mark.parametrize("k", [3, 1000])
def test_search_equals_brute_force(spark, k):
    docs = documents() + [(None, "one two three without an id"), (9001, "one two three"), (9000, "one two three")]
    docs += [(5000 + i, f"hot word hot w{i}") for i in range(150)]
    assert ranks(spark, docs, ITEMS, k) == expected_ranks(docs, ITEMS, k)


def test_search_over_many_stretches(spark):
    docs = documents()
    assert ranks(spark, docs, ITEMS, 5, stretch_postings=50, stretch_docs=2) == expected_ranks(docs, ITEMS, 5)


def test_a_frequent_term_is_dealt_over_buckets(spark):
    docs = [(i, f"common w{i}") for i in range(3000)]
    index = lexical_search.build_index(frame(spark, docs).repartition(4), stretch_docs=200)
    stored = spark.read.schema(lexical_search.PARTS).parquet(index.path).filter("kind = 'postings'")
    common = stored.filter("term = 'common'")
    assert common.select("salt").distinct().count() == common.count() > 1
    assert stored.filter("term <> 'common' AND salt <> 0").count() == 0
    assert common.agg({"df": "sum"}).first()[0] == index.n_documents == 3000


def test_search_of_empty_tables(spark):
    assert ranks(spark, [], ITEMS, 5) == []
    assert ranks(spark, [(1, None), (2, " .,")], ITEMS, 5) == []
    assert ranks(spark, documents(), [], 5) == []


# ---- vector codes

CASES = "vec_id long, embedding array<float>, label int, code string, error long, part int, vector int, label_key string"


def coded(spark, rows, **options):
    table = spark.createDataFrame([(i, v, lab, "c", 1, 2, 3, "k") for i, v, lab in rows], CASES)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.code_table(table, **options).collect()), key=str)


def expected_codes(rows, parts=4, entries=256, rounds=4):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length, cut = len(usable[0][1]), lambda v, k: v[k * len(v) // parts : (k + 1) * len(v) // parts]
    least = {}
    for i, v, _ in sorted((r for r in usable if r[0] is not None), key=lambda r: (r[0], r[1])):
        least.setdefault(i, v)
    seeds = [least[i] for i in sorted(least)[:entries]]
    books = [[cut(v, k) for v in seeds] for k in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((distance(x, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k, book in enumerate(books):
            members = defaultdict(list)
            for _, v, _ in usable:
                members[nearest(cut(v, k), book)[1]].append(cut(v, k))
            books[k] = [[sum(c) // len(members[j]) for c in zip(*members[j])] if j in members else e for j, e in enumerate(book)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by = [], Counter()
    for i, v, lab in usable:
        best = [nearest(cut(v, k), book) for k, book in enumerate(books)]
        out.append((i, "".join(f"{j:02x}" for _, j in best), min(sum(d for d, _ in best), 2**63 - 1), lab))
        by[lab] += out[-1][2]
    assert all(len(v) == length for _, v, _ in usable)
    return sorted(((i, c, e, min(by[lab], 2**63 - 1), sha) for i, c, e, lab in out), key=str)


def vectors(n, length, seed=3, scale=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (7, length))
    out = [(int(i) * 3 + 1, [float(x) for x in (centres[i % 7] + rng.normal(0, scale / 4, length)).astype(np.float32)], [None, 1, 2, 2][i % 4]) for i in range(n)]
    rng.shuffle(out)
    return [(int(i), v, lab) for i, v, lab in out]


AWKWARD = [(2, None, 1), (5, [0.1, None, 0.2, 0.3, 0.1, 0.1, 0.1, 0.1], 1), (8, [float("nan")] * 8, 2), (11, [float("-inf")] + [0.0] * 7, 2), (14, [0.0] * 8, None), (17, [0.0] * 8, None), (17, [0.0] * 8, None), (20, [-0.0001] * 8, 5), (None, [0.5] * 8, 5), (23, [3.0] + [0.0] * 7, 6)]


@pytest.mark.parametrize("entries", [1, 5, 16, 256])
def test_codes_equal_brute_force(spark, entries):
    rows = vectors(120, 8) + AWKWARD
    assert coded(spark, rows, entries=entries) == expected_codes(rows, entries=entries)


def test_codes_with_very_common_vector_and_other_shapes(spark):
    hot = [(1000 + i, [0.25, -0.5, 0.125, 0.75, 0.0, 0.5], 1) for i in range(60)]
    rows = vectors(60, 6, 4) + hot
    assert coded(spark, rows, parts=4, entries=8, rounds=2) == expected_codes(rows, parts=4, entries=8, rounds=2)


def test_codes_of_components_beyond_64_bit_squares(spark):
    rows = [(i, [float(np.float32(s * 10.0**e))] * 4, i % 2) for i, (s, e) in enumerate([(1, 12), (-1, 12), (2, 11), (1, 3), (1, 0), (-3, 15), (4, 15)])]
    got, want = coded(spark, rows, entries=3), expected_codes(rows, entries=3)
    assert got == want and any(r[2] == 2**63 - 1 for r in want)
    assert len(coded(spark, rows + [(50, [1e30] * 4, 1)], entries=3)) == len(rows)


def test_vectors_of_another_length_go(spark):
    rows = vectors(30, 8)
    assert coded(spark, rows + [(900, [0.1] * 4, 1), (901, [], 1)], entries=4) == expected_codes(rows, entries=4)


def test_codes_of_empty_table(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("scale", [1, 50, 4000])
def test_annulus_search_equals_all_distances(scale):
    rng = np.random.default_rng(scale)
    entries = rng.integers(-scale, scale + 1, (64, 5))
    x = rng.integers(-scale, scale + 1, (500, 5))
    who, best = vector_codes.NormOrder(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (best == every.min(1)).all() and (who == every.argmin(1)).all()


def test_annulus_leaves_far_norms_out():
    entries = np.arange(1, 257)[:, None] * np.array([[100, 0]])
    order = vector_codes.NormOrder(entries)
    order.nearest(np.array([[1234, 5]] * 100))
    assert order.evaluated <= 100 * 4
