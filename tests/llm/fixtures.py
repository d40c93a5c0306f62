"""Documents with every awkward case, small enough for brute force."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept boolean, n_words long, component_id long, h long, id long, key string, gone_id long, label_id long, holder long, wanted long, a long, b long, doc long, page_id string, bands string"
)


def prose(rng, n, vocabulary=400):
    return " ".join("w" + "abcdefghij"[rng.randrange(10)] * (1 + rng.randrange(3)) + str(rng.randrange(vocabulary)) for _ in range(n))


def documents():
    """(doc_id, text) pairs: nulls, empties, long texts, ties, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 160)) for _ in range(40)]
    texts = list(base)
    texts += [base[3], base[3], base[7]]  # exact copies
    for k in (1, 2, 9, 9, 9):  # near copies
        words = base[k].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 15)}" for _ in range(4)]
    line = "this very line is found in many documents of the corpus 12"
    texts += [f"{prose(rng, 30)}\n{line}\n{prose(rng, 12)}\nThis  very line is found in many documents of the corpus 99" for _ in range(5)]
    texts += [None, "", " \n\t ", "one", "one two three", "One TWO three", "É é \u00a0 ß \U0001f600 ok", "a b c d e f g h i j " * 30, "x" * 400, "y" * 300 + " " + "x" * 120]
    texts += ["\n".join(prose(rng, 12) for _ in range(400))]  # long
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5]]  # repeated rows


def frame(spark, rows=None):
    """The documents as a table with extra columns whose names clash with those of results."""
    rows = documents() if rows is None else rows
    full = []
    for i, (doc, text) in enumerate(rows):
        full.append((doc, text, [None, "en", "fr"][i % 3], [None, "s1", "hot", "hot"][i % 4], len(text or ""), True, -1, -1, -1, -1, "k", 1, 2, 3, 4, 5, 6, 7, "p", "q"))
    return spark.createDataFrame(full, SCHEMA)
