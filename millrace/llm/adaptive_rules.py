"""Quality rules with thresholds that the corpus sets.

Each rule's cutoff comes from quantile sketches per language and source:
partial sketches merge before the shuffle, so a hot source costs one small
sketch per task. Mean word length has fences three times the distance of the
quartiles beyond them. Rates have an upper fence only, and most texts of a group may
have none of what is counted, so the sketch's upper quarter decides: the largest step
between two of its ranks, in units of the spread below the step, parts the body of
the group from its tail if it is more than three of them, and the fence lies three
units above the body. The spread is at least the rate of one occurrence in the
group's median text, and at least the median spread of the language's groups and of all
groups, as groups of copies have none of their own. Values are drawn to those of the
language, and these to those of all rows, the more the fewer rows a group has. A text
breaks a rate's fence if its own rate, less the error of a count that small, lies
above: the square root of a count has a standard error of a half, and three of
these are granted. So long and short texts are judged alike, and no constant is in
a metric's own unit or in occurrences. Built of DataFrame functions only.

Defined results: null or empty texts have no words, fail the base rule and are
dropped; null languages and sources are groups of their own; an empty table
gives an empty result; repeated rows are judged one by one; a value on a fence is
inside, ties alike; a text of any length is measured whole, in one row. Of the
input only ``keys`` are returned, so columns with the names of results do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import size_checked
from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
METRICS = ("symbol_ratio", "dup_line_ratio", "mean_word")
RANKS = (0.25, 0.75)
#: The median of a rate and the ranks at which its tail may begin: a quarter of a group may be bad.
TAIL = (0.5, 0.75, 0.8, 0.85, 0.9, 0.925, 0.95, 0.975, 0.99, 0.995, 0.999)
#: The count and the number of trials behind a metric that is a rate.
RATES = {"symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines")}


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeated_window_words(words: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows that occur twice or more, first occurrence included.

    Windows are compared by 64-bit hash. Only texts that repeat a window are
    sorted; that takes n log n steps.
    """

    def covered(starts: Column) -> Column:
        """Words under windows that begin at these ascending positions."""
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last"))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"].cast("long"))

    def of_hashes(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda j, h: F.coalesce(F.get(s, j)["h"] == h, F.lit(False))
            kept = F.filter(F.transform(s, lambda x, k: F.when(same(k - 1, x["h"]) | same(k + 1, x["h"]), x["i"])), lambda p: p.isNotNull())
            return covered(F.array_sort(kept))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(placed, repeated))

    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    )
    return let(words, lambda w: F.when(F.size(w) < width + 1, F.lit(0).cast("long")).otherwise(let(windows(w), of_hashes)))


def text_metrics(text: Column) -> Column:
    """struct of the base counts of one text, each in linear or n log n time."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    counted = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_window_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        counted.alias("w"),
        of_lines.alias("l"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )


def measure(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, the base counts and the three adaptive metrics of each row."""
    m = docs.select(*keys, text_metrics(F.col(text_col)).alias("m_"))
    counts = m.select(
        *keys,
        F.col("m_.w.n_words").alias("n_words"),
        F.col("m_.word_chars").alias("word_chars"),
        F.col("m_.n_symbols").alias("n_symbols"),
        F.col("m_.l.n_dup_lines").alias("n_dup_lines"),
        F.col("m_.w.n_repeat_words").alias("n_repeat_words"),
        F.col("m_.l.n_lines").alias("n_lines"),
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counts.withColumns(
        {
            "symbol_ratio": per("n_symbols", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "mean_word": per("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )


def thresholds(measured: DataFrame, groups: tuple[str, ...] = ("lang", "source"), accuracy: int = 10000) -> DataFrame:
    """The values of mean word length at ``RANKS`` and of each rate at ``TAIL``, and the median trials of rates, by (lang, source), by lang, and over all rows.

    ``percentile_approx`` keeps a mergeable sketch of at most about
    ``accuracy`` entries per group and task; the rank error is 1 / accuracy.
    Rows that fail the base rule take no part.
    """
    lang, source = groups
    base = measured.filter(~F.col("base_failed")).select(
        F.coalesce(F.col(lang), F.lit("")).alias("g_lang"), F.coalesce(F.col(source), F.lit("")).alias("g_source"), *METRICS, *[trials for _, trials in RATES.values()]
    )
    ranks = [F.percentile_approx(m, list(TAIL if m in RATES else RANKS), accuracy).alias(m) for m in METRICS]
    ranks += [F.percentile_approx(trials, 0.5, accuracy).alias(f"median_{trials}") for _, trials in RATES.values()]
    sets = base.groupingSets([["g_lang", "g_source"], ["g_lang"], []], "g_lang", "g_source")
    return sets.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("group_rows"), *ranks)


def spread(q: Column) -> Column:
    """struct(low, high, width) of the values at ``RANKS``."""
    return F.struct(q[0].alias("low"), q[1].alias("high"), (q[1] - q[0]).alias("width"))


def body(q: Column, trials: Column, fence: float) -> Column:
    """struct(low, high, width) of a rate's body: its median, its upper edge, and the spread between, at least one occurrence in ``trials``.

    The edge is where the largest step to the next rank is taken, measured in the
    spread below it, if that is more than ``fence``, the lowest of equal ones; else the last rank.
    """
    one = 1.0 / F.greatest(trials, F.lit(1))
    width = lambda i: F.greatest(q[i] - q[0], one)
    last = len(TAIL) - 1
    steps = F.array(*[F.struct(((q[i + 1] - q[i]) / width(i)).alias("step"), F.lit(-i).alias("i")) for i in range(1, last)])
    edge = let(F.array_max(steps), lambda s: F.when(s["step"] > fence, -s["i"]).otherwise(last))
    return let(edge, lambda i: F.struct(q[0].alias("low"), F.get(q, i).alias("high"), F.greatest(F.get(q, i) - q[0], one).alias("width")))


def _drawn(own: Column, wider: Column, rows: Column, weight: float) -> Column:
    """``own`` moved to ``wider`` as if ``weight`` rows of the latter had been seen too; the larger width; ``wider`` where there is no own."""
    share = rows / (rows + F.lit(weight))
    moved = [(wider[k] + share * (own[k] - wider[k])).alias(k) for k in ("low", "high")]
    return F.coalesce(F.struct(*moved, F.greatest(own["width"], wider["width"]).alias("width")), wider)


def adaptive_verdict(
    docs: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    groups: tuple[str, str] = ("lang", "source"),
    fence: float = 3.0,
    weight: float = 5.0,
) -> DataFrame:
    """``keys``, the base counts, ``base_failed`` and ``kept`` of each row.

    ``fence`` counts widths of a group beyond its edges, and standard errors of a
    text's own counts. A text is kept if it passes the base rule and stays within its group's
    fences: symbols per word and share of repeated lines from above, mean word
    length from both sides. Thresholds are broadcast if they are small, and
    joined by shuffle beyond.
    """
    lang, source = groups
    keep = list(dict.fromkeys([*keys, *groups]))
    measured = materialize(measure(docs, keep, text_col), "measured")
    table = materialize(thresholds(measured, groups), "thresholds")
    # the median width of groups, of a language and of all: sketches over one row per group
    own = lambda m: body(F.col(m), F.col(f"median_{RATES[m][1]}"), fence) if m in RATES else spread(F.col(m))
    table = materialize(table.withColumns({m: own(m) for m in METRICS}), "spreads")
    widths = table.filter("level = 0").select("g_lang", *[F.col(f"{m}.width").alias(m) for m in METRICS])
    medians = [F.percentile_approx(m, 0.5, 10000).alias(f"width_{m}") for m in METRICS]
    of_lang, of_all = widths.groupBy(F.col("g_lang").alias("w_lang")).agg(*medians), widths.agg(*medians)
    usual = lambda m: F.struct(F.col(f"{m}.low"), F.col(f"{m}.high"), F.col(f"width_{m}").alias("width"))
    everything = table.filter("level = 3").crossJoin(F.broadcast(of_all)).select(*[usual(m).alias(f"all_{m}") for m in METRICS])  # one row each
    by_lang = table.filter("level = 1").crossJoin(F.broadcast(everything))  # one row
    by_lang = by_lang.join(of_lang, F.col("g_lang") == F.col("w_lang"))
    by_lang = by_lang.select(F.col("g_lang").alias("l_lang"), *[_drawn(usual(m), F.col(f"all_{m}"), F.col("group_rows"), weight).alias(f"l_{m}") for m in METRICS])
    by_group = table.filter("level = 0").join(by_lang, F.col("g_lang") == F.col("l_lang"))
    drawn = {m: _drawn(F.col(m), F.col(f"l_{m}"), F.col("group_rows"), weight) for m in METRICS}
    by_group = by_group.select("g_lang", "g_source", *[c for m, x in drawn.items() for c in ((x["low"] - fence * x["width"]).alias(f"low_{m}"), (x["high"] + fence * x["width"]).alias(f"high_{m}"))])
    by_group = size_checked(materialize(by_group, "fences"))
    same = (F.coalesce(measured[lang], F.lit("")) == by_group["g_lang"]) & (F.coalesce(measured[source], F.lit("")) == by_group["g_source"])
    joined = measured.join(by_group, same, "left")
    fine = F.lit(True)
    for m in METRICS:
        if m in RATES:
            count, trials = RATES[m]
            surely = F.pow(F.greatest(F.sqrt(count) - F.lit(fence / 2), F.lit(0.0)), F.lit(2.0))
            inside = surely <= F.col(f"high_{m}") * F.col(trials)
        else:
            inside = F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
        fine = fine & F.coalesce(inside, F.lit(True))
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed"]
    return joined.select(*[measured[k] for k in keys], *out, (~F.col("base_failed") & fine).alias("kept"))


def keep_passing(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id no rejected row has; rows without an id stay."""
    verdict = materialize(adaptive_verdict(docs, keys=(id_col,), **options).select(id_col, "kept"), "verdicts")
    rejected = size_checked(verdict.filter("NOT kept").select(F.col(id_col).alias("rejected_id")).distinct())
    return docs.join(rejected, docs[id_col] == rejected["rejected_id"], "left_anti")
