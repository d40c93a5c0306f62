"""The registered queries of this subpackage, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_rules, decontaminate, digest_index, fuzzy_lines, length_packing, lexical_search, minhash_bayes, pairwise_quality, secret_crf, suffix_dedup, url_vocabulary, vector_codes, warc_revisit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_revisit.deduplicate_archives(table(spark, sf_dir, "pages"))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL2 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), o AS (
  SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.n >= 100 AND p.page_id <> o.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 100 AND p.page_id <> o.first THEN o.first END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d
"""


def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_vocabulary.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _sql3() -> str:
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda t: f"regexp_matches({lower}, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    strict = " OR ".join(hit(t) for t in url_vocabulary.STRICT_TERMS)
    soft = " + ".join(f"CAST({hit(t)} AS INT)" for t in url_vocabulary.SOFT_TERMS)
    cases = {"rule": "", "says": ""}
    for text, says in sorted(url_vocabulary.RULES, key=lambda r: -len(r[0])):
        domain, slash, tail = text.partition("/")
        fits = f"WHEN (host = '{domain}' OR host LIKE '%.{domain}') AND starts_with(path, '{slash + tail}') THEN "
        cases["rule"] += f"{fits}'{text}' "
        cases["says"] += f"{fits}'{says}' "
    return f"""
WITH r AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
)
SELECT page_id, host, path, CASE {cases["rule"]} END AS rule,
  coalesce(CASE {cases["says"]} END, CASE WHEN {strict} OR {soft} >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM s
"""


def op6_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = adaptive_rules.adaptive_verdict(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL6_MEASURED = r"""
w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), again AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM again, range(0, 5) AS t(k)) GROUP BY doc_id
), ln AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
), m AS (
  SELECT w.doc_id, w.lang, w.source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM w JOIN ln ON w.doc_id = ln.doc_id LEFT JOIN covered c ON w.doc_id = c.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN CAST(n_symbols AS DOUBLE) / n_words END AS symbol_ratio,
    CASE WHEN n_lines > 0 THEN CAST(n_dup_lines AS DOUBLE) / n_lines END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN CAST(word_chars AS DOUBLE) / n_words END AS mean_word
  FROM m
)"""


def _sql6() -> str:
    metrics, lang, source = ("symbol_ratio", "dup_line_ratio", "mean_word"), "coalesce(lang, '')", "coalesce(source, '')"
    trials = {"symbol_ratio": "n_words", "dup_line_ratio": "n_lines"}
    tail = (0.5, 0.75, 0.8, 0.85, 0.9, 0.925, 0.95, 0.975, 0.99, 0.995, 0.999)
    keys = {"g": {"k_lang": lang, "k_source": source}, "l": {"k_lang": lang}, "a": {}}
    parts = []
    for name, by in keys.items():
        # the value at rank ceil(q * n) of each group, as the sketch returns it while it holds every value
        over = f"PARTITION BY {', '.join(by.values())}" if by else ""
        ranked = ", ".join(f"row_number() OVER ({over} ORDER BY {m}) AS r_{m}, count({m}) OVER ({over}) AS n_{m}" for m in (*metrics, *trials.values()))
        pick = lambda m, q: f"max({m}) FILTER (r_{m} = greatest(1, ceil({q}::DOUBLE * n_{m})))"
        picks = ", ".join(f"[{', '.join(pick(m, q) for q in tail)}] AS {m}_q, 1.0::DOUBLE / greatest({pick(t, 0.5)}, 1) AS {m}_one" for m, t in trials.items())
        picks += f", {pick('mean_word', 0.25)} AS mean_word_0, {pick('mean_word', 0.75)} AS mean_word_1"
        steps = ", ".join(f"[({m}_q[i + 1] - {m}_q[i]) / greatest({m}_q[i] - {m}_q[1], {m}_one) for i in range(2, {len(tail)})] AS {m}_s" for m in trials)
        edges = ", ".join(f"{m}_q[CASE WHEN list_max({m}_s) > 3 THEN list_position({m}_s, list_max({m}_s)) + 1 ELSE {len(tail)} END] AS {m}_e" for m in trials)
        named = "".join(f"{expr} AS {k}, " for k, expr in by.items())
        sides = ", ".join(f"{m}_e AS {name}_high_{m}, greatest({m}_e - {m}_q[1], {m}_one) AS {name}_w_{m}" for m in trials)
        sides += f", mean_word_0 AS {name}_low_mean_word, mean_word_1 AS {name}_high_mean_word, mean_word_1 - mean_word_0 AS {name}_w_mean_word"
        kept = "".join(f"{k}, " for k in by)
        parts.append(
            f"{name}_r AS (SELECT *, {ranked} FROM b WHERE NOT base_failed), "
            f"{name}_p AS (SELECT {named}CAST(count(*) AS DOUBLE) AS {name}_n, {picks} FROM {name}_r GROUP BY ALL), "
            f"{name}_q AS (SELECT {kept}{name}_n, {sides} FROM (SELECT *, {edges} FROM (SELECT *, {steps} FROM {name}_p)))"
        )
    for name, by in (("lw", "PARTITION BY k_lang"), ("aw", "")):
        ranked = ", ".join(f"g_w_{m}, row_number() OVER ({by} ORDER BY g_w_{m}) AS r_{m}" for m in metrics)
        middle = ", ".join(f"max(g_w_{m}) FILTER (r_{m} = ceil(0.5 * n)) AS {name[0]}_w_{m}" for m in metrics)
        parts.append(f"{name} AS (SELECT {'k_lang, ' if by else ''}{middle} FROM (SELECT k_lang, {ranked}, count(*) OVER ({by}) AS n FROM g_q) GROUP BY ALL)")
    drawn = lambda own, wider, n: f"({wider} + {n} / ({n} + 5.0::DOUBLE) * ({own} - {wider}))"
    checks = []
    for m in metrics:
        quartile = lambda k: drawn(f"g_{k}_{m}", drawn(f"l_{k}_{m}", f"a_{k}_{m}", "l_n"), "g_n")  # noqa: B023, E731
        width = f"3.0::DOUBLE * greatest(g_w_{m}, lw.l_w_{m}, aw.a_w_{m})"
        count = {"symbol_ratio": "n_symbols", "dup_line_ratio": "n_dup_lines"}.get(m)
        inside = f"pow(greatest(sqrt({count}) - 1.5::DOUBLE, 0), 2) <= ({quartile('high')} + {width}) * {trials[m]}" if count else f"{m} BETWEEN {quartile('low')} - {width} AND {quartile('high')} + {width}"
        checks.append(f"(g_n IS NULL OR coalesce({inside}, true))")
    return f"""
WITH {_SQL6_MEASURED}, {", ".join(parts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(checks)} AS kept
FROM b LEFT JOIN g_q ON {lang} = g_q.k_lang AND {source} = g_q.k_source
LEFT JOIN l_q ON {lang} = l_q.k_lang LEFT JOIN a_q ON true LEFT JOIN lw ON {lang} = lw.k_lang LEFT JOIN aw ON true
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda c: F.crc32(c.cast("string")) % 4 == 2
    scored = pairwise_quality.score_documents(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "quality"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_bayes.near_duplicates(table(spark, sf_dir, "documents"))


def op8_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_crf.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secret_crf.span_digest(base), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), digest, secret_crf.span_digest(F.col("secrets")).alias("spans"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.drop_duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_table(table(spark, sf_dir, "embeddings"))


def _sql11(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Brute force: every part against every entry; inner products of integers below 2**53 are exact in doubles."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT p.vec_id, p.label, p.k, p.x, min(struct_pack(d := p.n2 - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), c := b.c)) AS best "
            f"FROM parts p JOIN b{i} b ON p.k = b.k GROUP BY p.vec_id, p.label, p.k, p.x)"
        )
        if i < rounds:
            steps.append(
                f"s{i} AS (SELECT k, best.c AS c, unnest(x) AS v, unnest(range(len(x))) AS pos FROM a{i}), "
                f"m{i} AS (SELECT k, c, pos, floor(sum(v) / count(*)) AS v FROM s{i} GROUP BY k, c, pos), "
                f"n{i} AS (SELECT k, c, list(v ORDER BY pos) AS x FROM m{i} GROUP BY k, c), "
                f"b{i + 1} AS MATERIALIZED (SELECT b.k, b.c, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN n{i} n ON b.k = n.k AND b.c = n.c)"
            )
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * CAST(y AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), w AS (
  SELECT vec_id, label, k, e[k * len(e) // {parts} + 1:(k + 1) * len(e) // {parts}] AS x FROM v, range({parts}) AS t(k)
), parts AS MATERIALIZED (
  SELECT *, list_inner_product(x, x) AS n2 FROM w
), b0 AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS c, x FROM parts
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})
), {", ".join(steps)}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.c), '' ORDER BY k) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label
), digest AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY k, c, pos)) AS codebooks_sha256
  FROM (SELECT k, c, unnest(x) AS v, unnest(range(len(x))) AS pos FROM b{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = digest_index.deduplicate(table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL12 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL13 = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term
), d AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id
), s AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d
), w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs
), m AS (
  SELECT doc_id, 100 - 50 + (50 * n * n_docs) // n_terms AS m FROM d, s
), r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc_revisit": op2_warc_revisit,
    "op3_url_vocabulary": op3_url_vocabulary,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_pairwise_quality": op5_pairwise_quality,
    "op6_adaptive_rules": op6_adaptive_rules,
    "op7_minhash_bayes": op7_minhash_bayes,
    "op8_length_packing": op8_length_packing,
    "op9_secret_crf": op9_secret_crf,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_annular_codes": op11_annular_codes,
    "op12_digest_index": op12_digest_index,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES = {"op2_warc_revisit": SQL2, "op3_url_vocabulary": _sql3(), "op6_adaptive_rules": _sql6(), "op11_annular_codes": _sql11(), "op12_digest_index": SQL12, "op13_lexical_search": SQL13}
