"""URL filter by host rules and a weighted vocabulary.

One Aho-Corasick pass over each URL counts strict and soft terms that stand
between boundaries (anything but ASCII letters and digits). One strict hit, or
``soft_limit`` distinct soft terms, blocks a URL that no rule decides.

Defined results: a null URL or one without ``://`` has an empty host and path
and is allowed unless its text holds the terms; a null URL is allowed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that block alone, and terms that block in company.
STRICT_TERMS = ("porn", "xxx", "viagra", "casino", "spam-farm", "cheap-pills")
SOFT_TERMS = ("adult", "bet", "bonus", "cash", "cheap", "dating", "free", "hot", "loan", "pills", "poker", "sexy", "spam", "win")
#: Fixed values: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the last to fit is the longest
        domain, slash, tail = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def term_hits(url: Column, strict=STRICT_TERMS, soft=SOFT_TERMS) -> Column:
    """struct(strict_hits, soft_hits): occurrences of strict terms, distinct soft terms."""
    terms = {t: True for t in strict} | {t: False for t in soft}

    @F.pandas_udf("strict_hits int, soft_hits int")
    def scan(urls: pd.Series) -> pd.DataFrame:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, hard in terms.items():
            automaton.add_word(term, (term, hard))
        automaton.make_automaton()
        word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        hard_hits, soft_hits = [], []
        for url in urls:
            hard, found = 0, set()
            if url:
                text = url.translate(lower)
                for end, (term, is_hard) in automaton.iter(text):
                    start = end - len(term) + 1
                    if (start and text[start - 1] in word) or text[end + 1 : end + 2] in word:
                        continue
                    if is_hard:
                        hard += 1
                    else:
                        found.add(term)
            hard_hits.append(hard)
            soft_hits.append(len(found))
        return pd.DataFrame({"strict_hits": hard_hits, "soft_hits": soft_hits})

    return scan(url)


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS, soft_limit: int = 2) -> DataFrame:
    """Add host, path, rule, strict_hits, soft_hits and verdict to ``pages``."""
    host, path = split_url(F.col(url_col))
    scanned = pages.withColumns({"host": host, "path": path, "hits_": term_hits(F.col(url_col), strict, soft)})
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    by_terms = F.when((F.col("hits_.strict_hits") >= 1) | (F.col("hits_.soft_hits") >= soft_limit), "block").otherwise("allow")
    return scanned.withColumns({"rule": rule, "strict_hits": F.col("hits_.strict_hits"), "soft_hits": F.col("hits_.soft_hits"), "verdict": F.coalesce(says, by_terms)}).drop("hits_")
