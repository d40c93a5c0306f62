"""Operators on pages, and the pipeline against a brute-force version."""

import hashlib

import corpus_pipeline
from fixtures import documents, frame
from pyspark.sql import functions as F

from millrace.llm import decontaminate, url_vocabulary, warc_revisit

PAGES = "page_id long, url string, html string, host string, path string, record_id long, payload_digest string, hits_ string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", 1, "d", "x") for r in rows], PAGES)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a/x", big), (2, "http://b/y", big), (9, None, big), (1, "u\r\nEvil: 1", "small"), (3, "v", "small"), (4, "w", None), (6, "z", ""), (7, "q", "x" * 100), (8, "q", "x" * 100), (8, "q", "x" * 100), (10, "q", "y" * 99), (11, "q", "y" * 99)]
    source = pages(spark, rows)
    warc_revisit.write_archives(source, str(tmp_path / "w"), archive_bytes=500)
    got = warc_revisit.read_archives(spark, str(tmp_path / "w")).collect()
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    want = []
    for i, url, html in rows:
        raw = (html or "").encode()
        to = first.get(raw, i)
        want.append((i, hashlib.sha256(raw).hexdigest(), len(raw), "revisit" if to != i else "response", to if to != i else None, raw if to == i else None))
    key = lambda r: (r[0], r[1])
    assert sorted(((r["record_id"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] is not None else None) for r in got), key=key) == sorted(want, key=key)
    assert {r["record_id"]: r["refers_to_uri"] for r in got}[5] == "http://b/y"
    assert warc_revisit.deduplicate_archives(pages(spark, [])).count() == 0


def test_archives_follow_the_format(spark, tmp_path):
    import gzip

    warc_revisit.write_archives(pages(spark, [(1, "http://a/", "body")]), str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == "response"
    block = rest[: int(fields["Content-Length"])]
    assert block.startswith(b"HTTP/1.1 200 OK\r\n") and block.endswith(b"\r\n\r\nbody") and rest[len(block) :] == b"\r\n\r\n"


def test_url_rules_and_terms(spark):
    cases = {
        "http://x.example.net/en/1": ("x.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/fr/1": ("example.net", "/fr/1", "net/", "block"),
        "https://A.Example.COM/de/casino": ("a.example.com", "/de/casino", "example.com/de/", "block"),
        "http://example.org/fr/porn": ("example.org", "/fr/porn", "org/fr/", "allow"),
        "http://ok.com/casino?x=1": ("ok.com", "/casino", None, "block"),
        "http://ok.com/casinos": ("ok.com", "/casinos", None, "allow"),
        "http://ok.com/FREE-free": ("ok.com", "/FREE-free", None, "allow"),
        "http://ok.com/free/win": ("ok.com", "/free/win", None, "block"),
        "http://net": ("net", "", None, "allow"),
        "http://net?a/b": ("net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    got = url_vocabulary.judge_urls(pages(spark, [(i, u, "") for i, u in enumerate(cases)])).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == list(cases.values())
    assert url_vocabulary.judge_urls(pages(spark, [])).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    from test_text_operators import base_counts, lines_removed_by_brute_force, near_by_brute_force

    rows = list(dict(documents()).items())
    item = "What is the capital city of the country that lies between the two great rivers of the north?"
    rows.append((9001, f"{item} {dict(rows)[1]} more words so that this one is no near copy at all of any other text here"))
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["quality rules"]
    assert {r["doc_id"] for r in after} <= {d for d, t in before.items() if not base_counts(t)[-1]} and len(after) > 40
    before, after = seen["line dedup"]
    gone, left = lines_removed_by_brute_force(list(before.items())), {}
    for d, t in before.items():
        lines = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
        if any(x.strip() for x in lines):
            left[d] = "\n".join(lines)
    assert {r["doc_id"]: r["text"] for r in after} == left and len(left) < len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["near dedup"]
    assert {r["doc_id"] for r in after} == {d for d, (_, _, keep) in near_by_brute_force(list(before.items())).items() if keep}
    before, after = seen["decontamination"]
    assert {r["doc_id"] for r in after} == {d for d, t in before.items() if item.lower() not in decontaminate.normalize(t)}
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after} == set(before)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "ids_crc32").collect())) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in after)


def test_guarded_entry(spark, tmp_path):
    """Without this subpackage the entry module still offers the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for name in ("millrace", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "millrace" / "llm")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split()[1] == "False", said.stderr
    assert F is not None
