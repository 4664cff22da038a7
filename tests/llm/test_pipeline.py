"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

import collections
import os
import subprocess
import sys

import pytest

pytest.importorskip("tokenizers")
import corpus_pipeline
from tests.llm.test_operators import near_components, sha, words

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, docs, rows, tmp_path):
    import re

    documents = docs.select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append((name, before, now.collect()))
    by = {n: (a, b) for n, a, b in seen}
    for n in list(by)[:-1]:
        assert by[n][1] and list(by[n][1][0].asDict()) == documents.columns
    assert all(len(words(r["text"])) >= 50 for r in by["quality_rules"][1])
    a, b = by["exact_dedup"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in a:
        k = sha(norm(r["text"]))
        least[k] = min(least.get(k, 1 << 60), 1 << 60 if r["doc_id"] is None else r["doc_id"])
    assert sorted(r["doc_id"] for r in b) == sorted(least.values())
    a, b = by["near_dedup"]
    assert {r["doc_id"] for r in b} == set(near_components([(r["doc_id"], r["text"]) for r in a]).values())
    a, b = by["source_mixing"]
    times = collections.Counter(r["doc_id"] for r in b)
    assert set(times) == {r["doc_id"] for r in a} and max(times.values()) <= 2
    a, b = by["packing"]
    assert collections.Counter(r["doc_id"] for r in b if r["start"] == 0) == collections.Counter(r["doc_id"] for r in a)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rs: collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert sum(r["length"] for r in final) == sum(r["length"] for r in b) and set(key(final)) and {r["doc_id"] for r in final} == {r["doc_id"] for r in b}


def test_rest_works_without_this_package(tmp_path):
    code = "import sys; sys.modules['quillon.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
