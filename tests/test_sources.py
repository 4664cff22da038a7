"""Readers, sinks and streams on tiny files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quillon.sources import readers, sinks
from quillon.streaming import streams


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_load_and_save(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, float("nan"))], "a long, b double")
    for kind in ("parquet", "csv", "json", "tsv"):
        sinks.save(df, str(tmp_path / f"t.{kind}"))
        assert readers.load(spark, str(tmp_path / f"t.{kind}"), "a long, b double").filter("b is null").count() == 1
    for bad in ("h5", "zarr"):
        with pytest.raises(ValueError, match="supported"):
            readers.load(spark, f"x.{bad}")
    with pytest.raises(ValueError, match="supported"):
        sinks.save(df, "x.xyz")


def test_formats(spark, tmp_path):
    v = put(tmp_path / "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n1\t10\trs1\tA\tG\t.\t.\t.\tGT:DP\t0/1:3\t./.:0\n")
    assert rows(readers.vcf(spark, v).select("sample", F.coalesce("dosage", F.lit(-1)))) == [("S1", 1), ("S2", -1)]
    assert rows(readers.gene_sets(spark, put(tmp_path / "s.gmt", "P1\td\tA\tB\nP2\td\tC\n")).select("set_id", "gene")) == [("P1", "A"), ("P1", "B"), ("P2", "C")]
    o = readers.ontology_terms(spark, put(tmp_path / "o.obo", 'format: 1\n\n[Term]\nid: X:1\nname: one\nsynonym: "uno" EXACT []\nis_a: X:0 ! root\n\n[Typedef]\nid: r\n'))
    assert rows(o) == [("X:1", "one", ["uno"], ["X:0"])]
    assert rows(readers.wide_fields(spark, put(tmp_path / "u.csv", "eid,31-0.0,41270-0.1\n7,1,F90\n8,0,\n"), "eid").select("eid", "field", "value")) == [("7", 31, "1"), ("7", 41270, "F90"), ("8", 31, "0")]
    assert readers.described_table(spark, put(tmp_path / "d.txt", "key\tv\nThe subject id\tvalue\nS1\t3\n"), "key").count() == 1
    assert rows(readers.comment_table(spark, put(tmp_path / "r.rdb", "# c\nsite\tv\n5s\t3n\n01\t9\n"), "#", widths_line=True)) == [("01", "9")]
    m = readers.series_matrix(spark, put(tmp_path / "m.txt", '!a\n"ID_REF"\t"G1"\t"G2"\n"p1"\t1.5\t2\n!end\n'))
    assert rows(m) == [("p1", "G1", 1.5), ("p1", "G2", 2.0)]
    assert rows(readers.rr_intervals(spark, put(tmp_path / "p.txt", "RR\n800\n810 x\nend\n"))) == [(800.0,), (810.0,)]
    assert rows(readers.scored_links(spark, put(tmp_path / "l.txt", "a b s\nx y 900\nx z 100\n"), 0.4)) == [("x", "y", 0.9)]
    assert rows(readers.actigraphy(spark, put(tmp_path / "g.csv", "Timestamp,Counts\n2024-01-01 00:00:00,5\n")).select("activity")) == [(5.0,)]
    x = readers.xml_records(spark, put(tmp_path / "x.xml", "<r><p><id>1</id></p><p><id>2</id></p></r>"), "p", "id INT")
    assert rows(x) == [(1,), (2,)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b")], "n int, s string")
    for kind in ("md", "json", "html"):
        sinks.write_report(df, str(tmp_path / f"r.{kind}"), "T")
        assert "T" in (tmp_path / f"r.{kind}").read_text()
    assert "a&lt;b" in (tmp_path / "r.html").read_text()


def drain(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return rows(spark.table(name))


def test_streams(spark, tmp_path):
    data = [("a", "x", "2024-01-01 00:00:00", 1), ("a", "x", "2024-01-01 00:10:00", 2), ("a", "y", "2024-01-01 00:20:00", 3), ("b", "x", "2024-01-01 03:00:00", 1)]
    spark.createDataFrame(data, "k string, c string, t string, p int").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema("k string, c string, t timestamp, p int").parquet(str(tmp_path / "in"))
    assert [r[0] for r in drain(spark, streams.changes(src(), "k", "c", "t"), "ch")] == ["a", "a", "b"]
    assert len(drain(spark, streams.first_seen(src(), ["k"], "t", "1 day"), "fs")) == 2
    assert sum(r[-1] for r in drain(spark, streams.sessions(src(), ["k"], "t", "30 minutes", "1 hour"), "se", "complete")) == 4
    assert drain(spark, streams.sliding(src(), ["k"], "t", "p", "1 hour", "1 hour", "1 hour"), "sl", "complete")
    assert drain(spark, streams.digest(src(), "t", "p", 2, "1 hour"), "di", "complete")


def test_filters_on_floats_reach_the_scan(spark, tmp_path, capsys):
    import math

    from quillon import registry
    from quillon.sources.tables import table

    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        for name, pushed in (("P7_significant_top", "LessThan(l_discount,0.02)"), ("J24_or_predicate", "GreaterThanOrEqual(l_quantity,50.0)"), ("Q3_dynamic_conjunction", "GreaterThanOrEqual(c_acctbal,1000.0)")):
            registry.QUERIES[name](spark, sf).explain("formatted")
            plan = capsys.readouterr().out
            assert any(pushed in line.split("PushedFilters:")[1] for line in plan.splitlines() if "PushedFilters:" in line), plan
    rows = [(1, 5.0), (2, math.nan), (3, None), (4, -1.0)]
    spark.createDataFrame(rows, "id int, v double").write.parquet(f"{tmp_path}/t.parquet")
    ids = lambda where: sorted(r["id"] for r in table(spark, str(tmp_path), "t", where).collect())
    assert ids("v > 0") == [1] and ids("v < 9") == [1, 4] and ids("v <> 5") == [4] and ids("id > 1") == [2, 3, 4] and ids(None) == [1, 2, 3, 4]
