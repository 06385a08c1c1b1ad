import json

import pytest
from pyspark.sql import functions as F

from glyphmill.sources import documents as D
from glyphmill.streaming import features as S


def test_formats_ids_and_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,n\n"one, two",1\n"three ""q""",2\n')
    (tmp_path / "b.json").write_text(json.dumps([{"generation": "x", "id": 7}, {"generation": "y", "id": 8}]))
    (tmp_path / "c.txt").write_text(" first \n\nsecond\n")
    csv = D.read_documents(spark, f"'{tmp_path / 'a.csv'}'").orderBy("id").collect()
    assert [(r["id"], r["text"]) for r in csv] == [("doc_00000", "one, two"), ("doc_00001", 'three "q"')]
    assert {r["id"] for r in D.read_documents(spark, str(tmp_path / "b.json")).collect()} == {"7", "8"}
    assert [r["text"] for r in D.read_documents(spark, str(tmp_path / "c.txt")).orderBy("id").collect()] == ["first", "second"]
    with pytest.raises(ValueError, match="unsupported"):
        D.read_documents(spark, "x.doc")
    with pytest.raises(ValueError, match="no text column"):
        D.text_column(spark.range(1))
    with pytest.raises(ValueError, match="missing columns: is_ai"):
        D.require(spark.range(1), "id", "is_ai")


def test_annotation_sources(spark, tmp_path):
    (tmp_path / "d.tml").write_text('<TimeML><TEXT>It <EVENT eid="e1">rained</EVENT></TEXT><MAKEINSTANCE eventID="e1" eiid="ei1" tense="PAST" aspect="NONE"/><MAKEINSTANCE eventID="e2" eiid="ei2" tense="PRESENT" aspect="NONE"/></TimeML>')
    assert {(r["eiid"], r["tense"]) for r in D.read_time_annotations(spark, str(tmp_path / "d.tml")).collect()} == {("ei1", "PAST"), ("ei2", "PRESENT")}
    (tmp_path / "r.tsv").write_text("AB-1.x\tran\tsaw\t1\t2\tBEFORE\nAB-1.x\tran\tsaw\t1\t3\tVAGUE\n")
    rows = D.read_relation_rows(spark, str(tmp_path / "r.tsv")).collect()
    assert len(rows) == 1 and rows[0]["doc_key"] == "ab1x"


def test_sinks_and_resume(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    f = spark.createDataFrame([("a", 1)], "id string, n int")
    D.write_merged(docs, f, str(tmp_path / "out"))
    assert {r["id"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": 1, "b": None}
    assert [r["id"] for r in D.pending(docs, f).collect()] == ["b"]


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "This is a plain sentence of several words."), (2, None)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        S.write_stream(S.row_features(S.document_stream(spark, str(tmp_path / "in"), "doc_id bigint, text string")), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert S.event_counts(events).agg(F.sum("n")).first()[0] == events.count()
    assert S.session_counts(events).count() > 0
