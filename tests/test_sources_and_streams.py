import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import readers as R
from quillspark.sources import sinks as S
from quillspark.streaming import incremental as I


def test_json_lines(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text(json.dumps({"external_id": "a", "year": 2020, "authors": ["x"], "odd": 1}) + "\n\n[1, 2\n" + json.dumps({"external_id": "b"}) + "\n")
    rows, bad = R.read_json_lines(spark, str(p))
    assert {r["external_id"] for r in rows.collect()} == {"a", "b"} and [r["value"] for r in bad.collect()] == ["[1, 2"]
    with pytest.raises(ValueError):
        R.read_records(spark, str(tmp_path / "r.txt"))


def test_csv_and_cache(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "id int, t string")
    S.write_csv(d, str(tmp_path / "o.csv"), ["id", "t", "none"])
    back = R.read_records(spark, str(tmp_path / "o.csv"), "id int, t string, none string")
    assert {(r["id"], r["t"]) for r in back.collect()} == {(1, 'a "b"\nc'), (2, None)}
    cache = str(tmp_path / "cache")
    S.append_missing(cache, d, ["id"], lambda x: x)
    assert S.append_missing(cache, d.unionByName(d.selectExpr("id + 10 AS id", "t")), ["id"], lambda x: x).count() == 4


def test_manifest(spark, tmp_path):
    S.write_manifest(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), str(tmp_path), "my set/1", 2, 0, [], ["w"])
    m = S.latest_manifest(spark, str(tmp_path)).first()
    assert m["rows"] == 2 and m["filled"] == {"a": 2, "b": 1} and m["warnings"] == ["w"] and S.safe_name("my set/1") == "my-set-1"


def test_works(spark):
    w = [("https://openalex.org/w1", "https://doi.org/10.1/A", "T", 2020, 3, {"b": [1], "a": [0, 2]}, [], ["https://openalex.org/W9"])]
    d = spark.createDataFrame(w, "id string, doi string, title string, publication_year int, cited_by_count int, abstract_inverted_index map<string, array<int>>, topics array<struct<display_name: string>>, referenced_works array<string>")
    d = d.withColumns({"authorships": F.from_json(F.lit('[{"author": {"display_name": "N"}}]'), "array<struct<author: struct<display_name: string>>>"), "keywords": F.lit(None).cast("array<struct<display_name: string>>")})
    r = R.works_to_records(d).first()
    assert r["external_id"] == "openalex:W1" and r["doi"] == "10.1/a" and r["abstract"] == "a b a" and r["references"] == ["openalex:W9"] and r["authors"] == ["N"]


def test_harvest_xml(spark, tmp_path):
    rec = "<record><header><identifier>i</identifier></header><metadata><arXiv><id>1</id><created>2019-02-03</created><authors><author><keyname>K</keyname><forenames>F</forenames></author></authors><title>A\n B</title><categories>x y</categories><abstract> z </abstract></arXiv></metadata></record>"
    gone = '<record><header status="deleted"><identifier>j</identifier></header></record>'
    (tmp_path / "h.xml").write_text(f"<ListRecords>{rec}{gone}</ListRecords>")
    rows = R.read_harvest_xml(spark, str(tmp_path / "h.xml")).collect()
    assert len(rows) == 1 and rows[0]["title"] == "A B" and rows[0]["authors"] == ["F K"] and rows[0]["year"] == 2019 and rows[0]["categories"] == ["x", "y"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 5, "save", "2024-01-01 00:10:00"), (1, 6, "save", "2024-01-01 02:00:00"), (2, 1, "too_hard", "2024-01-01 00:20:00")], "user int, item int, action string, ts string").selectExpr("user", "item", "action", "timestamp(ts) AS ts").coalesce(1).write.parquet(src)
    schema = "user int, item int, action string, ts timestamp"
    q = I.profile_stream(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("profiles").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["user"], r["list"], tuple(r["items"])) for r in spark.table("profiles").collect()} == {(1, "saved", (5, 6)), (2, "too_hard", (1,))}
    u = I.upsert_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), ["user"], ["ts"], str(tmp_path / "ck"))
    u.awaitTermination(60)
    assert {(r["user"], r["item"]) for r in I.current(spark, str(tmp_path / "out")).collect()} == {(1, 6), (2, 1)}
    for day, item in (("02", 7), ("03", 8)):  # only the shard of user 1 is written anew, and old versions go
        spark.createDataFrame([(1, item, "save", f"2024-01-{day} 00:00:00")], "user int, item int, action string, ts string").selectExpr("user", "item", "action", "timestamp(ts) AS ts").coalesce(1).write.mode("append").parquet(src)
        I.upsert_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), ["user"], ["ts"], str(tmp_path / "ck")).awaitTermination(60)
    assert {(r["user"], r["item"]) for r in I.current(spark, str(tmp_path / "out")).collect()} == {(1, 8), (2, 1)}
    assert sum(p.is_dir() for p in (tmp_path / "out").glob("_shard=*/v=*")) == 3
    static = spark.read.parquet(src).where("ts < timestamp '2024-01-02 00:00:00'")
    assert I.windowed_counts(static).count() == 3 and I.session_counts(static).count() == 3
    assert I.newer_than(static, "ts", "2024-01-01 00:15:00").count() == 2 and I.newer_than(static, "ts", None).count() == 3
