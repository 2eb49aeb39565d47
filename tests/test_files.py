"""What file readers refuse, skip and append."""

import pytest
from pyspark.sql import functions as F

from lodemark.sources import files, registries


def folder(tmp_path, name):
    return f"{tmp_path}/{name}"


def test_sealed_paths_are_refused(spark, tmp_path):
    for path in (f"{tmp_path}/HOLDOUT/x.csv", f"{tmp_path}/my_holdout_2/y"):
        with pytest.raises(files.SealedPathError):
            files.read_raw_csv(spark, path)
    assert files.allowed(f"{tmp_path}/held/x") == f"{tmp_path}/held/x"


def test_changed_missing_and_new_files_are_refused(spark, tmp_path):
    path = folder(tmp_path, "data")
    spark.range(10).repartition(2).write.parquet(path)
    known = spark.createDataFrame(files.checksums(spark, path).collect(), "name string, sha256 string")
    assert files.verified(spark, path, known) == path
    spark.range(3).write.mode("append").parquet(path)
    with pytest.raises(files.DataError):
        files.verified(spark, path, known)
    with pytest.raises(files.DataError):
        files.verified(spark, path, known.withColumn("sha256", F.sha2("sha256", 256)))


def test_raw_bars_keep_every_line(spark, tmp_path):
    path = folder(tmp_path, "raw")
    lines = ["symbol,ts,open,high,low,close,volume", "a,2024-01-01 00:00:00,1,2,0.5,1.5,10", "a,never,x,,,,", "a,2024-01-01 01:00:00,1"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = sorted(files.read_raw_csv(spark, path).collect(), key=lambda r: r.ts)
    assert [r.open for r in got] == ["1", "1", "x"] and got[1].close is None


def test_invalid_vendor_lines_are_skipped(spark, tmp_path):
    path = folder(tmp_path, "vendor")
    good = "EURUSD,202401010005,1.1,1.2,1.0,1.15,7"
    bad = ["EURUSD,20240101000,1,1,1,1,1", "EURUSD,202413010005,1,1,1,1,1", "EURUSD,202401010005,1,1", "EURUSD,202401010005,1,0.9,0.5,1,1", "EURUSD,202401010005,1,2,1.5,1,1", "EURUSD,202401010005,0,1,0,1,1", "", "EURUSD,202401010005,a,1,1,1,1"]
    spark.createDataFrame([(x,) for x in [good, *bad]], "value string").coalesce(1).write.text(path)
    (row,) = files.read_vendor_minutes(spark, path, 5).collect()
    assert row.ts.isoformat() == "2024-01-01T05:05:00" and row.close == 1.15


def test_calendar_gates(spark, tmp_path):
    head = "timestamp_utc,event_id,event_name,country,currency,impact,actual,forecast,source"
    rows = ["2024-01-05T13:30:00Z,1,NFP,US,usd,high,200,180,x", "2024-02-02T13:30:00Z,2,NFP,US,USD,HIGH,,170,x"]
    cases = {
        "fine": [head, *rows], "twice": [head, rows[0], rows[0]], "untimed": [head, rows[0], rows[1].replace("2024-02-02T13:30:00Z", "soon")],
        "impact": [head, rows[0].replace("high", "huge")], "empty": [head], "columns": [head.replace("impact", "weight"), *rows],
    }
    for name, lines in cases.items():
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder(tmp_path, name))
    got = files.read_calendar(spark, folder(tmp_path, "fine")).orderBy("event_id").collect()
    assert [(r.currency, r.impact, r.surprise) for r in got] == [("USD", "HIGH", 20.0), ("USD", "HIGH", None)]
    assert files.read_calendar(spark, folder(tmp_path, "fine"), "2024-02-01").count() == 1
    for name in set(cases) - {"fine"}:
        with pytest.raises(files.DataError):
            files.read_calendar(spark, folder(tmp_path, name))


def test_append_refuses_changed_records(spark, tmp_path):
    path = folder(tmp_path, "store")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, h string").write.parquet(path)
    assert files.append(spark, path, spark.createDataFrame([(2, "b"), (3, "c")], "id long, h string"), "id", "h") == 1
    with pytest.raises(files.DataError):
        files.append(spark, path, spark.createDataFrame([(4, "d"), (1, "other")], "id long, h string"), "id", "h")
    assert spark.read.parquet(path).count() == 3


def text_files(spark, path, docs):
    spark.createDataFrame([(d,) for d in docs], "document string").transform(lambda d: registries.write_documents(d, path) or d)


def test_documents_in_any_order_have_one_digest(spark, tmp_path):
    """Nested, reordered, spaced, with numbers in other forms; as record, list and envelope."""
    path = folder(tmp_path, "docs")
    text_files(spark, path, ['{"b":1.50,"a":{"z":[1,{"y":null,"x":"é"}],"k":true}}', ' [ {"a":{"k":true,"z":[1.0,{"x":"\\u00e9","y":null}]},\n"b":1.5} ]', '{"v":2,"records":[{"b":15e-1,"a":{"k":true,"z":[1,{"y":null,"x":"é"}]}}]}'])
    rows = registries.read_documents(spark, path).collect()
    assert {r.record for r in rows} == {'{"a":{"k":true,"z":[1,{"x":"é","y":null}]},"b":1.5}'} and len(rows) == 3 and len({r.sha256 for r in rows}) == 1
    assert len({r.file for r in rows}) == 3


def test_lists_of_several_records_and_conflicting_ids(spark, tmp_path):
    path = folder(tmp_path, "docs")
    text_files(spark, path, ['[{"id":1,"x":1},{"x":1,"id":2},{"id":1,"x":1.0}]', '{"records":[{"id":2,"x":2}]}', "[]"])
    got = registries.read_documents(spark, path)
    assert sorted(r.record for r in got.filter("record is not null").collect()) == ['{"id":1,"x":1}', '{"id":1,"x":1}', '{"id":2,"x":1}', '{"id":2,"x":2}']
    assert [tuple(r) for r in registries.conflicts(got.filter("record is not null"), "$.id").collect()] == [("2", 2)]


def test_what_is_no_json_or_was_changed_is_refused(spark, tmp_path):
    for name, doc in (("cut", '[{"a":1}'), ("twice", '{"a":1,"a":2}')):
        text_files(spark, folder(tmp_path, name), [doc])
        with pytest.raises(files.DataError):
            registries.read_documents(spark, folder(tmp_path, name))
    doc = spark.createDataFrame([('{"b":[1,2],"a":"x"}',)], "p string").select(registries.sealed(F.col("p")).alias("document"))
    registries.write_documents(doc, folder(tmp_path, "right"))
    assert [r.payload for r in registries.read_sealed(spark, folder(tmp_path, "right")).collect()] == ['{"a":"x","b":[1,2]}']
    registries.write_documents(doc.select(F.replace("document", F.lit("[1,2]"), F.lit("[1,3]")).alias("document")), folder(tmp_path, "wrong"))
    with pytest.raises(files.DataError):
        registries.read_sealed(spark, folder(tmp_path, "wrong"))


def test_parameters_seen_before_are_left_out(spark):
    made = spark.createDataFrame([(1, '{"a":1,"b":[2.0]}'), (2, '{"b":[2],"a":1.0}'), (3, '{"a":2}'), (4, '{"a":3}')], "k long, json string")
    got = registries.new_parameters(made, made.filter("k = 3"), "json")
    assert sorted(r.k for r in got.collect()) == [1, 4] and got.columns == made.columns


def test_vendor_lines_have_a_reason(spark, tmp_path):
    path = folder(tmp_path, "vendor")
    lines = {"E,202401010005,1.1,1.2,1.0,1.15,7": None, "E,202401010005,1,1": "short", "F,202401010005,1,1,1,1,1": "other_symbol", "E,202413010005,1,1,1,1,1": "unreadable", "E,202401010005,1,x,1,1,1": "unreadable",
             "E,202401010005,0,1,0,1,1": "not_positive", "E,202401010005,1,0.9,0.5,1,1": "inconsistent", "": "short"}
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = sorted(str(r.skipped) for r in files.scan_vendor_minutes(spark, path, "E").collect())
    assert got == sorted(map(str, lines.values()))


def test_assets_are_cleaned(spark, tmp_path):
    schema = "Price string, Open string, High string, Low string, Close string, Volume string"
    rows = [("Ticker", "A", "A", "A", "A", "A"), ("2024-01-01 20:00:00", "1", "2", "0.5", "1.5", "x"), ("2024-01-01 20:00:00", "3", "4", "2", "3", "9"), ("2023-12-31 19:00:00", "1", "1", "1", "1", "1")]
    for name in ("gold", "oil"):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder(tmp_path, name))
    got = files.read_assets(spark, [folder(tmp_path, "gold"), folder(tmp_path, "oil")]).filter("symbol = 'gold'").orderBy("ts").collect()
    assert [(r.ts.isoformat(), r.open, r.volume) for r in got] == [("2024-01-01T00:00:00", 1.0, 1.0), ("2024-01-02T01:00:00", 3.0, 9.0)]
    with pytest.raises(files.DataError):
        files.read_assets(spark, [folder(tmp_path, "gold"), f"{tmp_path}/other/gold"])


def test_sealed_folders_behind_escapes_and_dots(tmp_path):
    for path in ("/a/HoldOut/b", "/a/%68oldout/b", "file:///a/x/../my_holdout/b", "s3://b/holdout"):
        with pytest.raises(files.SealedPathError):
            files.allowed(path)
    assert files.allowed("/a/holdout/../x") == "/a/holdout/../x"
