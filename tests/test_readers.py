"""Good, damaged, empty and mistyped files; whole vintages by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.operators.contract import Rule
from tideline.sources import readers


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


SCHEMA = "id long, name string, value double, at timestamp"


def test_json_lines(spark, tmp_path):
    src = put(tmp_path / "j", "a.json", '{"id": 1, "name": "x", "value": 1.5, "at": "2024-01-05T21:00:00Z", "more": 1}\n\n{"id": 2, "value": "wide"}\n{"id": "3"\n{"id": 4.5}\n{"name": "no id"}\n{"id": 5}\n')
    put(tmp_path / "j", "empty.json", "")
    good, bad = readers.read_json(spark, src, SCHEMA, required=["id"])
    assert sorted((r.id, r.value) for r in good.collect()) == [(1, 1.5), (5, None)]
    assert sorted(r.reason for r in bad.collect()) == ["malformed or mistyped"] * 3 + ["required field missing"]
    assert {r.record for r in bad.collect()} >= {'{"id": "3"', '{"id": 4.5}', '{"id": 2, "value": "wide"}'}
    assert all(r.file.endswith("a.json") for r in bad.collect())
    with pytest.raises(ValueError, match="tinyint"):
        readers.read_json(spark, src, "id tinyint")
    assert sorted(r.id for r in good.select("id").collect()) == [1, 5]  # fields that are left out are judged too
    assert good.filter("id = 1").select(F.unix_seconds("at")).first()[0] == int(dt.datetime(2024, 1, 5, 21, tzinfo=dt.UTC).timestamp())


def test_csv_files(spark, tmp_path):
    src = put(tmp_path / "c", "a.csv", 'id,name,value,at\n1,"a, ""b""\nc",2.5,2024-01-05T16:00:00-05:00\n2,x,oops,\n3,y,1.0,2024-01-05T21:00:00Z,extra\n4,,,\n')
    put(tmp_path / "c", "b.csv", "name,id,value,at\nz,9,1.0,\n")
    put(tmp_path / "c", "empty.csv", "id,name,value,at\n")
    good, bad = readers.read_csv(spark, src, SCHEMA, required=["id"])
    rows = {r.id: r for r in good.collect()}
    assert sorted(r.id for r in good.select("id").collect()) == [1, 4] and good.select("id").count() == 2
    assert sorted(rows) == [1, 4] and rows[1].name == 'a, "b"\nc' and rows[4].value is None
    assert good.filter("id = 1").select(F.unix_seconds("at")).first()[0] == int(dt.datetime(2024, 1, 5, 21, tzinfo=dt.UTC).timestamp())
    assert sorted((r.file[-5:], r.reason) for r in bad.collect()) == [("a.csv", "malformed or mistyped")] * 2 + [("b.csv", "header differs")]


def test_config(spark, tmp_path):
    schema = "model struct<horizon_weeks:int,transition_horizons_weeks:array<int>,state_order:array<string>>, symbols array<string>, cap int"
    rules = lambda: [
        Rule("horizon", F.col("model.horizon_weeks") == 1),
        Rule("horizons", F.col("model.transition_horizons_weeks") == F.array(*map(F.lit, (1, 4, 13)))),
        Rule("cap", F.size("symbols") <= F.col("cap")),
    ]
    text = '{\n "model": {"horizon_weeks": 1, "transition_horizons_weeks": [1, 4, 13]},\n "symbols": ["A"], "cap": 1\n}'
    assert readers.read_config(spark, put(tmp_path / "ok", "c.json", text), schema, rules()).first()["cap"] == 1
    with pytest.raises(ValueError, match="horizons, cap"):
        readers.read_config(spark, put(tmp_path / "bad", "c.json", text.replace("4, 13", "13").replace('"cap": 1', '"cap": 0')), schema, rules())
    for k, broken in enumerate((text[:-3], text.replace("1]", '"x"]').replace('"cap": 1', '"cap": "x"'), "")):
        with pytest.raises(ValueError):
            readers.read_config(spark, put(tmp_path / f"x{k}", "c.json", broken), schema, rules())


def test_whole_vintages(spark):
    day = lambda m, d=1: dt.date(2024, m, d)
    cell = lambda *v: {f"GDP_2024{m:02d}01": x for m, x in zip((5, 6, 7, 8), v, strict=True)}
    rows = [
        ("GDP", day(1), cell("1.0", "1.0", "1.5", "1.5")),  # carried forward, revised, carried forward
        ("GDP", day(2), cell(".", "2", "", "2")),  # published late, withdrawn, back again
        ("GDP", day(3), cell(".", ".", ".", ".")),  # never published
        ("GDP", day(4), {"GDP_20240501": "4", "GDP_20240601": "x", "GDP_20240701": "NaN", "OTHER_20240801": "5"}),
        ("NONE", day(1), {}),
    ]
    wide = spark.createDataFrame(rows, "series_id string, period date, cells map<string,string>")
    vintages = [f"2024-{m:02d}-01" for m in (5, 6, 7, 8)]
    good, bad = readers.full_vintages(wide, vintages)
    got = sorted((r.observed_period_end.month, r.revision_seq, r.vintage_date.month, r.value) for r in good.collect())
    assert got == [(1, 0, 5, 1.0), (1, 1, 7, 1.5), (2, 0, 6, 2.0), (2, 1, 7, None), (2, 2, 8, 2.0), (4, 0, 5, 4.0)]
    assert sorted((r.series_id, r.period.month, r.vintage_date.month, r.reason) for r in bad.collect()) == [
        ("GDP", 4, 6, "mistyped"), ("GDP", 4, 7, "mistyped"), ("GDP", 4, 8, "absent"), *[("NONE", 1, m, "absent") for m in (5, 6, 7, 8)],
    ]
    quarter = lambda m: sorted((r.observed_period_end.month, r.vintage_date.month, r.value) for r in readers.full_vintages(wide.filter("period < DATE'2024-04-01' AND series_id = 'GDP'"), vintages, frequency="quarter", method=m)[0].collect())
    assert quarter("sum") == [(1, 5, 1.0), (1, 6, 3.0), (1, 7, 1.5), (1, 8, 3.5)]
    assert quarter("avg") == [(1, 5, 1.0), (1, 6, 1.5), (1, 8, 1.75)]  # 1.5 in July too
    assert quarter("eop") == [(1, 5, 1.0), (1, 6, 2.0), (1, 7, 1.5), (1, 8, 2.0)]
    assert [f.count() for f in readers.full_vintages(wide.limit(0), vintages)] == [0, 0]
