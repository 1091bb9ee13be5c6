"""Readers of files that the supplied tables don't have."""

import datetime as dt

from marketloom.sources import readers


def test_bars_csv(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("Date,open,high,low,close,n_bars\n2024-01-02,1.0,2.5,0.5,2.0,7\n2024-01-03 05:30:00,2.0,3.0,1.0,,8\n")
    rows = readers.bars_csv(spark, f"file://{tmp_path}/bars.csv").orderBy("Date").collect()
    assert [r.Date for r in rows] == [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3, 5, 30)]
    assert (rows[0].high, rows[0].n_bars, rows[1].close) == (2.5, 7, None)


def test_text_corpus(spark, tmp_path):
    for name, text in {"a": "x" * 501, "b": " " * 300 + "y" * 400 + "\n" * 300, "c": "  " + "z\n" * 400}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    rows = {r.name: r.text for r in readers.text_corpus(spark, f"file://{tmp_path}/*.txt").collect()}
    assert rows == {"a": "x" * 501, "c": ("z\n" * 400).strip()}  # space at the ends doesn't count


def test_live_quotes_of_broken_lines(spark):
    lines = ["EUR/USD,1700000000123,1.08,512,1.08,530,1.0,1.1,1.05", "EUR/USD,1700000000123,1.08,512", "", "X,now,1.0,1,1.0,2,0,0,0", "Y,1,1.0,a,1.0,2,0,0,0"]
    rows = readers.live_quotes(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(rows) == 1 and rows[0].pair == "EUR/USD" and abs(rows[0].mid - 1.08521) < 1e-9


def test_chart_rows(spark):
    json = '{"chart":{"result":[{"timestamp":[60,120,180],"indicators":{"quote":[{"open":[1,null,3],"high":[2,2,4],"low":[0.5,1,2],"close":[1.5,2,3.5]}]}}]}}'
    rows = readers.chart_rows(spark.createDataFrame([(json,), ('{"chart":{"result":[]}}',), ("broken",), (None,)], "json string")).collect()
    assert [(r.open, r.close) for r in rows] == [(1.0, 1.5), (3.0, 3.5)]
