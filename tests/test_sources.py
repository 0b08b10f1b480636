from datetime import date

from panelwright.sources.panels import read_bars_csv, read_wide_csv, vendor_bars


def test_csv_sources(spark, tmp_path):
    bars = tmp_path / "bars"
    bars.mkdir()
    (bars / "AA.csv").write_text("date,Open,High,Low,Close,Volume\n2020-01-02,1,2,1,2,10\n2020-01-03,1,2,1,,10\n")
    (bars / "BB.csv").write_text("date,Open,High,Low,Close,Volume\n2020-01-02,3,4,3,4,5\n")
    got = {(x.symbol, x.bar_ts, x.close, x.idx) for x in read_bars_csv(spark, str(bars)).collect()}
    assert got == {("AA", date(2020, 1, 2), 2.0, 0), ("BB", date(2020, 1, 2), 4.0, 0)}
    (tmp_path / "wide.csv").write_text("date,AA,BB.X\n2020-01-02,1,2\n2020-01-03,,3\n")
    got = {(x.symbol, x.bar_ts, x.close) for x in read_wide_csv(spark, str(tmp_path / "wide.csv")).collect()}
    assert got == {("AA", date(2020, 1, 2), 1.0), ("BB.X", date(2020, 1, 2), 2.0), ("BB.X", date(2020, 1, 3), 3.0)}


def test_vendor_bars(spark):
    rows = [("A", 1577923200000, 1, 5.0), ("A", 1577923200000, 2, 6.0), ("A", 1578009600000, 1, 7.0)]
    got = {(x.symbol, x.bar_ts, x.close) for x in vendor_bars(spark.createDataFrame(rows, "symbol string, timestamp_ms long, seq int, close double")).collect()}
    assert got == {("A", date(2020, 1, 2), 6.0), ("A", date(2020, 1, 3), 7.0)}
