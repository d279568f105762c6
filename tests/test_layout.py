"""Clustered files: filters on either column skip most of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorpool.sources import layout
from tests.conftest import rows


def stored(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_both_columns_skip_files(spark, tmp_path):
    df = spark.range(60_000).selectExpr(
        "id", "cast(pmod(hash(id, 1), 5000) as int) as site", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, pmod(hash(id, 2), 1000000)) as ts"
    )
    back = stored(layout.clustered(df, ["site", "ts"], 64), str(tmp_path / "z"))
    assert rows(back.agg(F.count("*"), F.sum("id"))) == [(60_000, 60_000 * 59_999 // 2)]
    spans = back.groupBy(F.col("_metadata.file_path")).agg(F.min("site"), F.max("site"), F.min("ts"), F.max("ts"), F.count("*")).collect()
    assert len(spans) > 40 and max(s[5] for s in spans) < 4 * 60_000 / len(spans)
    for low, high in ((0, 600), (2200, 2700)):
        assert sum(s[1] <= high and s[2] >= low for s in spans) < len(spans) / 2
    begin, end = spans[0][3], None
    begin, end = (back.selectExpr(f"percentile_approx(ts, {p})").first()[0] for p in (0.45, 0.55))
    touched = [s for s in spans if s[1] <= 2700 and s[2] >= 2200 and s[3] <= end and s[4] >= begin]
    assert 0 < len(touched) < len(spans) / 4


def test_nulls_texts_and_frequent_values(spark, tmp_path):
    df = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then cast(id as string) end as k", "cast(null as int) as n", "id % 2 = 0 as b")
    back = stored(layout.clustered(df, ["k", "n", "b"], 8), str(tmp_path / "z"))
    assert back.count() == 4000 and back.columns == df.columns
    sizes = [r[1] for r in back.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert max(sizes) < 4000 / 3
    assert layout.clustered(df.limit(0), ["k"], 4).count() == 0


def test_order_takes_bits_in_turn(spark):
    df = spark.range(16).selectExpr("id % 4 as x", "floor(id / 4) as y")
    got = {(r.x, r.y): r.z for r in df.withColumn("z", layout.z_order(df, ["x", "y"], 2)).collect()}
    want = {(x, y): sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(2)) for x in range(4) for y in range(4)}
    assert got == want
