"""Per-word totals with a word that holds most lines."""

from collections import defaultdict

from wordloom.operators.dedupe import latest_count, latest_row
from wordloom.operators.skew import heavy_keys, word_line_totals
from wordloom.operators.spool import spool_cells

SCHEMA = "corpus_id bigint, run_no bigint, w_idx bigint, c_idx bigint, cooc bigint, sampled bigint, extra string"


def brute(rows):
    lines, out = {}, defaultdict(lambda: [0, 0, set()])
    for c, r, w, x, n, *_ in rows:
        if w is None:
            continue
        out[w][0] += 1
        key = (c, r, w, x)
        lines[key] = max((v for v in (lines.get(key), n) if v is not None), default=None)
    for (_, _, w, x), n in lines.items():
        if x is not None and n:
            out[w][1] += n
            out[w][2].add(x)
    return {w: (n, s, len(x)) for w, (n, s, x) in out.items()}


def rows():
    out = [(1, i % 7, 0, i % 50 if i % 9 else None, i % 4, 1, "x") for i in range(3000)]
    out += [(1 + i % 2, 1, 1 + i % 40, i % 13, 1 + i % 3, 1, "y") for i in range(1500)]
    return out + out[:200] + [(1, 1, None, 3, 1, 1, "z"), (None, None, 5, None, None, None, None)]


def test_totals(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for share in (None, 0.005, 0.4, 0.99):
        got = word_line_totals(df, share)
        assert {r.w_idx: (r.n_rows, r.sum_cooc, r.n_contexts) for r in got.collect()} == brute(rows())


def test_sampled_detection_changes_nothing(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = word_line_totals(df, 0.05, sample_rows=500)
    assert {r.w_idx: (r.n_rows, r.sum_cooc, r.n_contexts) for r in got.collect()} == brute(rows())
    assert [r.w_idx for r in heavy_keys(df, "w_idx", 0.3, 500).collect()] == [0]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert word_line_totals(df).count() == 0 and spool_cells(df).count() == 0


def test_cells(spark):
    df = spark.createDataFrame([(1, 1, 2, 3, 4, 1, ""), (1, 1, 2, 3, 4, 1, ""), (1, 2, 2, 3, 1, 1, ""), (1, 1, 2, None, 9, 1, ""), (1, 1, 2, 4, 0, 1, "")], SCHEMA)
    assert [tuple(r) for r in spool_cells(df).collect()] == [(1, 2, 3, 5)]


def test_latest(spark):
    from datetime import datetime as T

    a, b = T(2024, 1, 1), T(2024, 1, 2)
    big = 2**62
    rows = [("x", 5, b), ("x", 9, a), ("x", 7, b), ("y", 3, None), ("y", 2, a), ("z", None, b), ("z", 0, b), (None, 1, a), ("v", big, a), ("v", -1, b)]
    df = spark.createDataFrame(rows, "k string, n bigint, at timestamp")
    got = {r.k: r.n for r in latest_count(df, ["k"], "n", "at").collect()}
    assert got == {"x": 7, "y": 2, None: 1, "v": big}
    assert {r.k: r.n for r in latest_row(df, ["k"], "at", ["n"]).collect()} == {"x": 7, "y": 2, "z": 0, None: 1, "v": -1}


def test_many_warm_keys(spark):
    """300 keys of 0.3 % each beside one of a tenth: tasks take alike."""
    from pyspark.sql import functions as F

    from wordloom.operators.skew import dealt, heavy_share

    n = 300_000
    word = F.when(F.col("id") % 10 == 0, 0).otherwise(1 + F.col("id") % 300)
    df = spark.range(n).select(
        F.lit(1).cast("bigint").alias("corpus_id"), (F.col("id") % 11).alias("run_no"), word.cast("bigint").alias("w_idx"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 1013).alias("c_idx"), (F.col("id") % 4).alias("cooc"),
    )
    parts = 64
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        heavy = heavy_keys(df, "w_idx", heavy_share(spark))
        spread = dealt(df, "w_idx", heavy, ["c_idx", "run_no"]).repartition(parts, "w_idx", "__part")
        sizes = sorted(r["count"] for r in spread.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sizes[-1] < 2 * sizes[len(sizes) // 2]
        got = {r.w_idx: r.n_rows for r in word_line_totals(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == {r.w_idx: r["count"] for r in df.groupBy("w_idx").count().collect()}
