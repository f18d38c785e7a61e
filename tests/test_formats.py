"""Round trips of the interchange formats, and embedding from a model file."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import vectors
from wordloom.params import Params
from wordloom.sources import formats
from wordloom.streaming.embed import embed_stream, fnv1_32_bytes, word_grams


def test_counts(spark, tmp_path):
    rows = spark.createDataFrame([("</s>", 3, 0), ("the", 3, 1), ("x.y", 1, 2), ("ü", 1, 3)], "w string, freq bigint, idx bigint")
    formats.write_counts(rows, str(tmp_path / "v"), "w", "freq", [F.col("idx")])
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines == ["</s> 3", "the 3", "x.y 1", "ü 1"]
    back = formats.read_counts(spark, str(tmp_path / "v"))
    assert sorted((r.w, r.freq) for r in back.collect()) == sorted((r.w, r.freq) for r in rows.collect())


def test_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", [1.0, -0.5]), (1, "b", [1 / 3, 2e-7])], "idx bigint, w string, v array<double>")
    formats.write_vectors(rows, str(tmp_path / "v"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines == ["2 2", "a 1.000000 -0.500000", "b 0.333333 0.000000"]
    assert {r.w: r.v for r in formats.read_vectors(spark, str(tmp_path / "v")).collect()} == {"a": [1.0, -0.5], "b": [0.333333, 0.0]}


def test_spool(spark, tmp_path):
    rows = [(0, 1, 2), (4294967295, 7, 9), (5, 5, 5)]
    cells = spark.createDataFrame(rows, "w_idx bigint, c_idx bigint, cooc bigint")
    formats.write_spool(cells, str(tmp_path / "s"))
    assert sum(len(r.content) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == 36
    assert sorted(tuple(r) for r in formats.read_spool(spark, str(tmp_path / "s")).collect()) == sorted(rows)


def test_bare_records(spark, tmp_path):
    rows = [(k, 2 * k, 3, k % 5) for k in range(1000)]
    for width in (3, 4):
        path = tmp_path / f"w{width}"
        path.mkdir()
        for part in (0, 1):
            (path / f"{part}.bin").write_bytes(np.array([r[:width] for r in rows[part::2]], "<u4").tobytes())
        assert sorted(tuple(r) for r in formats.read_records(spark, str(path), width).collect()) == sorted(r[:width] for r in rows)


def test_merge_where_a_word_is_the_number_of_the_header(spark, tmp_path):
    rows = spark.createDataFrame([(0, "2", [1.0, 2.0]), (1, "b", [3.0, 4.0])], "idx bigint, w string, v array<double>")
    formats.write_vectors(rows, str(tmp_path / "w"))
    formats.write_vectors(rows.withColumnRenamed("w", "c"), str(tmp_path / "c"), "c")
    assert formats.merge_vector_files(spark, str(tmp_path / "w"), str(tmp_path / "c"), str(tmp_path / "out")) == 0
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ["2 2", "2 2.000000 4.000000", "b 6.000000 8.000000"]


def model():
    rng = np.random.default_rng(0)
    return formats.BinaryModel(["cat", "ü"], rng.normal(size=(12, 3)), 3, 6)


def test_model(tmp_path):
    path = str(tmp_path / "m.bin")
    formats.write_model(path, model())
    back = formats.read_model(path)
    assert back.words == ["cat", "ü"] and (back.minn, back.maxn, back.buckets) == (3, 6, 10)
    assert np.array_equal(back.matrix, model().matrix)
    data = bytearray(open(path, "rb").read())
    for spoiled in (struct.pack("<I", 1) + bytes(data[4:]), bytes(data[:4]) + struct.pack("<I", 2) + bytes(data[8:]), b"x"):
        (tmp_path / "bad").write_bytes(spoiled)
        with pytest.raises(ValueError):
            formats.read_model(str(tmp_path / "bad"))


def test_embedding_agrees(spark, tmp_path):
    path, m = str(tmp_path / "m.bin"), model()
    formats.write_model(path, m)
    words = spark.createDataFrame([("cat",), ("unseen",), ("a",), (None,)], "w string")
    known = spark.createDataFrame([("cat", 0), ("ü", 1)], "w string, idx bigint")
    matrix = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m.matrix)], "row bigint, v array<double>")
    p = Params(buckets=10)
    got = {r.w: np.array(r.v) for r in vectors.embedded(words, known, matrix, 2, 3, p).collect()}
    lines = spark.createDataFrame([("cat",), ("unseen",), ("",), ("a",), (None,)], "value string")
    streamed = {r.w: np.array(r.v) for r in embed_stream(lines, path).collect()}
    assert set(got) == set(streamed) == {"cat", "unseen", "a"}
    for w in got:
        assert got[w] == pytest.approx(streamed[w])
    assert not got["a"].any()
    rows = [0] + [2 + fnv1_32_bytes(g) % 10 for g in word_grams("cat", 3, 6)]
    assert got["cat"] == pytest.approx(m.matrix[rows].mean(0))


def test_listed_subwords_override(spark, tmp_path):
    path, m = str(tmp_path / "m.bin"), model()
    formats.write_model(path, m)
    known = spark.createDataFrame([("cat", 0)], "w string, idx bigint")
    matrix = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m.matrix)], "row bigint, v array<double>")
    words = spark.createDataFrame([("cat", ["ab", "cd"]), ("dog", None)], "w string, subwords array<string>")
    got = {r.w: np.array(r.v) for r in vectors.embedded(words, known, matrix, 2, 3, Params(buckets=10)).collect()}
    lines = spark.createDataFrame([("cat ab cd",), ("dog",)], "value string")
    for r in embed_stream(lines, path).collect():
        assert got[r.w] == pytest.approx(np.array(r.v))


def test_characters_and_blank_lines(spark, tmp_path):
    from wordloom.streaming.embed import before_blank

    assert word_grams("ü", 2, 2) == ["<ü>".encode()[k : k + 2] for k in range(3)]
    assert word_grams("ü", 2, 2, "char") == ["<ü".encode(), "ü>".encode()]
    path, m = str(tmp_path / "m.bin"), model()
    formats.write_model(path, m)
    (tmp_path / "in.txt").write_text("zü\ncat\n\ndog\n")
    lines = spark.read.text(str(tmp_path / "in.txt"))
    got = {r.w: np.array(r.v) for r in embed_stream(before_blank(lines), path, "char").collect()}
    assert set(got) == {"zü", "cat"}
    rows = [2 + fnv1_32_bytes(g) % 10 for g in word_grams("zü", 3, 6, "char")]
    assert got["zü"] == pytest.approx(m.matrix[rows].mean(0))
    assert before_blank(lines.where("value = 'cat'")).count() == 1


def test_stream(spark, tmp_path):
    path = str(tmp_path / "m.bin")
    formats.write_model(path, model())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("cat\n\nunseen\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    q = embed_stream(stream, path).writeStream.format("memory").queryName("embedded").start()
    q.processAllAvailable()
    q.stop()
    assert {r.w for r in spark.sql("select w from embedded").collect()} == {"cat", "unseen"}
