"""The stages from the command line, over files."""

import pytest

from wordloom.__main__ import parser, run
from wordloom.sources.formats import read_counts, read_vectors

SMALL = "--minfreq 1 --window 2 --subsample 0 --dim 4 --iterations 2 --minn 0 --negative 1 --alpha 0.1".split()


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    path = tmp_path_factory.mktemp("cli") / "corpus.txt"
    path.write_text("the cat sat. the dog sat .\nthe cat ran\n" * 5)
    return str(path)


def cli(spark, *args):
    run(spark, parser().parse_args([*args, *SMALL]))


def test_stages(spark, corpus, tmp_path):
    d = str(tmp_path)
    cli(spark, "vocab", "--corpus", corpus, "--vocab", f"{d}/v")
    vocab = {r.w: r.freq for r in read_counts(spark, f"{d}/v").collect()}
    assert vocab == {"</s>": 15, "the": 15, "cat": 10, "sat.": 5, "sat": 5, "dog": 5, "ran": 5}
    assert len(read_counts(spark, f"{d}/v.context").collect()) == 28
    cli(spark, "train", "--corpus", corpus, "--vocab", f"{d}/v", "--output", f"{d}/im", "--model", "0")
    cli(spark, "cooc", "--corpus", corpus, "--vocab", f"{d}/v", "--cooc", f"{d}/s")
    totals = {r.w: r.freq for r in read_counts(spark, f"{d}/s/rows").collect()}
    assert totals == {"cat": 25, "dog": 15, "ran": 10, "sat": 10, "sat.": 20, "the": 40}
    cli(spark, "trainem", "--vocab", f"{d}/v", "--cooc", f"{d}/s", "--output", f"{d}/em", "--binary", f"{d}/m.bin")
    for out in ("im", "em"):
        assert {r.w for r in read_vectors(spark, f"{d}/{out}/vectors.txt").collect()} == set(vocab)
    cli(spark, "merge", "--vectors", f"{d}/im/vectors.txt", "--contexts", f"{d}/im/vectors.txt.context", "--output", f"{d}/merged")
    plain, merged = ({r.w: r.v for r in read_vectors(spark, f"{d}/{x}").collect()} for x in ("im/vectors.txt", "merged"))
    assert merged.keys() == plain.keys() and merged["cat"] != plain["cat"]
    (tmp_path / "ask.txt").write_text("cat\nunknown\n")
    cli(spark, "embed", "--model-file", f"{d}/m.bin", "--words", f"{d}/ask.txt", "--output", f"{d}/found")
    lines = sorted(r.value for r in spark.read.text(f"{d}/found").collect())
    assert lines[0].startswith("cat ") and lines[1] == "unknown" + " 0.000000" * 4


def test_demo(spark, corpus, tmp_path, capsys):
    cli(spark, "demo", "--corpus", corpus, "--output", str(tmp_path / "o"))
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert {x[0] for x in lines} == {"the", "cat", "sat.", "sat", "dog", "ran"} and len(lines) == 30
    assert all(-1.001 <= float(x[3]) <= 1.001 for x in lines)


def test_wrong_files(spark, corpus, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([("x", 1)], "a string, b bigint").selectExpr("concat(a, ' ', b) as value").write.text(f"{d}/v")
    with pytest.raises(ValueError):
        cli(spark, "train", "--corpus", corpus, "--vocab", f"{d}/v", "--output", f"{d}/o")
    with pytest.raises(SystemExit):
        cli(spark, "train", "--vocab", f"{d}/v", "--output", f"{d}/o")


def test_both_in_a_row(spark, corpus, tmp_path):
    cli(spark, "em", "--corpus", corpus, "--output", str(tmp_path / "o"))
    assert (tmp_path / "o/vocab").exists()


def test_subword_file(spark, corpus, tmp_path):
    words = ["</s>", "the", "cat", "sat.", "sat", "dog", "ran"]
    (tmp_path / "sub.txt").write_text("".join(f"{w} {w[:2]} {w[2:]}\n" for w in words))
    cli(spark, "im", "--corpus", corpus, "--output", str(tmp_path / "o"), "--subword", str(tmp_path / "sub.txt"), "--buckets", "20")
    (tmp_path / "sub.txt").write_text("cat ca t\n")
    with pytest.raises(SystemExit):
        cli(spark, "im", "--corpus", corpus, "--output", str(tmp_path / "o"), "--subword", str(tmp_path / "sub.txt"), "--buckets", "20")
