import os
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from muster.operators import words
from muster.sources.sinks import write_lines, write_lines_if_absent
from muster.sources.text import read_lines

TEXTS = ["a b  a\tc", "", "  ", "b,\fA a\r\nc", "x\x0by \n z"]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "value string")


def test_tokens_split_on_five_delimiters_only(lines):
    found = [r.word for r in words.tokenize(lines).collect()]
    assert Counter(found) == Counter(
        ["a", "b", "a", "c", "b,", "A", "a", "c", "x\x0by", "z"]
    )


def test_count(lines):
    counts = {r.word: r.n for r in words.word_count(lines).collect()}
    assert counts == {"a": 3, "b": 1, "c": 2, "b,": 1, "A": 1, "x\x0by": 1, "z": 1}


def test_counts_before_the_shuffle(lines):
    plan = words.word_count(lines)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert plan.count("Exchange") == 1


def test_merge_counts(spark):
    parts = spark.createDataFrame([("a", 2), ("b", 1), ("a", 5)], "word string, n bigint")
    assert dict(words.merge_counts(parts).collect()) == {"a": 7, "b": 1}


def test_multi_path_scan(spark, tmp_path):
    for name, text in (("one", "a\nb\n"), ("two", "c d")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.txt").write_text(text)
    found = read_lines(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert sorted(r.value for r in found.collect()) == ["a", "b", "c d"]


def test_sink_has_sorted_files_and_refuses_to_overwrite(spark, tmp_path):
    many = spark.range(500).select(F.concat(F.lit("w"), F.col("id") % 200).alias("value"))
    target = str(tmp_path / "out")
    counts = words.sorted_by_key(words.word_count(many), partitions=7)
    write_lines(counts, target)
    files = [f for f in os.listdir(target) if f.startswith("part-")]
    assert len(files) == 7
    total = 0
    for name in files:
        keys = [line.split("\t")[0] for line in open(os.path.join(target, name))]
        assert keys == sorted(keys)
        total += len(keys)
    assert total == 200
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_lines(counts, target)


def test_create_if_absent_keeps_what_is_there(spark, tmp_path):
    target = str(tmp_path / "out")
    write_lines_if_absent(spark.createDataFrame([("a", 1)], "word string, n int"), target)
    write_lines_if_absent(spark.createDataFrame([("b", 2)], "word string, n int"), target)
    assert [r.value for r in read_lines(spark, target).collect()] == ["a\t1"]


def test_null_fields_keep_their_place(spark, tmp_path):
    target = str(tmp_path / "out")
    write_lines(spark.createDataFrame([(None, 1)], "word string, n int"), target)
    assert [r.value for r in read_lines(spark, target).collect()] == ["\t1"]
