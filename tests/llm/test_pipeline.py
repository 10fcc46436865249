"""The pipeline's stages on tables with nulls, repeated and very long rows, and without rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
ODD = [
    (None, None, None, None, None),
    (None, "a null id and a text of its own", "en", "src0", 31),
    (None, "a null id and a text of its own", "en", "src0", 31),
    (900_001, "", "", "", 0),
    (900_002, " \t\n", None, "src1", 3),
    (900_003, "one word less than nothing", None, None, None),
    (900_003, "another text under the same id", None, None, None),
    (900_004, "one word less than nothing", "xx", "src9", -5),
    (900_005, LONG, "en", "src2", len(LONG)),
    (None, 'mail a.b@c.org, token = "abcdefgh1" and call', "en", None, 1),
]
CLASHES = ("fp", "component_id", "size", "n", "taken", "toxicity", "shard", "kept", "entity", "_n", "one", "two")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("odd")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, given.schema)
    given.unionByName(odd).withColumns({c: F.lit("clash") for c in CLASHES}).write.parquet(str(top / "documents.parquet"))
    (top / "labels.parquet").symlink_to(f"{SF}/labels.parquet")
    return str(top)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Each stage's rows: of all rows, those that the stage before kept."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_toxicity_keeps_odd_rows(stages):
    kept = texts(stages[1])
    assert stages[1].columns == list(corpus_pipeline.COLUMNS)
    for doc_id, text, *_ in ODD:
        assert kept.count((doc_id, text)) == [r[:2] for r in ODD].count((doc_id, text))


def test_one_of_each_group_stays(stages):
    kept = texts(stages[2])
    assert len(kept) == len(set(kept))
    # Null, empty and wordless texts are one group, that of its smallest id; copies have one row.
    assert [x for x in kept if not (x[1] or "").strip()] == [(900_001, "")]
    assert {t for _, t in kept} >= {"a null id and a text of its own", "another text under the same id", LONG}
    assert [i for i, t in kept if t == "one word less than nothing"] == [900_003]


def test_personal_data_goes(stages):
    after = dict.fromkeys(t for _, t in texts(stages[3]))
    assert LONG in after and not any("a.b@c.org" in (t or "") or "abcdefgh1" in (t or "") for t in after)
    assert stages[3].count() == stages[2].count()


def test_the_mix_and_the_pieces_hold_what_they_take(stages):
    before, mixed, pieces = texts(stages[3]), texts(stages[4]), stages[5]
    assert stages[4].columns == list(corpus_pipeline.COLUMNS)
    wordless = {t for _, t in before if not (t or "").split()}
    assert mixed and not wordless & {t for _, t in mixed}
    tokens = pieces.agg(F.sum("length")).first()[0]
    assert tokens == sum(r.doc_tokens for r in pieces.where("start = 0").select("doc_tokens").collect())
    assert pieces.where("start = 0").count() == len(mixed)


def test_no_rows(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "labels.parquet").symlink_to(f"{SF}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and {"doc_id", "start", "sequence_id"} <= set(found.columns)
