import pytest
from conftest import rows
from pyspark.sql import functions as F

from muster.operators import rules
from muster.operators.settings import layered_settings, sorted_settings, spec_settings
from muster.sources.schemas import SCHEMAS, read_table

OTHER = "registry/own:1"
ROLE = "struct<replicas: int, image: string>"
CLUSTERS = (
    "name string, spec struct<namenode: struct<replicas: int, image: string, "
    "log_aggregation: boolean, retain_seconds: bigint>, "
    f"datanode: {ROLE}, resourcemanager: {ROLE}, nodemanager: {ROLE}, hbase: {ROLE}>"
)


def test_defaults(spark):
    specs = spark.createDataFrame(
        [
            (None, "", True, 0),
            (3, OTHER, True, 60),
            (0, None, False, -1),
            (1, "x", None, None),
            (1, "x", True, None),
        ],
        "replicas int, image string, aggregate boolean, retain bigint",
    )
    filled = rules.apply_defaults(
        specs, ["replicas"], {"image": rules.DEFAULT_IMAGE}, {"retain": "aggregate"}
    )
    assert [tuple(r) for r in filled.select("replicas", "image", "retain").collect()] == [
        (1, rules.DEFAULT_IMAGE, 604800),
        (3, OTHER, 60),
        (0, rules.DEFAULT_IMAGE, -1),
        (1, "x", None),
        (1, "x", 604800),
    ]


def test_defaults_of_the_tables(spark):
    clusters = spark.createDataFrame(
        [
            ("a", {"namenode": {"replicas": 3, "image": "", "log_aggregation": True}, "hbase": {"image": ""}}),
            ("b", {"datanode": {"image": OTHER}}),
            ("c", None),
        ],
        CLUSTERS,
    )
    found = {r.name: r.spec for r in rules.default_clusters(clusters).collect()}
    assert (found["a"].namenode.replicas, found["a"].namenode.image) == (3, rules.DEFAULT_IMAGE)
    assert found["a"].namenode.retain_seconds == 604800
    assert found["a"].hbase.image == rules.DEFAULT_HBASE_IMAGE
    assert found["b"].hbase is None and found["b"].datanode.image == OTHER
    for spec in found.values():
        assert spec.resourcemanager.replicas == 1 and spec.nodemanager.image == rules.DEFAULT_IMAGE

    apps = spark.createDataFrame(
        [("a", ([("x", None), ("y", OTHER), None],)), ("b", None)],
        "name string, loader struct<containers: array<struct<name: string, image: string>>>",
    ).select("name", F.struct(F.lit(None).cast("struct<replicas: int, image: string>").alias("executor"), F.col("loader").alias("dataloader")).alias("spec"))
    found = {r.name: r.spec for r in rules.default_applications(apps).collect()}
    assert [c and c.image for c in found["a"].dataloader.containers] == [rules.DEFAULT_IMAGE, OTHER, None]
    assert found["b"].dataloader is None
    assert tuple(found["b"].executor) == (1, rules.DEFAULT_IMAGE)


@pytest.mark.parametrize(
    ("namenodes", "managers", "image", "failing", "warnings"),
    [
        (2, 2, OTHER, "namenode", 0),
        (1, 2, OTHER, "resourcemanager", 0),
        (1, 1, rules.DEFAULT_IMAGE, None, 0),
        (None, None, rules.DEFAULT_IMAGE, None, 0),
        (1, 1, OTHER, None, 4),
        (0, 1, None, None, 4),
    ],
)
def test_validation(spark, namenodes, managers, image, failing, warnings):
    specs = spark.createDataFrame(
        [(namenodes, managers, image)], "namenodes int, managers int, image string"
    )
    images = dict.fromkeys(("resourcemanager", "nodemanager", "namenode", "datanode"), "image")
    checked = rules.validate(
        specs, {"namenode": "namenodes", "resourcemanager": "managers"}, images
    )
    found = checked.first()
    assert (found.error or "").split(" ")[0] == (failing or "")
    assert len(found.warnings) == warnings
    assert rules.warning_rows(checked, ["namenodes"]).count() == max(warnings, 1)


@pytest.mark.parametrize(
    ("cpu", "memory", "cores", "mb"),
    [
        (1.0, 4 << 30, 1, 4294),
        (0.5, 0, None, None),
        (0.0, 999_999, None, 0),
        (None, None, None, None),
        (2.0, (1 << 62) + 1, 2, ((1 << 62) + 1) // 1_000_000),
    ],
)
def test_requests(spark, cpu, memory, cores, mb):
    frame = spark.createDataFrame([(cpu, memory)], "cpu double, memory bigint")
    found = frame.select(rules.vcores(F.col("cpu")), rules.memory_mb(F.col("memory"))).first()
    assert tuple(found) == (cores, mb)


def test_request_totals(spark):
    frame = spark.createDataFrame(
        [("a", 1.0, 2_000_000), ("a", 1.5, 3_000_000), ("b", None, None)],
        "fleet string, cpu double, memory bigint",
    )
    assert rows(rules.request_totals(frame, ["fleet"])) == [("a", 1, 5, 1, 2), ("b", 0, 0, 0, 0)]


@pytest.mark.parametrize(
    ("report", "live", "ready"),
    [
        ("x\nLive datanodes (12):\ny", 12, True),
        ("Live datanodes (0):", 0, False),
        ("Live datanodes (00):", 0, False),
        ("Live datanodes:", None, False),
        ("", None, False),
        (None, None, False),
    ],
)
def test_health(spark, report, live, ready):
    frame = spark.createDataFrame([(report,)], "report string")
    found = frame.select(
        rules.live_nodes(F.col("report")), rules.storage_ready(F.col("report"))
    ).first()
    assert tuple(found) == (live, ready)


SPEC = (
    "id int, log_aggregation boolean, retain_seconds bigint, name_dir string, "
    "block_size bigint, data_dir string, cpu double, memory bigint"
)


def settings(spark, *specs):
    frame = spark.createDataFrame(list(specs), SPEC)
    spec = {c: F.col(c) for c in frame.columns if c != "id"}
    defaults = [("yarn-site.xml", "yarn.acl.enable", "false"), ("hdfs-site.xml", "a", "1")]
    return layered_settings(frame, ["id"], defaults, spec_settings(spec))


def test_settings_are_appended(spark):
    found = settings(
        spark,
        (1, True, 604800, "", 0, "", 1.0, None),
        (2, False, 604800, "/n", 128, "/d", 0.5, 4 << 30),
        (3, None, None, None, None, None, None, None),
    )
    values = {(r.id, r.name): r.value for r in found.collect()}
    assert values == {
        **{(i, "yarn.acl.enable"): "false" for i in (1, 2, 3)},
        **{(i, "a"): "1" for i in (1, 2, 3)},
        (1, "dfs.namenode.log-aggregation.enable"): "true",
        (1, "dfs.namenode.log-aggregation.retain-seconds"): "604800",
        (1, "yarn.nodemanager.resource.cpu-vcores"): "1",
        (2, "dfs.namenode.name.dir"): "/n",
        (2, "dfs.blocksize"): "128",
        (2, "dfs.datanode.data.dir"): "/d",
        (2, "yarn.nodemanager.resource.memory-mb"): "4294",
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_settings_in_name_order(spark):
    found = sorted_settings(settings(spark, (1, True, 1, "", 9, "", 1.0, None)), ["id"])
    names = [r.name for r in found.where("file = 'hdfs-site.xml'").collect()]
    assert names == sorted(names) and len(names) == 4


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_schemas_read_json(spark, tmp_path, name):
    path = tmp_path / "rows.json"
    path.write_text('{"name": "a"}\n')
    assert read_table(spark, name, str(path), "json").first()["name"] == "a"
