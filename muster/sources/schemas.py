"""Schemas of the fleet tables and a reader for their JSON or columnar form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The roles a workload may have, and those that gate a cluster's readiness.
ROLES = (
    "namenode",
    "datanode",
    "resourcemanager",
    "nodemanager",
    "configmap",
    "driver",
    "dataloader",
    "hbase",
)
GATING_ROLES = ("namenode", "datanode", "resourcemanager", "nodemanager")

_META = (
    "namespace STRING, name STRING, uid STRING, created_at TIMESTAMP, deleted_at TIMESTAMP, "
    "labels MAP<STRING, STRING>"
)
_OWNER = "STRUCT<kind: STRING, name: STRING, uid: STRING, controller: BOOLEAN>"
CONDITIONS = (
    "ARRAY<STRUCT<type: STRING, status: STRING, reason: STRING, message: STRING, "
    "last_update: TIMESTAMP, last_transition: TIMESTAMP>>"
)
_ROLE_SPEC = (
    "STRUCT<replicas: INT, image: STRING, cpu: DOUBLE, memory: BIGINT, "
    "env: ARRAY<STRUCT<name: STRING, value: STRING>>>"
)

SCHEMAS = {
    "clusters": f"""{_META},
        spec STRUCT<
            namenode: STRUCT<
                replicas: INT, image: STRING, log_aggregation: BOOLEAN, retain_seconds: BIGINT,
                name_dir: STRING, block_size: BIGINT>,
            datanode: STRUCT<replicas: INT, image: STRING, data_dir: STRING>,
            resourcemanager: {_ROLE_SPEC}, nodemanager: {_ROLE_SPEC}, hbase: {_ROLE_SPEC}>,
        status STRUCT<
            conditions: {CONDITIONS},
            replicas: MAP<STRING, STRUCT<active: INT, expect: INT>>, start_time: TIMESTAMP>""",
    "applications": f"""{_META},
        spec STRUCT<
            main_file: STRING, args: ARRAY<STRING>,
            executor: STRUCT<replicas: INT, image: STRING, delete_on_termination: BOOLEAN>,
            dataloader: STRUCT<containers: ARRAY<STRUCT<name: STRING, image: STRING>>>>,
        status STRUCT<
            conditions: {CONDITIONS}, start_time: TIMESTAMP, completion_time: TIMESTAMP>""",
    "objects": f"""kind STRING, {_META}, owner {_OWNER}, replicas INT, phase STRING,
        conditions ARRAY<STRUCT<type: STRING, status: STRING>>""",
    "feed": f"""op STRING, kind STRING, namespace STRING, name STRING, role STRING,
        rv_old BIGINT, rv_new BIGINT, old_owner {_OWNER}, new_owner {_OWNER}, ts TIMESTAMP""",
    "settings": "file STRING, name STRING, value STRING",
}


def read_table(spark: SparkSession, table: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A fleet table under its fixed schema: no inference pass over the data."""
    return spark.read.schema(SCHEMAS[table]).format(fmt).load(path)
