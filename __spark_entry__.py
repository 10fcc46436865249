"""Registry: every operator run on the given tables, and the same result as SQL.

The fleet tables the operators work on do not exist among the given ones, so each query
derives its input from them by a fixed expression, the same in Spark and in SQL.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from muster.functions import conditions as conds  # noqa: E402
from muster.functions.labels import entries  # noqa: E402
from muster.operators import changes, claims, estimate, ownership, replicas, rules, words  # noqa: E402
from muster.operators.jobs import Job  # noqa: E402
from muster.operators.lifecycle import lifecycles, phase_condition  # noqa: E402
from muster.operators.settings import Setting, layered_settings, sorted_settings, spec_settings  # noqa: E402
from muster.operators.timeline import condition_lists, condition_rows  # noqa: E402
from muster.plans.slices import MIN_ROWS, with_previous  # noqa: E402
from muster.session import shared_folder  # noqa: E402
from muster.sources.index import ObjectIndex  # noqa: E402
from muster.sources.objects import get_object, list_objects  # noqa: E402
from muster.sources.sinks import write_lines, write_lines_if_absent  # noqa: E402
from muster.sources.text import read_lines  # noqa: E402
from muster.streaming import feed as feeds  # noqa: E402
from muster.streaming import ledger  # noqa: E402
from muster.streaming import timeline as streams  # noqa: E402
from muster.streaming.keyed import KeyedTable  # noqa: E402
from muster.streaming.versions import maintain_previous, read_previous  # noqa: E402

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the decorated function under its name, with its SQL if there is one."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Text jobs ----------------------------------------------------------------------

WORDS = r"""
    select unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) as word, * exclude (text)
    from documents"""


@query("""
    select line, count(*) as n
    from (
        select unnest(string_split(text, chr(10))) as line from documents
        union all
        select unnest(string_split(text, chr(10))) as line from conversations)
    group by line""")
def multi_path_lines(spark, sf_dir):
    """Two text folders read as one input, one row per line."""
    paths = []
    for name in ("documents", "conversations"):
        paths.append(shared_folder(spark, f"text-{name}"))
        table(spark, sf_dir, name).select("text").write.text(paths[-1])
    lines = read_lines(spark, paths).withColumnRenamed("value", "line")
    return words.count_words(lines, ["line"])


@query(f"select doc_id, word from ({WORDS}) where word <> ''")
def tokens(spark, sf_dir):
    return words.tokenize(table(spark, sf_dir, "documents"), "text", keep=["doc_id"])


@query(f"select word, count(*) as n from ({WORDS}) where word <> '' group by word")
def word_count(spark, sf_dir):
    return words.word_count(table(spark, sf_dir, "documents"), "text")


@query(f"select word, count(*) as n from ({WORDS}) where word <> '' group by word")
def user_word_count(spark, sf_dir):
    """The same by a mapper and a combiner of the user's, in Python over Arrow tables."""

    def words_of(batch: pa.RecordBatch) -> pa.Table:
        found = pc.list_flatten(pc.split_pattern_regex(batch["text"].cast(pa.large_string()), "[ \\t\\n\\r\\f]+"))
        found = found.filter(pc.not_equal(found, ""))
        return pa.table({"word": found, "n": pa.repeat(pa.scalar(1, pa.int64()), len(found))})

    def total(table: pa.Table) -> pa.Table:
        return table.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    job = Job(words_of, ["word"], "word string, n bigint", total)
    return job.run(table(spark, sf_dir, "documents").select("text"))


@query(f"select lang, word, count(*) as n from ({WORDS}) where word <> '' group by lang, word")
def merged_counts(spark, sf_dir):
    """Counts taken per source, then added up per language."""
    found = words.tokenize(table(spark, sf_dir, "documents"), "text", keep=["lang", "source"])
    per_source = words.count_words(found, ["lang", "source", "word"])
    return words.merge_counts(per_source, ["lang", "word"])


@query(f"select word, count(*) as n from ({WORDS}) where word <> '' group by word")
def sorted_word_count(spark, sf_dir):
    """Each partition in key order, on the partitioning the count already has."""
    return words.sorted_by_key(word_count(spark, sf_dir))


def _read_counts(spark, path):
    return read_lines(spark, path).select(
        F.split_part("value", F.lit("\t"), F.lit(1)).alias("word"),
        F.split_part("value", F.lit("\t"), F.lit(2)).cast("bigint").alias("n"),
    )


@query(f"select word, count(*) as n from ({WORDS}) where word <> '' group by word")
def word_count_text_sink(spark, sf_dir):
    """Word counts through the sorted text sink, which refuses an existing target."""
    path = shared_folder(spark, "word-count")
    write_lines(sorted_word_count(spark, sf_dir), path)
    return _read_counts(spark, path)


@query(f"select word, count(*) as n from ({WORDS}) where word <> '' group by word")
def create_if_absent(spark, sf_dir):
    """A second write to the same target leaves it as it is."""
    path = shared_folder(spark, "create-if-absent")
    counts = word_count(spark, sf_dir)
    write_lines_if_absent(counts, path)
    write_lines_if_absent(counts.withColumn("n", F.col("n") * 2), path)
    return _read_counts(spark, path)


def _mirrored_sql(base: int, digits: int) -> str:
    places = [
        f"((point // {base**k}) % {base}) * {base ** (digits - 1 - k)}" for k in range(digits)
    ]
    return f"({' + '.join(places)})::DOUBLE / {base**digits}::DOUBLE"


@query(f"""
    with points as (
        select {_mirrored_sql(2, 41)} - 0.5::DOUBLE as dx,
               {_mirrored_sql(3, 30)} - 0.5::DOUBLE as dy
        from (select o_orderkey + 1 as point from orders))
    select count(*) filter (where dx * dx + dy * dy <= 0.25::DOUBLE) as inside,
           count(*) as total,
           4.0::DOUBLE * count(*) filter (where dx * dx + dy * dy <= 0.25::DOUBLE)
               / count(*) as pi
    from points""")
def pi_estimate(spark, sf_dir):
    """One Halton point per order, numbered by the order key."""
    indexes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("point"))
    return estimate.estimate_pi(estimate.halton_points(indexes, "point"))


# --- Listing, owners, claims -----------------------------------------------------------


@query("select doc_id, lang, source from documents where lang = 'en' and source = 'src3'")
def label_selector_scan(spark, sf_dir):
    objects = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        F.lit("default").alias("namespace"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("labels"),
    )
    found = list_objects(objects, "default", {"lang": "en", "source": "src3"})
    return found.select("doc_id", "lang", "source")


@query("""
    select c_mktsegment, c_name, c_custkey from customer
    where c_mktsegment = 'MACHINERY' and c_name = 'Customer#000000001'""")
def object_lookup(spark, sf_dir):
    """One object by namespace (the segment) and name."""
    objects = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("namespace"), F.col("c_name").alias("name"), "c_custkey"
    )
    found = get_object(objects, "MACHINERY", "Customer#000000001")
    return found.withColumnsRenamed({"namespace": "c_mktsegment", "name": "c_name"})


def _object_index(spark, objects: DataFrame, key: list[str]) -> ObjectIndex:
    index = ObjectIndex(shared_folder(spark, "index"), tuple(key))
    index.write(objects)
    return index


@query("select doc_id, lang, source from documents where lang = 'fr' and source = 'src3' and doc_id % 40 = 3")
def label_index_select(spark, sf_dir):
    """A selector of three pairs through the index of labels, from its rarest pair on."""
    labels = {"lang": F.col("lang"), "source": F.col("source"), "shard": (F.col("doc_id") % 40).cast("string")}
    objects = table(spark, sf_dir, "documents").select(
        F.lit("default").alias("namespace"),
        F.col("doc_id").cast("string").alias("name"),
        "doc_id",
        "lang",
        "source",
        F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), v)]).alias("labels"),
    )
    index = _object_index(spark, objects.where("lang is not null and source is not null"), ["namespace", "name"])
    found = index.select(spark, "default", {"lang": "fr", "source": "src3", "shard": "3"})
    return found.select("doc_id", "lang", "source")


@query("""
    select c_mktsegment, c_name, c_custkey from customer
    where c_mktsegment = 'MACHINERY' and c_name = 'Customer#000000001'""")
def object_lookup_bucketed(spark, sf_dir):
    """The same object from the one bucket that it lies in."""
    segment = F.create_map(F.lit("segment"), "c_mktsegment").alias("labels")
    customers = table(spark, sf_dir, "customer").select("c_mktsegment", "c_name", "c_custkey", segment)
    index = _object_index(spark, customers, ["c_mktsegment", "c_name"])
    return index.get(spark, "MACHINERY", "Customer#000000001").drop("labels")


@query("""
    select o_orderkey, c_custkey, c_custkey * 10 as uid
    from orders join customer on o_custkey = c_custkey
        and o_custkey * 10 + case when o_orderkey % 11 = 0 then 1 else 0 end = c_custkey * 10""")
def owner_resolution(spark, sf_dir):
    dependents = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        (F.col("o_custkey") * 10 + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)).alias(
            "ref_uid"
        ),
    )
    owners = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") * 10).alias("uid")
    )
    found = ownership.resolve_owners(dependents, owners, {"o_custkey": "c_custkey"})
    return found.select("o_orderkey", "c_custkey", "uid")


@query("""
    with pairs as (
        select o_orderkey, c_custkey as uid,
               case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then -1
                    else o_custkey end as ref_uid,
               o_orderpriority in ('1-URGENT', '2-HIGH') as is_match,
               c_acctbal < 0 as deleting, o_orderstatus = 'P' as terminating
        from orders join customer on o_custkey = c_custkey)
    select o_orderkey, uid,
           case when ref_uid is not null and ref_uid <> uid then 'ignored_foreign'
                when ref_uid is not null and is_match then 'owned'
                when ref_uid is not null and deleting then 'ignored_deleting'
                when ref_uid is not null then 'release'
                when deleting or not is_match then 'ignored'
                when terminating then 'ignored_terminating'
                else 'adopt' end as action
    from pairs""")
def claim_classification(spark, sf_dir):
    key = F.col("o_orderkey")
    objects = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("scope"),
        F.when(key % 5 == 0, None)
        .when(key % 7 == 0, -1)
        .otherwise(F.col("o_custkey"))
        .alias("ref_uid"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("match"),
        (F.col("o_orderstatus") == "P").alias("terminating"),
    )
    owners = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("scope"),
        F.col("c_custkey").alias("uid"),
        (F.col("c_acctbal") < 0).alias("deleting"),
    )
    claims = ownership.classify_claims(objects, owners, ["scope"])
    return claims.select("o_orderkey", "uid", "action")


# Sixty owners to a namespace, whose selectors ask for up to three labels: one takes all of its
# namespace, and one has no selector. A third of the objects are orphans.
CLAIM_SQL = """
    with objects as (
        select o_orderkey, o_custkey // 60 as ns,
            case when o_orderkey % 3 = 0 then null when o_orderkey % 7 = 0 then -1 else o_custkey end as ref_uid,
            o_orderstatus = 'P' as terminating,
            ['status=' || o_orderstatus, 'priority=' || o_orderpriority, 'shard=' || o_orderkey % 50] as labels
        from orders),
    owners as (
        select c_custkey as uid, c_custkey // 60 as ns, c_acctbal < 0 as deleting,
            ['status=' || ['F', 'O', 'P'][c_custkey % 3 + 1], 'priority=1-URGENT', 'shard=' || c_custkey % 50] as pairs,
            case c_custkey % 60 when 3 then [] when 4 then null
                else list_filter(pairs, lambda x, i: (c_custkey // (1 << (i - 1))) % 2 = 1 or i = 3) end as selector
        from customer),
    pairs as (
        select o_orderkey, ref_uid, uid, deleting, terminating,
            coalesce(list_has_all(labels, selector), false) as is_match
        from objects join owners using (ns)
        where is_match or coalesce(ref_uid = uid, false)),
    claims as (
        select o_orderkey, uid, case
            when ref_uid <> uid then 'ignored_foreign'
            when ref_uid is not null and is_match then 'owned'
            when ref_uid is not null and deleting then 'ignored_deleting'
            when ref_uid is not null then 'release'
            when deleting or not is_match then 'ignored'
            when terminating then 'ignored_terminating'
            else 'adopt' end as action
        from pairs)"""


def _claim_tables(spark, sf_dir):
    def labels(status, priority, shard):
        pairs = {"status": status, "priority": priority, "shard": shard.cast("string")}
        return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])

    key, owner = F.col("o_orderkey"), F.col("c_custkey")
    ref = F.when(key % 3 == 0, None).when(key % 7 == 0, -1).otherwise(F.col("o_custkey"))
    objects = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.floor(F.col("o_custkey") / 60).alias("ns"),
        ref.alias("ref_uid"),
        labels(F.col("o_orderstatus"), F.col("o_orderpriority"), key % 50).alias("labels"),
        (F.col("o_orderstatus") == "P").alias("terminating"),
    )
    status = F.when(owner % 3 == 0, "F").when(owner % 3 == 1, "O").otherwise("P")
    wanted = F.map_filter(
        labels(status, F.lit("1-URGENT"), owner % 50),
        lambda k, _: (k == "shard") | ((k == "status") & (owner % 2 == 1)) | ((k == "priority") & (F.floor(owner / 2) % 2 == 1)),
    )
    selector = F.when(owner % 60 == 3, F.map_filter(wanted, lambda k, _: F.lit(False))).when(owner % 60 != 4, wanted)
    owners = table(spark, sf_dir, "customer").select(
        owner.alias("uid"), F.floor(owner / 60).alias("ns"), (F.col("c_acctbal") < 0).alias("deleting"), selector.alias("selector")
    )
    return objects, owners


@query(f"{CLAIM_SQL} select * from claims")
def candidate_claims(spark, sf_dir):
    """Each owner whose selector takes an object, and its controller."""
    found = claims.candidate_claims(*_claim_tables(spark, sf_dir), ["ns"], ["o_orderkey"])
    return found.select("object.o_orderkey", "owner.uid", "action")


@query(f"""
    {CLAIM_SQL}
    select o_orderkey, count(c.uid) as candidates, min(c.uid) as adopter
    from objects left join (select * from claims where action = 'adopt') c using (o_orderkey)
    where ref_uid is null group by o_orderkey""")
def orphan_adopters(spark, sf_dir):
    """Orphans that no owner, one or several would adopt."""
    objects, owners = _claim_tables(spark, sf_dir)
    found = claims.candidate_claims(objects, owners, ["ns"], ["o_orderkey"])
    return claims.adopters(found, objects, ["o_orderkey"])


@query("""
    select c_custkey,
           case when c_mktsegment = 'BUILDING' then 'nation=marked,segment=BUILDING,state=deleting'
                else 'nation=' || c_nationkey || ',segment=' || c_mktsegment end as labels
    from customer""")
def bulk_marking(spark, sf_dir):
    """Marks one segment; a mark overwrites the label of the same name."""
    objects = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.create_map(
            F.lit("segment"),
            F.col("c_mktsegment"),
            F.lit("nation"),
            F.col("c_nationkey").cast("string"),
        ).alias("labels"),
    )
    marked = ownership.mark_matching(
        objects, {"state": "deleting", "nation": "marked"}, {"segment": "BUILDING"}
    )
    pairs = F.transform(entries(F.col("labels")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return marked.select("c_custkey", F.array_join(pairs, ",").alias("labels"))


@query("""
    select c_custkey, c_name from customer
    where c_custkey in (select o_custkey from orders
                        where o_orderstatus = 'F' and o_orderkey % 3 <> 2)""")
def reclaimable_clusters(spark, sf_dir):
    """Applications are orders: status F has finished, the keep flag is null, true or false."""
    state = F.when(F.col("o_orderstatus") == "F", "Succeeded").otherwise("Running")
    flag = F.when(F.col("o_orderkey") % 3 == 1, True).when(F.col("o_orderkey") % 3 == 2, False)
    apps = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.array(F.struct(state.alias("type"), F.lit("True").alias("status"))).alias("conditions"),
        flag.alias("delete_on_termination"),
    )
    clusters = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return ownership.reclaimable_clusters(clusters, apps, ["c_custkey"])


# --- Replicas ----------------------------------------------------------------------------

FLAGS = ("R", "A", "N")

ACTIVE_SQL = """
    select o_orderkey, o_custkey, o_totalprice, role, coalesce(n, 0)::BIGINT as active
    from orders cross join (select unnest(['R', 'A', 'N']) as role)
    left join (select l_orderkey, l_returnflag, count(*) as n from lineitem
               where l_linestatus = 'O' and l_quantity >= 5 group by all)
        on l_orderkey = o_orderkey and l_returnflag = role"""

EXPECT_SQL = "case when o_custkey % 4 <> 0 then o_custkey % 3 end"

ROLE_SQL = f"""
    select *, active >= coalesce({EXPECT_SQL}, 1) as ready
    from ({ACTIVE_SQL})"""


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _lines(spark, sf_dir):
    """Line items as objects of their orders."""
    ready = F.when(F.col("l_linestatus") == "O", "True").otherwise("False")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_returnflag").alias("role"),
        F.lit("Running").alias("phase"),
        F.array(
            F.struct(F.lit("Initialized").alias("type"), F.lit("True").alias("status")),
            F.struct(F.lit("Ready").alias("type"), ready.alias("status")),
        ).alias("conditions"),
        F.when(F.col("l_quantity") < 5, F.col("l_shipdate")).alias("deleted_at"),
    )


def _active(spark, sf_dir):
    owners, objects = _orders(spark, sf_dir), _lines(spark, sf_dir)
    return replicas.active_replicas(owners, objects, ["o_orderkey"], FLAGS)


def _expect():
    return F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 3)


def _roles(spark, sf_dir):
    return _active(spark, sf_dir).withColumn(
        "ready", replicas.replica_ready(F.col("active"), _expect())
    )


@query(f"select o_orderkey, role, active::INTEGER as active, ({EXPECT_SQL})::INTEGER as expect from ({ACTIVE_SQL})")
def replica_status(spark, sf_dir):
    owners = _orders(spark, sf_dir).withColumn("expect", _expect())
    expected = dict.fromkeys(FLAGS, "expect")
    found = replicas.replica_status(owners, _lines(spark, sf_dir), ["o_orderkey"], expected)
    found = found.select("o_orderkey", F.explode("replicas").alias("role", "status"))
    return found.select("o_orderkey", "role", "status.active", "status.expect")


@query(f"select o_orderkey, role, active from ({ACTIVE_SQL})")
def active_replicas(spark, sf_dir):
    return _active(spark, sf_dir).select("o_orderkey", "role", "active")


@query("""
    select o_orderkey, role, coalesce(n, 0)::BIGINT as active
    from orders cross join (select unnest(['R', 'A', 'N']) as role)
    left join (select l_orderkey, l_returnflag, sum(1 + (l_suppkey % 4 = 0)::INTEGER) as n from lineitem
               where l_linestatus = 'O' and l_quantity >= 5 and l_partkey % 3 = 0 and l_suppkey % 5 > 0 group by all)
        on l_orderkey = o_orderkey and l_returnflag = role""")
def active_replicas_of_phases(spark, sf_dir):
    """Objects of three phases, some without conditions and some with two that are Ready."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    ready = F.struct(F.lit("Ready").alias("type"), F.when(F.col("l_linestatus") == "O", "True").otherwise("Unknown").alias("status"))
    objects = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_returnflag").alias("role"),
        F.when(part % 3 == 0, "Running").when(part % 3 == 1, "Pending").alias("phase"),
        F.when(supplier % 5 > 0, F.when(supplier % 4 == 0, F.array(ready, ready)).otherwise(F.array(ready))).alias("conditions"),
        F.when(F.col("l_quantity") < 5, F.col("l_shipdate")).alias("deleted_at"),
    )
    found = replicas.active_replicas(_orders(spark, sf_dir), objects, ["o_orderkey"], FLAGS)
    return found.select("o_orderkey", "role", "active")


@query(f"""
    select o_orderkey, bool_and(ready) as replicas_ready,
           any_value(o_totalprice) >= 1000 as configured,
           bool_and(ready) and any_value(o_totalprice) >= 1000 as ready
    from ({ROLE_SQL}) group by o_orderkey""")
def cluster_readiness(spark, sf_dir):
    configured = table(spark, sf_dir, "orders").where("o_totalprice >= 1000")
    return replicas.cluster_readiness(
        _roles(spark, sf_dir), ["o_orderkey"], FLAGS, configured.select("o_orderkey")
    )


@query(f"""
    select o_orderkey,
           min(case when not ready then list_position(['R', 'A', 'N'], role) end)::INTEGER
               as open_stage
    from ({ROLE_SQL}) group by o_orderkey""")
def first_open_stage(spark, sf_dir):
    number = F.array_position(F.array(*[F.lit(f) for f in FLAGS]), F.col("role")).cast("int")
    stages = _roles(spark, sf_dir).select("o_orderkey", number.alias("stage"), "ready")
    return replicas.first_open_stage(stages, ["o_orderkey"], done="ready")


@query("""
    select o_orderkey,
           case when o_orderstatus = 'O' or o_custkey % 5 = 0 then 1
                when o_orderkey % 2 = 0 and o_orderpriority <> '1-URGENT' then 2
                when o_totalprice < 100000 then 3 end::INTEGER as open_stage
    from orders""")
def application_gate(spark, sf_dir):
    """Orders as applications: cluster running, data loaded if there is a loader, driver."""
    loader = F.when(F.col("o_orderpriority") == "1-URGENT", "Succeeded").otherwise("Running")
    gate = replicas.application_open_stage(
        F.col("o_orderstatus") != "O",
        F.col("o_orderkey") % 2 == 0,
        loader,
        F.col("o_totalprice") >= 100000,
        F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderdate")),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", gate.alias("open_stage"))


@query("""
    with observed as (select l_orderkey, count(*) as n from lineitem group by 1)
    select o_orderkey,
           coalesce(case when o_custkey % 4 <> 0 then o_custkey % 3 end, 1) as desired,
           coalesce(n, 1) as observed,
           coalesce(case when o_custkey % 4 <> 0 then o_custkey % 3 end, 1)
               <> coalesce(n, 1) as drifted
    from orders left join observed on l_orderkey = o_orderkey""")
def replica_drift(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    desired = orders.select(
        "o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 3).alias("replicas")
    )
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    counted = items.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("observed"))
    observed = orders.select("o_orderkey").join(counted, "o_orderkey", "left")
    return replicas.drift(desired, observed, ["o_orderkey"])


@query("""
    with expected as (
        select o_orderkey, unnest(range(0, o_custkey % 4)) as ordinal from orders)
    select o_orderkey, ordinal::BIGINT as ordinal,
           'order' || o_orderkey || '-datanode-' || ordinal as name
    from expected
    where not exists (select 1 from lineitem
                      where l_orderkey = o_orderkey and l_linenumber - 1 = ordinal)""")
def missing_children(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 4).alias("replicas")
    )
    children = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("ordinal"),
    )
    missing = replicas.missing_children(parents, children, ["o_orderkey"])
    parent = F.concat(F.lit("order"), F.col("o_orderkey").cast("string"))
    return missing.withColumn(
        "name", replicas.child_name(parent, F.lit("datanode"), F.col("ordinal"))
    )


# --- Conditions ----------------------------------------------------------------------------

REPORT_SQL = r"""
    select user_id, ts, event_id,
           case event_type when 'signup' then 'Created' when 'error' then 'Reconfiguring'
                else 'Running' end as type,
           (regexp_extract(props, '(\d+)', 1)::INTEGER % 2)::VARCHAR as reason
    from events"""

def _timeline_sql(reports: str, key: str, removes: str) -> str:
    """The rules as SQL; ``removes`` tells when a later type r removes an earlier one l."""
    return f"""
    with reports as ({reports}),
    marked as (
        select *, lag(type) over w is distinct from type as starts,
               lag(type) over w is distinct from type
                   or lag(reason) over w is distinct from reason as counts
        from reports window w as (partition by {key} order by ts, event_id)),
    islands as (
        select *, sum(starts::INTEGER) over (
            partition by {key} order by ts, event_id) as island
        from marked),
    kept as (
        select *, min(ts) over (partition by {key}, island) as since from islands),
    latest as (
        select * from kept where counts
        qualify row_number() over (partition by {key}, type order by ts desc, event_id desc) = 1),
    present as (
        select * from latest l
        where not exists (
            select 1 from latest r where r.{key} = l.{key} and {removes}
                and (r.ts, r.event_id) > (l.ts, l.event_id)))
    select {key},
           row_number() over (partition by {key} order by ts, event_id)::INTEGER as position,
           type,
           case when row_number() over (
                    partition by {key} order by ts desc, event_id desc) = 1
                then 'True' else 'False' end as status,
           reason, ts as last_update, since as last_transition
    from present"""


TIMELINE_SQL = _timeline_sql(REPORT_SQL, "user_id", "r.type = 'Reconfiguring' and l.type = 'Running'")

APP_REPORT_SQL = r"""
    select user_id * 4 + k % 4 as app, ts, event_id,
           case event_type when 'signup' then 'Created' when 'error' then 'Failed' when 'purchase' then 'Succeeded'
                when 'view' then ['DataLoading', 'Submitted'][k // 4 % 2 + 1] else 'Running' end as type,
           case when k % 5 <> 0 then (k % 3)::VARCHAR end as reason
    from (select *, regexp_extract(props, '(\d+)', 1)::INTEGER as k from events)"""

APP_TIMELINE_SQL = _timeline_sql(APP_REPORT_SQL, "app", "false")


def _k(props: str = "props"):
    return F.regexp_extract(props, r"(\d+)", 1).cast("int")


def _reports(events: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "Created")
        .when(F.col("event_type") == "error", "Reconfiguring")
        .otherwise("Running")
    )
    return events.select(
        "user_id",
        "ts",
        "event_id",
        kind.alias("type"),
        (_k() % 2).cast("string").alias("reason"),
    )


def _condition_lists(spark, sf_dir, min_rows=MIN_ROWS):
    reports = _reports(table(spark, sf_dir, "events"))
    return condition_lists(reports, ["user_id"], ["ts", "event_id"], min_rows=min_rows)


@query(TIMELINE_SQL)
def condition_timeline(spark, sf_dir):
    return condition_rows(_condition_lists(spark, sf_dir), ["user_id"]).drop("message")


@query(TIMELINE_SQL)
def condition_timeline_sliced(spark, sf_dir):
    """The same with the log of every user of more than 4 events cut into slices."""
    return condition_rows(_condition_lists(spark, sf_dir, 4), ["user_id"]).drop("message")


def _event_stream(spark, sf_dir):
    """Events as a stream, on a session of its own with the RocksDB state store."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.ROCKSDB)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    # State partitions are fixed at the first start: one per core of the cluster.
    cores = spark.sparkContext.defaultParallelism
    session.conf.set("spark.sql.shuffle.partitions", str(cores))
    schema = table(spark, sf_dir, "events").schema
    # A pattern, as a stream reads folders: the table may be one file or a folder of files.
    events = feeds.read_feed(session, f"{sf_dir}/events.parquet*", schema)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query(TIMELINE_SQL)
def condition_stream(spark, sf_dir):
    """The same from a stream that keeps a row per object; its state after the last batch."""
    path, checkpoint = shared_folder(spark, "conditions"), shared_folder(spark, "checkpoint")
    reports = _reports(_event_stream(spark, sf_dir))
    streams.maintain_conditions(reports, ["user_id"], ["ts", "event_id"], path, checkpoint).awaitTermination()
    lists = streams.current_conditions(reports.sparkSession, path, ["user_id"])
    rows = condition_rows(lists, ["user_id"])
    plain = {c: F.col(c).cast("timestamp_ntz") for c in ("last_update", "last_transition")}
    return rows.drop("message").withColumns(plain)


@query(f"""
    with rows as ({TIMELINE_SQL}),
    users as (select user_id, min(ts) as created_at from events group by user_id)
    select user_id,
           bool_or(type = 'Created' and status = 'True') as is_created,
           bool_or(type = 'Running' and status = 'True') as is_running,
           bool_or(type in ('Succeeded', 'Failed') and status = 'True') as is_finished,
           any_value(type) filter (where status = 'True') as current_type,
           date_sub('second', max(last_update), TIMESTAMP '2024-03-01 00:00:00') as age_seconds
    from rows group by user_id""")
def condition_predicates(spark, sf_dir):
    c = F.col("conditions")
    newest = F.try_element_at(c, F.lit(-1))["last_update"]
    return _condition_lists(spark, sf_dir).select(
        "user_id",
        conds.is_created(c).alias("is_created"),
        conds.is_running(c).alias("is_running"),
        conds.is_finished(c).alias("is_finished"),
        conds.current_type(c).alias("current_type"),
        conds.age_seconds(newest, F.expr("timestamp_ntz'2024-03-01'")).alias("age_seconds"),
    )


def _app_lists(spark, sf_dir):
    event, k = F.col("event_type"), F.col("k")
    loading = F.when(F.floor(k / 4) % 2 == 0, "DataLoading").otherwise("Submitted")
    kind = (
        F.when(event == "signup", "Created").when(event == "error", "Failed").when(event == "purchase", "Succeeded")
        .when(event == "view", loading).otherwise("Running")
    )
    reports = table(spark, sf_dir, "events").withColumn("k", _k()).select(
        (F.col("user_id") * 4 + k % 4).alias("app"), "ts", "event_id", kind.alias("type"),
        F.when(k % 5 != 0, (k % 3).cast("string")).alias("reason"),
    )
    return condition_lists(reports, ["app"], ["ts", "event_id"], conds.APPLICATION_TYPES, reconfiguring=None)


@query(APP_TIMELINE_SQL)
def application_timeline(spark, sf_dir):
    """Applications: six types, none of which removes another."""
    return condition_rows(_app_lists(spark, sf_dir), ["app"]).drop("message")


@query(f"""
    with rows as ({APP_TIMELINE_SQL})
    select app, bool_or(type = 'Created' and status = 'True') as is_created,
           bool_or(type = 'Submitted' and status = 'True') as is_submitted,
           bool_or(type = 'Running' and status = 'True') as is_running,
           bool_or(type in ('Succeeded', 'Failed') and status = 'True') as is_finished,
           any_value(type) filter (where status = 'True') as current_type
    from rows group by app""")
def application_predicates(spark, sf_dir):
    c = F.col("conditions")
    return _app_lists(spark, sf_dir).select(
        "app",
        conds.is_created(c).alias("is_created"),
        conds.is_submitted(c).alias("is_submitted"),
        conds.is_running(c).alias("is_running"),
        conds.is_finished(c).alias("is_finished"),
        conds.current_type(c).alias("current_type"),
    )


@query(r"""
    select event_id,
           case when phase = 'Running' and ready and not running then 'Running'
                when phase in ('Succeeded', 'Failed') then phase end as reported
    from (
        select event_id, k % 2 = 0 as running, case when k % 3 > 0 then k % 3 = 1 end as ready,
               case event_type when 'purchase' then 'Succeeded' when 'error' then 'Failed'
                    when 'signup' then 'Pending' else 'Running' end as phase
        from (select *, regexp_extract(props, '(\d+)', 1)::INTEGER as k from events))""")
def driver_conditions(spark, sf_dir):
    """The condition that each phase of a driver reports, if any."""
    event, k = F.col("event_type"), _k()
    phase = (
        F.when(event == "purchase", "Succeeded").when(event == "error", "Failed")
        .when(event == "signup", "Pending").otherwise("Running")
    )
    reported = phase_condition(phase, F.when(k % 3 > 0, k % 3 == 1), k % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", reported.alias("reported"))


@query(r"""
    with phases as (
        select user_id, regexp_extract(props, '(\d+)', 1)::INTEGER as run, ts, event_id,
               case event_type when 'purchase' then 'Succeeded' when 'error' then 'Failed'
                    when 'signup' then 'Pending' else 'Running' end as phase,
               event_type = 'click' as ready
        from events),
    firsts as (
        select user_id, run, min(ts) as start_time,
               arg_min(phase, event_id) filter (where phase in ('Succeeded', 'Failed')) as ended,
               min(ts) filter (where phase in ('Succeeded', 'Failed')) as completion_time,
               min(ts) filter (where ready) as ran
        from phases group by user_id, run)
    select user_id, run,
           coalesce(ended, case when ran is not null then 'Running' end, 'Created') as state,
           start_time,
           case when completion_time is null or ran < completion_time then ran end
               as running_time,
           completion_time,
           date_sub('second', start_time, completion_time) as seconds
    from firsts""")
def lifecycle(spark, sf_dir):
    """(user, k) as application; a click is a running and ready driver, a view not ready."""
    event = F.col("event_type")
    phase = (
        F.when(event == "purchase", "Succeeded")
        .when(event == "error", "Failed")
        .when(event == "signup", "Pending")
        .otherwise("Running")
    )
    phases = table(spark, sf_dir, "events").select(
        "user_id",
        _k().alias("run"),
        "ts",
        "event_id",
        phase.alias("phase"),
        (event == "click").alias("ready"),
    )
    return lifecycles(phases, ["user_id", "run"], ["ts", "event_id"])


# --- Rules and settings ----------------------------------------------------------------------

PART_SQL = """
    select p_partkey, p_size % 4 as namenodes, p_size % 3 as resourcemanagers,
           case when p_size % 2 = 0 then 'apache/hadoop:3' else p_brand end as nn_image,
           case when p_size % 5 = 0 then '' when p_size % 7 = 0 then null else 'apache/hadoop:3'
               end as rm_image,
           case when p_size % 6 <> 0 then p_size % 4 end as replicas,
           p_size % 3 = 0 as aggregate,
           case when p_size % 4 <> 0 then p_size % 4 - 2 end as retain
    from part"""


def _parts(spark, sf_dir, *more):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        *more,
        (size % 4).alias("namenodes"),
        (size % 3).alias("resourcemanagers"),
        F.when(size % 2 == 0, rules.DEFAULT_IMAGE).otherwise(F.col("p_brand")).alias("nn_image"),
        F.when(size % 5 == 0, "")
        .when(size % 7 == 0, None)
        .otherwise(rules.DEFAULT_IMAGE)
        .alias("rm_image"),
        F.when(size % 6 != 0, size % 4).alias("replicas"),
        (size % 3 == 0).alias("aggregate"),
        F.when(size % 4 != 0, size % 4 - 2).alias("retain"),
    )


@query(f"""
    select p_partkey, coalesce(replicas, 1) as replicas,
           coalesce(nullif(nn_image, ''), 'apache/hadoop:3') as nn_image,
           coalesce(nullif(rm_image, ''), 'apache/hadoop:3') as rm_image,
           case when aggregate and coalesce(retain, 0) <= 0 then 604800 else retain end as retain
    from ({PART_SQL})""")
def defaulting(spark, sf_dir):
    images = dict.fromkeys(("nn_image", "rm_image"), rules.DEFAULT_IMAGE)
    filled = rules.apply_defaults(
        _parts(spark, sf_dir), ["replicas"], images, {"retain": "aggregate"}
    )
    return filled.select("p_partkey", "replicas", "nn_image", "rm_image", "retain")


@query(f"""
    with given as (
        select *, case when p_size % 11 <> 0 then rm_image end as image,
               case when p_size % 11 <> 0 then replicas end as n
        from ({PART_SQL}) join part using (p_partkey))
    select p_partkey, coalesce(n, 1)::INTEGER as namenodes,
           coalesce(nullif(image, ''), 'apache/hadoop:3') as nn_image,
           (case when p_size % 11 = 0 then null
                 when aggregate and coalesce(retain, 0) <= 0 then 604800
                 else retain end)::BIGINT as retain,
           coalesce(case when p_size % 11 <> 0 then namenodes end, 1)::INTEGER as nodemanagers,
           'apache/hadoop:3' as dn_image,
           case when p_size % 2 = 0 then coalesce(nullif(rm_image, ''), 'harisekhon/hbase') end as hbase_image
    from given""")
def cluster_defaults(spark, sf_dir):
    """Parts as clusters; each eleventh size mentions no role, even sizes have an hbase."""
    mentioned = F.col("p_size") % 11 != 0
    namenode = F.struct(
        F.col("replicas").cast("int").alias("replicas"),
        F.col("rm_image").alias("image"),
        F.col("aggregate").alias("log_aggregation"),
        F.col("retain").cast("bigint").alias("retain_seconds"),
    )
    role = "struct<replicas: int, image: string>"
    spec = F.struct(
        F.when(mentioned, namenode).alias("namenode"),
        F.lit(None).cast(role).alias("datanode"),
        F.lit(None).cast(role).alias("resourcemanager"),
        F.when(mentioned, F.struct(F.col("namenodes").cast("int").alias("replicas"), F.lit("").alias("image"))).alias("nodemanager"),
        F.when(F.col("p_size") % 2 == 0, F.struct(F.col("rm_image").alias("image"))).alias("hbase"),
    )
    parts = _parts(spark, sf_dir, "p_size").select("p_partkey", spec.alias("spec"))
    return rules.default_clusters(parts).select(
        "p_partkey",
        F.col("spec.namenode.replicas").alias("namenodes"),
        F.col("spec.namenode.image").alias("nn_image"),
        F.col("spec.namenode.retain_seconds").alias("retain"),
        F.col("spec.nodemanager.replicas").alias("nodemanagers"),
        F.col("spec.datanode.image").alias("dn_image"),
        F.col("spec.hbase.image").alias("hbase_image"),
    )


@query(f"""
    select p_partkey, coalesce(replicas, 1)::INTEGER as executors,
           coalesce(nullif(nn_image, ''), 'apache/hadoop:3') as image,
           case when namenodes > 0 then concat_ws(',', coalesce(nullif(rm_image, ''), 'apache/hadoop:3'), nn_image) end
               as loader_images
    from ({PART_SQL})""")
def application_defaults(spark, sf_dir):
    """Parts as applications; those with namenodes have a loader of two containers."""
    container = [F.struct(F.col(c).alias("image")) for c in ("rm_image", "nn_image")]
    spec = F.struct(
        F.struct(F.col("replicas").cast("int").alias("replicas"), F.col("nn_image").alias("image")).alias("executor"),
        F.when(F.col("namenodes") > 0, F.struct(F.array(*container).alias("containers"))).alias("dataloader"),
    )
    filled = rules.default_applications(_parts(spark, sf_dir).select("p_partkey", spec.alias("spec")))
    return filled.select(
        "p_partkey",
        F.col("spec.executor.replicas").alias("executors"),
        F.col("spec.executor.image").alias("image"),
        F.array_join("spec.dataloader.containers.image", ",").alias("loader_images"),
    )


@query(f"""
    with checked as (
        select *, case when namenodes > 1 then 'namenode allows 1 replica, not ' || namenodes
                       when resourcemanagers > 1
                       then 'resourcemanager allows 1 replica, not ' || resourcemanagers
                       end as error
        from ({PART_SQL}))
    select p_partkey, error, unnest(
               case when error is not null then [null]
                    when nn_image is distinct from 'apache/hadoop:3'
                     and rm_image is distinct from 'apache/hadoop:3'
                    then ['namenode runs another image', 'resourcemanager runs another image']
                    when nn_image is distinct from 'apache/hadoop:3'
                    then ['namenode runs another image']
                    when rm_image is distinct from 'apache/hadoop:3'
                    then ['resourcemanager runs another image']
                    else [null] end) as warning
    from checked""")
def validation(spark, sf_dir):
    checked = rules.validate(
        _parts(spark, sf_dir),
        {"namenode": "namenodes", "resourcemanager": "resourcemanagers"},
        {"resourcemanager": "rm_image", "namenode": "nn_image"},
    )
    return rules.warning_rows(checked, ["p_partkey"])


@query("""
    select p_brand,
           coalesce(sum(case when p_retailprice > 0 and p_retailprice = floor(p_retailprice)
                             then p_retailprice::BIGINT end), 0)::BIGINT as vcores,
           coalesce(sum(case when p_partkey > 0 then p_partkey * 1048576 // 1000000 end),
                    0)::BIGINT as memory_mb,
           count(*) filter (where p_retailprice > 0 and p_retailprice = floor(p_retailprice))
               as cpu_requests,
           count(*) filter (where p_partkey > 0) as memory_requests
    from part group by p_brand""")
def resource_totals(spark, sf_dir):
    specs = table(spark, sf_dir, "part").select(
        "p_brand",
        F.col("p_retailprice").alias("cpu"),
        (F.col("p_partkey") * 1048576).alias("memory"),
    )
    return rules.request_totals(specs, ["p_brand"])


DEFAULTS = [
    ("hdfs-site.xml", "dfs.replication", "2"),
    ("hdfs-site.xml", "dfs.webhdfs.enabled", "true"),
    ("mapred-site.xml", "mapreduce.job.reduces", "7"),
    ("yarn-site.xml", "yarn.acl.enable", "false"),
]

LAYERS_SQL = [
    *[(f, n, "true", f"'{v}'") for f, n, v in DEFAULTS],
    ("hdfs-site.xml", "dfs.namenode.log-aggregation.enable", "c_nationkey % 2 = 0", "'true'"),
    (
        "hdfs-site.xml",
        "dfs.namenode.log-aggregation.retain-seconds",
        "c_nationkey % 2 = 0",
        "'604800'",
    ),
    ("hdfs-site.xml", "dfs.namenode.name.dir", "c_mktsegment = 'BUILDING'", "'/data/' || c_name"),
    ("hdfs-site.xml", "dfs.blocksize", "c_nationkey > 10", "(c_nationkey - 10)::VARCHAR"),
    ("yarn-site.xml", "yarn.nodemanager.resource.cpu-vcores", "c_custkey % 8 > 0",
     "(c_custkey % 8)::VARCHAR"),
    ("yarn-site.xml", "yarn.nodemanager.resource.memory-mb", "c_custkey > 0",
     "(c_custkey * 1048576 // 1000000)::VARCHAR"),
]


@query(
    "with layers as ("
    + " union all ".join(
        f"select c_custkey, {i} as layer, '{f}' as file, '{n}' as name, {v} as value "
        f"from customer where {w}"
        for i, (f, n, w, v) in enumerate(LAYERS_SQL)
    )
    + """)
    select c_custkey, (row_number() over (partition by c_custkey order by layer) - 1)::INTEGER
               as position, file, name, value
    from layers"""
)
def settings_layers(spark, sf_dir):
    clusters = table(spark, sf_dir, "customer")
    spec = {
        "log_aggregation": F.col("c_nationkey") % 2 == 0,
        "retain_seconds": F.lit(rules.DEFAULT_RETAIN_SECONDS),
        "name_dir": F.when(
            F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("/data/"), F.col("c_name"))
        ).otherwise(""),
        "block_size": F.col("c_nationkey") - 10,
        "data_dir": F.lit(""),
        "cpu": (F.col("c_custkey") % 8).cast("double"),
        "memory": F.col("c_custkey") * 1048576,
    }
    return layered_settings(clusters, ["c_custkey"], DEFAULTS, spec_settings(spec))


SORTED_SQL = [
    *LAYERS_SQL[:-3],
    ("hdfs-site.xml", "dfs.blocksize", "c_nationkey > 10", "(c_nationkey - 10)::VARCHAR"),
    ("hdfs-site.xml", "dfs.datanode.data.dir", "c_custkey % 3 = 0", "'/disk/' || c_custkey % 3"),
    ("hdfs-site.xml", "dfs.replication", "c_custkey % 2 = 0", "'3'"),
]


@query(
    "with layers as ("
    + " union all ".join(
        f"select c_custkey, {i} as layer, '{f}' as file, '{n}' as name, {v} as value "
        f"from customer where {w}"
        for i, (f, n, w, v) in enumerate(SORTED_SQL)
    )
    + """)
    select c_custkey, file, name, value,
           row_number() over (partition by c_custkey, file order by name, layer)::INTEGER as place
    from layers"""
)
def settings_sorted(spark, sf_dir):
    """Settings by name within a file; a name that comes again keeps the order of its layers."""
    clusters, custkey = table(spark, sf_dir, "customer"), F.col("c_custkey")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("/data/"), F.col("c_name"))).otherwise("")
    spec = {
        "log_aggregation": F.col("c_nationkey") % 2 == 0,
        "retain_seconds": F.lit(rules.DEFAULT_RETAIN_SECONDS),
        "name_dir": segment,
        "block_size": F.col("c_nationkey") - 10,
        "data_dir": F.when(custkey % 3 == 0, F.concat(F.lit("/disk/"), (custkey % 3).cast("string"))).otherwise(""),
        "cpu": F.lit(0.0),
        "memory": F.lit(0),
    }
    again = Setting("hdfs-site.xml", "dfs.replication", F.when(custkey % 2 == 0, F.lit("3")))
    rows = layered_settings(clusters, ["c_custkey"], DEFAULTS, [*spec_settings(spec), again])
    rows = sorted_settings(rows, ["c_custkey"])
    place = F.row_number().over(Window.partitionBy("c_custkey", "file").orderBy("name", "position"))
    return rows.select("c_custkey", "file", "name", "value", place.alias("place"))


@query("""
    select o_orderkey, case when o_orderkey % 7 <> 0 then o_custkey % 3 end as live,
           o_orderkey % 7 <> 0 and o_custkey % 3 > 0 as ready
    from orders""")
def report_health(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(
        F.concat(F.lit("Live datanodes ("), (F.col("o_custkey") % 3).cast("string"), F.lit("):"))
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", text.alias("report"))
        .select(
            "o_orderkey",
            rules.live_nodes(F.col("report")).alias("live"),
            rules.storage_ready(F.col("report")).alias("ready"),
        )
    )


# --- Change feed -----------------------------------------------------------------------------

FEED_SQL = r"""
    select event_id, ts, user_id,
           case event_type when 'signup' then 'create' when 'error' then 'delete'
                else 'update' end as op,
           ['Pod', 'Service', 'ConfigMap', 'StatefulSet', 'Cluster', 'Secret'][k % 6 + 1] as kind,
           case when k % 5 <> 0 then 'datanode' else '' end as role,
           event_id as rv_new, event_id - case when k % 7 = 0 then 0 else 1 end as rv_old,
           case when k % 3 <> 0 then user_id * 10 + case when k % 11 = 0 then 1 else 0 end end
               as new_uid,
           case when k % 4 <> 0 then user_id * 10 + case when k % 13 = 0 then 1 else 0 end end
               as old_uid
    from (select *, regexp_extract(props, '(\d+)', 1)::INTEGER as k from events)"""

RELEVANT_SQL = f"""
    with feed as ({FEED_SQL}),
    owners as (select c_custkey * 10 as uid from customer)
    select event_id, op, kind from feed
    where case op when 'update'
          then rv_old <> rv_new and kind <> 'Secret'
               and ((new_uid in (select uid from owners))
                    or (old_uid is distinct from new_uid and old_uid in (select uid from owners)))
          when 'create' then role <> '' and (new_uid is null or kind not in ('Cluster', 'Secret'))
          else role <> '' and (old_uid is null or kind not in ('Cluster', 'Secret')) end"""


def _feed(events: DataFrame) -> DataFrame:
    k = _k()

    def owner(uid, present):
        ref = F.struct(
            F.lit("Cluster").alias("kind"),
            F.col("user_id").cast("string").alias("name"),
            uid.cast("string").alias("uid"),
            F.lit(True).alias("controller"),
        )
        return F.when(present, ref)

    user, event = F.col("user_id"), F.col("event_type")
    op = F.when(event == "signup", "create").when(event == "error", "delete").otherwise("update")
    kinds = F.array(*[F.lit(x) for x in (*changes.UPDATE_KINDS, "Secret")])
    new = owner(user * 10 + F.when(k % 11 == 0, 1).otherwise(0), k % 3 != 0)
    old = owner(user * 10 + F.when(k % 13 == 0, 1).otherwise(0), k % 4 != 0)
    return events.select(
        "event_id",
        "ts",
        "user_id",
        op.alias("op"),
        F.element_at(kinds, k % 6 + 1).alias("kind"),
        F.lit("default").alias("namespace"),
        F.concat(F.lit("object-"), user.cast("string")).alias("name"),
        F.when(k % 5 != 0, "datanode").otherwise("").alias("role"),
        F.col("event_id").alias("rv_new"),
        (F.col("event_id") - F.when(k % 7 == 0, 0).otherwise(1)).alias("rv_old"),
        F.when(op != "delete", new).alias("new_owner"),
        F.when(op != "create", old).alias("old_owner"),
    )


def _owners(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.lit("Cluster").alias("kind"),
        F.lit("default").alias("namespace"),
        key.cast("string").alias("name"),
        (key * 10).cast("string").alias("uid"),
    )


@query(RELEVANT_SQL)
def feed_filter(spark, sf_dir):
    feed = _feed(table(spark, sf_dir, "events"))
    relevant = changes.relevant_changes(feed, _owners(spark, sf_dir))
    return relevant.select("event_id", "op", "kind")


@query(RELEVANT_SQL)
def feed_filter_stream(spark, sf_dir):
    """The filter on a stream without state; a change that was written twice counts once."""
    target, checkpoint = shared_folder(spark, "feed"), shared_folder(spark, "checkpoint")
    events = _event_stream(spark, sf_dir)
    feed = _feed(events)
    owners = _owners(events.sparkSession, sf_dir)
    relevant = changes.relevant_changes(feed, owners).select("event_id", "op", "kind")
    feeds.write_batches(relevant, target, checkpoint, mode="append").awaitTermination()
    return feeds.read_batches(spark, target, relevant.schema).drop("batch").distinct()


KINDS_SQL = f"""
    with feed as (
        select event_id, op, kind, role, rv_old, rv_new, k, new_uid, old_uid,
               k % 5 <> 1 as controls, case when k % 9 = 0 then 'Application' else 'Cluster' end as owner_kind,
               case when controls then new_uid end as new_ref, old_uid as old_ref
        from ({FEED_SQL}) join (select event_id, regexp_extract(props, '(\\d+)', 1)::INTEGER as k from events) using (event_id)),
    owners as (select c_custkey * 10 as uid, case when c_custkey % 9 = 0 then 'Application' else 'Cluster' end as kind from customer)
    select event_id, op, kind from feed
    where op = 'update' and rv_old <> rv_new and kind <> 'Secret'
        and ((new_ref, owner_kind) in (select (uid, kind) from owners)
             or ((old_ref is distinct from new_ref or owner_kind <> 'Cluster')
                 and coalesce(case when new_ref is not null then owner_kind end, 'Cluster') = 'Cluster'
                 and (old_ref, 'Cluster') in (select (uid, kind) from owners)))"""


@query(KINDS_SQL)
def feed_filter_of_kinds(spark, sf_dir):
    """Updates whose owner is of two kinds, and not always the controller."""
    def owner(ref, kind, controls):
        fields = {"kind": kind, "name": ref["name"], "uid": ref["uid"], "controller": controls}
        return F.when(ref.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))

    k = _k()
    kind = F.when(k % 9 == 0, "Application").otherwise("Cluster")
    events = table(spark, sf_dir, "events")
    marks = events.select(F.col("event_id").alias("_id"), (k % 5 != 1).alias("_controls"), kind.alias("_kind"))
    feed = _feed(events).where("op = 'update'").join(marks, F.col("event_id") == F.col("_id"))
    feed = feed.withColumn("new_owner", owner(F.col("new_owner"), F.col("_kind"), F.col("_controls"))).drop("_id", "_controls", "_kind")
    owners = _owners(spark, sf_dir).withColumn("kind", F.when(F.col("name").cast("long") % 9 == 0, "Application").otherwise("Cluster"))
    return changes.relevant_updates(feed, owners).select("event_id", "op", "kind")


CHANGED_SQL = r"""
    with log as (
        select *, lag(event_type) over w as old_type, lag(k) over w as old_k,
               lag(event_id) over w is null as is_first
        from (select *, regexp_extract(props, '(\d+)', 1)::INTEGER as k from events)
        window w as (partition by user_id order by ts, event_id))
    select event_id, user_id, event_type is distinct from old_type as type_changed,
           (is_first or event_type <> old_type or k % 4 <> old_k % 4) as labels_changed,
           concat_ws(',',
               case when event_type is distinct from old_type then 'type' end,
               case when is_first or event_type <> old_type or k % 4 <> old_k % 4
                    then 'labels' end) as fields
    from log"""


def _versions(spark, sf_dir, min_rows=MIN_ROWS):
    """Events as versions of their user's object, each with the version before it."""
    state = F.create_map(
        F.lit("type"), F.col("event_type"), F.lit("group"), (_k() % 4).cast("string")
    )
    versions = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", state.alias("labels")
    )
    columns = ["event_type", "labels"]
    return with_previous(versions, ["user_id"], ["ts", "event_id"], columns, min_rows=min_rows)


def _changed_fields(versions):
    pairs = {
        "type": ("prev.event_type", "event_type"),
        "labels": ("prev.labels", "labels"),
    }
    return versions.select(
        "event_id",
        "user_id",
        changes.changed(versions, {"prev.event_type": "event_type"}).alias("type_changed"),
        changes.changed(versions, {"prev.labels": "labels"}).alias("labels_changed"),
        F.array_join(changes.changed_fields(versions, pairs), ",").alias("fields"),
    )


@query(CHANGED_SQL)
def changed_fields(spark, sf_dir):
    return _changed_fields(_versions(spark, sf_dir))


@query(CHANGED_SQL)
def changed_fields_sliced(spark, sf_dir):
    """The same with the log of every user of more than 4 events cut into slices."""
    return _changed_fields(_versions(spark, sf_dir, 4))


FAN_IN_SQL = f"""
    select distinct 'Cluster' as kind, user_id::VARCHAR as name
    from ({FEED_SQL}) where op <> 'delete' and new_uid is not null"""


@query(FAN_IN_SQL)
def owner_fan_in(spark, sf_dir):
    feed = _feed(table(spark, sf_dir, "events"))
    return changes.owners_to_revisit(feed, ["new_owner.kind", "new_owner.name"])


@query(FAN_IN_SQL)
def owner_fan_in_stream(spark, sf_dir):
    """Distinct owners per micro-batch; across batches they are made distinct here."""
    target, checkpoint = shared_folder(spark, "fan-in"), shared_folder(spark, "checkpoint")
    feed = _feed(_event_stream(spark, sf_dir))
    keys = ["new_owner.kind", "new_owner.name"]
    feeds.write_owners_to_revisit(feed, keys, target, checkpoint).awaitTermination()
    found = feeds.read_batches(spark, target, "kind STRING, name STRING")
    return found.select("kind", "name").distinct()


def _arriving(spark, pieces, start):
    """Runs a stream once for each piece of its input, as the piece arrives; ``start`` gets the
    stream and returns its query, which goes on from where the last one ended."""
    folder = shared_folder(spark, "arriving")
    for piece in pieces:
        piece.write.mode("append").parquet(folder)
        start(spark.readStream.schema(piece.schema).parquet(folder)).awaitTermination()


@query(RELEVANT_SQL)
def feed_once_stream(spark, sf_dir):
    """The filter on a feed whose changes come again one batch and two batches later."""
    events = table(spark, sf_dir, "events")
    early = F.col("user_id") % 2 == 0
    replayed = events.where(early & (F.col("event_id") % 5 == 0))
    pieces = [events.where(early), events.where(~early).unionByName(replayed), events.where(F.col("event_id") % 3 == 0)]
    path, checkpoint = shared_folder(spark, "once"), shared_folder(spark, "checkpoint")
    owners = _owners(spark, sf_dir)

    def relevant(batch):
        return changes.relevant_changes(batch, owners).select("event_id", "op", "kind")

    _arriving(spark, pieces, lambda s: ledger.write_once(_feed(s), ["name", "rv_new"], path, checkpoint, relevant))
    return feeds.read_batches(spark, f"{path}/rows", "event_id BIGINT, op STRING, kind STRING").drop("batch")


@query(CHANGED_SQL)
def changed_fields_stream(spark, sf_dir):
    """Changed fields of versions that come in four batches, not in their order."""
    state = F.create_map(F.lit("type"), F.col("event_type"), F.lit("group"), (_k() % 4).cast("string"))
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    versions = events.select("event_id", "ts", "user_id", "event_type", state.alias("labels"))
    path, checkpoint = shared_folder(spark, "versions"), shared_folder(spark, "checkpoint")
    keys, order = ["user_id"], ["ts", "event_id"]
    pieces = [versions.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i) for i in range(4)]
    _arriving(
        spark, pieces,
        lambda s: maintain_previous(s, keys, order, ["event_type", "labels"], path, checkpoint),
    )
    return _changed_fields(read_previous(spark, path, keys, order))


@query(f"select o_orderkey, role, active from ({ACTIVE_SQL})")
def active_replicas_stream(spark, sf_dir):
    """Replica counts kept from a feed: objects are born under a wrong owner, in a wrong role or
    not ready, and mended later; others are born, replaced and deleted."""
    objects = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("owner"),
        F.col("l_returnflag").alias("role"),
        F.when(F.col("l_linestatus") == "O", "True").otherwise("False").alias("ready"),
        F.when(F.col("l_quantity") < 5, F.col("l_shipdate")).alias("deleted_at"),
        (F.col("l_partkey") % 5).alias("k"),
        (F.col("l_suppkey") % 3).alias("g"),
    )

    def state(owner, role, phase, ready, deleted_at):
        conditions = F.array(F.struct(F.lit("Ready").alias("type"), ready.alias("status")))
        units = replicas.active_units(phase, conditions, deleted_at)
        return F.struct(owner.alias("owner"), role.alias("role"), units.alias("active"))

    k, running = F.col("k"), F.lit("Running")
    now = state(F.col("owner"), F.col("role"), running, F.col("ready"), F.col("deleted_at"))
    born = state(
        F.when(k == 1, F.col("owner") + 1).otherwise(F.col("owner")),
        F.when(k == 2, "N").otherwise(F.col("role")),
        F.when(k == 3, "Pending").otherwise(running),
        F.when(k == 4, "False").otherwise(F.col("ready")),
        F.col("deleted_at"),
    )
    alive = state(F.col("owner"), F.col("role"), running, F.lit("True"), F.lit(None).cast("date"))
    none = F.lit(None).cast(objects.select(born).schema[0].dataType)
    ghosts = objects.where("g = 0")
    change = lambda rows, old, new: rows.select(old.alias("old"), new.alias("new"))
    pieces = [
        change(objects, none, born).unionByName(change(ghosts, none, alive)),
        change(objects.where("k > 0 and k < 3"), born, now),
        change(objects.where("k >= 3"), born, now).unionByName(change(ghosts, alive, none)),
    ]
    path, checkpoint = shared_folder(spark, "counts"), shared_folder(spark, "checkpoint")
    keys = {c: (F.col(f"old.{c}"), F.col(f"new.{c}")) for c in ("owner", "role")}
    counts = F.col("old.active"), F.col("new.active")
    _arriving(spark, pieces, lambda s: ledger.keep_counts(s, keys, counts, path, checkpoint))
    kept = KeyedTable(path, ("owner", "role")).read(spark)
    roles = _orders(spark, sf_dir).select("o_orderkey", F.explode(F.array(*map(F.lit, FLAGS))).alias("role"))
    if kept is None:
        return roles.withColumn("active", F.lit(0).cast("long"))
    kept = kept.select(F.col("owner").alias("o_orderkey"), "role", F.col("n").alias("active"))
    return roles.join(kept, ["o_orderkey", "role"], "left").withColumn("active", F.coalesce("active", F.lit(0)))


@query("""
    select o_orderkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as status,
           case when o_orderkey % 10 = 0 then 2 else 1 end::BIGINT as writes
    from orders""")
def status_write_back(spark, sf_dir):
    """Statuses written three times: all, the same again, and with a tenth of them changed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    target = KeyedTable(shared_folder(spark, "status"), ("o_orderkey",))
    changed = F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))
    for number, rows in enumerate((orders, orders, orders.withColumn("o_orderstatus", changed))):
        ledger.write_differing(target, rows.withColumnRenamed("o_orderstatus", "status"), number)
    writes = spark.read.parquet(f"{target.path}/delta").groupBy("o_orderkey").agg(F.count("*").alias("writes"))
    return target.read(spark).join(writes, "o_orderkey")


# --- Training-data operators, where their subpackage is installed -----------------------------

try:
    import corpus_pipeline
    from muster.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    # Only their own absence is passed over, not that of something they need.
    if missing.name not in {"muster.llm", "muster.llm.queries", "corpus_pipeline"}:
        raise
else:
    QUERIES |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    SQL |= llm_queries.SQL



def entry(spark: SparkSession) -> DataFrame:
    """Word count over the smallest tables."""
    return word_count(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
