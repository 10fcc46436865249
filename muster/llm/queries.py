"""The operators of this package as registered queries, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import chunks, conversations, licenses, mixing, negatives, neighbours, packing, simhash, suffixes, surrogates, toxicity, urls, vectors

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


@query()
def op1_packing(spark, sf_dir):
    return packing.pack(spark, table(spark, sf_dir, "documents"))


@query()
def op2_simhash(spark, sf_dir):
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op3_cross_polytope(spark, sf_dir):
    return neighbours.search(spark, table(spark, sf_dir, "embeddings"))


MIX_SQL = rf"""
    with sized as (
        select doc_id, source,
            coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size,
            md5('{mixing.SEED}:' || doc_id::VARCHAR) as draw
        from documents),
    sources as (
        select source, sum(size)::BIGINT as source_size,
            [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::INTEGER] as weight
        from sized group by source),
    filled as (
        select *, (source_size * 2)::DOUBLE as cap, cap / weight as full_at,
            sum(source_size) over () as total, sum(weight) over () as weights
        from sources),
    levels as (
        select *, (total * 1.5::DOUBLE - coalesce(sum(cap) over before, 0)) / (weights - coalesce(sum(weight) over before, 0)) as level
        from filled
        window before as (order by full_at, source nulls last rows between unbounded preceding and 1 preceding)),
    targets as (
        select source, source_size,
            least(cap, weight * max(level) filter (level <= full_at) over ()) as target,
            case when source_size > 0 then floor(round(target) / source_size) else 0 end::BIGINT as whole
        from levels)
    select doc_id, size, source_size, target,
        (whole * size + greatest(0, least(size,
            round(target)::BIGINT - whole * source_size
            - sum(size) over (partition by source order by draw, doc_id, size rows unbounded preceding) + size)))::BIGINT as taken
    from sized join targets using (source)"""


@query(MIX_SQL)
def op4_mixing(spark, sf_dir):
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"))
    rows = mixed.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(spark, docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


SUFFIX_SQL = """
    with texts as (
        select doc_id, coalesce(hex(encode(text)), '') as h, len(h) // 2 as n_bytes from documents),
    strings as (
        select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as digest
        from (select doc_id, h, unnest(range(n_bytes - 199)) as i from texts where n_bytes >= 200)),
    repeated as (select doc_id, i from strings qualify count(*) over (partition by digest) > 1),
    marked as (
        select *, coalesce(i - lag(i) over (partition by doc_id order by i) > 200, true) as new from repeated),
    numbered as (
        select *, sum(new::INTEGER) over (partition by doc_id order by i rows unbounded preceding) as span from marked),
    spans as (
        select doc_id, min(i) as a, max(i) + 200 as b from numbered group by doc_id, span),
    gaps as (
        select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as last_b from spans),
    cut as (
        select doc_id, sum(b - a)::BIGINT as n_removed, count(*) as n_spans,
            string_agg(substr(h, 2 * last_b + 1, 2 * (a - last_b)), '' order by a)
                || substr(any_value(h), 2 * max(b) + 1) as kept
        from gaps join texts using (doc_id) group by doc_id)
    select doc_id, n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
        sha256(unhex(coalesce(kept, h))) as kept_sha256
    from texts left join cut using (doc_id)"""


@query(SUFFIX_SQL)
def op6_suffix_array(spark, sf_dir):
    found = suffixes.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query()
def op7_surrogates(spark, sf_dir):
    return surrogates.replace_entities(spark, table(spark, sf_dir, "documents"))


@query()
def op8_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


VECTOR_SQL = """
    with recursive usable as (
        select vec_id, label, embedding::DOUBLE[] as v from embeddings
        where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
            and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (
        select a.vec_id as a, b.vec_id as b
        from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
        where list_cosine_similarity(a.v, b.v) >= 0.98),
    reached as (
        select a, b from links
        union
        select r.a, l.b from reached r join links l on r.b = l.a),
    least as (select a, min(b) as b from reached group by a),
    counted as (select a, count(*) as n from links group by a)
    select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(b, vec_id)) as component_id,
        vec_id = least(vec_id, coalesce(b, vec_id)) as kept
    from embeddings left join least on least.a = vec_id left join counted on counted.a = vec_id"""


@query(VECTOR_SQL)
def op9_multi_index(spark, sf_dir):
    return vectors.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


@query()
def op10_chunks(spark, sf_dir):
    found = chunks.deduplicate(spark, table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


NEGATIVE_SQL = """
    with usable as (
        select row_number() over () as node, vec_id,
            case when vec_id % 7 = 0 then (label::BIGINT + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) as q
        from embeddings
        where vec_id is not null and label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    scores as (
        select a.node, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
            coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::BIGINT as score
        from usable a join usable b on a.node <> b.node and len(a.q) = len(b.q)
        where a.vec_id % 100 = 0),
    positives as (
        select *, row_number() over (partition by node order by score desc, vec_id) as place
        from scores where same qualify place <= 5),
    negatives as (
        select p.node, p.anchor_id, p.place, p.vec_id as positive_id, n.vec_id as negative_id,
            p.score as positive_score, n.score as negative_score,
            row_number() over (partition by p.node, p.place order by n.score desc, n.vec_id) as rank
        from positives p join scores n using (node)
        where not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
        qualify rank <= 5)
    select anchor_id, positive_id, rank::INTEGER as rank, negative_id, positive_score, negative_score
    from negatives"""


@query(NEGATIVE_SQL)
def op11_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(spark, table(spark, sf_dir, "embeddings").withColumn("label", changed))


def _way(state: int, cost: int, audit: str, line: str = "''") -> str:
    """SQL for one more edit on the way to a state; a truncated row that stays costs 5 more."""
    stays = "" if audit == "D" else " + p.extra"
    return f"{{'c': w[{state + 1}].c + {cost}{stays}, 'a': w[{state + 1}].a || '{audit}', 'r': w[{state + 1}].r || {line}}}"


def _ways(after: int) -> str:
    """SQL for the best way to state `after` with the row p, from the ways w to each state."""
    kept = "chr(10) || p.role || ':' || p.text"
    same = _way(after, 2, "D")
    if after == 0:
        return f"[{same}]"
    if after == 1:
        return f"list_filter([{same}, case when p.i = 's' then {_way(0, 0, 'K', kept)} end], lambda x: x is not null)"
    name, other = ("user", "assistant") if after == 2 else ("assistant", "user")
    line, missing = f"chr(10) || '{name}:' || p.text", f"chr(10) || '{other}:' || "
    before, far = ([0, 1, 3], [2]) if after == 2 else ([2], [0, 1, 3])
    near = [(s, 0, "", "") for s in before] + [(s, 5, "I", missing) for s in far]
    ways = [same, *(_way(s, 1 + c, f"{i}R", m + line) for s, c, i, m in near)]
    keep = [f"case when p.i = '{name[0]}' then {_way(s, c, f'{i}K', m + kept)} end" for s, c, i, m in near]
    return f"list_filter([{', '.join(ways + keep)}], lambda x: x is not null)"


REPAIR_SQL = rf"""
    with recursive bits(i, c, k) as (
        select range, range, 0 from range(256)
        union all
        select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
    named as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') as s
        from conversations),
    sums(s, k, c) as (
        select distinct s, 0, 4294967295 from named
        union all
        select s, sums.k + 1, xor(bits.c, sums.c >> 8)
        from sums join bits on bits.k = 8 and bits.i = xor(sums.c, ascii(s[sums.k + 1])) & 255
        where sums.k < length(s)),
    kinds as (select s, xor(c, 4294967295) % 20 as kind from sums where k = length(s)),
    damaged as (
        select conv_id, turn, case when kind = 4 then 'user' else role end as role,
            case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
            unnest(range(case when kind = 3 then 2 else 1 end)) as copy
        from named join kinds using (s) where kind <> 0),
    placed as (
        select *, left(role, 1) as i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as tail,
            row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
            row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as again
        from damaged),
    judged as (
        select *, tail = '' as blank, tail <> '' and again as duplicate,
            tail <> '' and not again and right(tail, 1) not in ('.', '!', '?') as truncated,
            case when truncated then 5 else 0 end as extra,
            coalesce(lag(i) over (partition by conv_id order by k) || i not in ('su', 'ua', 'au'), false) as illegal
        from placed),
    best(conv_id, k, w) as (
        select distinct conv_id, 0::BIGINT, [
            {{'c': 0::BIGINT, 'a': '', 'r': ''}}, {{'c': 1000000000::BIGINT, 'a': '', 'r': ''}},
            {{'c': 1000000000::BIGINT, 'a': '', 'r': ''}}, {{'c': 1000000000::BIGINT, 'a': '', 'r': ''}}]
        from conversations
        union all
        select w.conv_id, p.k,
            case when blank or duplicate then list_transform(w, lambda x: {{'c': x.c + 2, 'a': x.a || 'D', 'r': x.r}})
            else [{", ".join(f"list_min({_ways(s)})" for s in range(4))}] end
        from best w join judged p on p.conv_id is not distinct from w.conv_id and p.k = w.k + 1),
    ended as (
        select conv_id, list_min([
            w[1], w[4], {{'c': w[3].c + 5, 'a': w[3].a || 'I', 'r': w[3].r || chr(10) || 'assistant:'}},
            {{'c': w[2].c + 10, 'a': w[2].a || 'II', 'r': w[2].r || chr(10) || 'user:' || chr(10) || 'assistant:'}}]) as x
        from best qualify k = max(k) over (partition by conv_id)),
    counted as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank,
            count_if(duplicate) as duplicate, count_if(truncated) as truncated, count_if(illegal) as illegal
        from judged group by conv_id)
    select e.conv_id, coalesce(gaps, 0)::BIGINT as gaps, coalesce(blank, 0)::BIGINT as blank,
        coalesce(duplicate, 0)::BIGINT as duplicate, coalesce(truncated, 0)::BIGINT as truncated,
        coalesce(illegal, 0)::BIGINT as illegal, x.c as cost, x.a as audit, sha256(substr(x.r, 2)) as repaired_sha256
    from ended e left join counted c on e.conv_id is not distinct from c.conv_id"""


@query(REPAIR_SQL)
def op12_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    pieces = conversations.repair(spark, conversations.damage(given), given)
    return pieces.where("last").drop("piece", "last", "rows")


#: Host, path and verdict of the listed rules.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

URL_SQL = rf"""
    with split as (
        select page_id, url,
            coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
        from pages),
    listed(h, p, v) as (values {", ".join(map(str, URL_RULES))}),
    parts as (
        select *, row_number() over () as n,
            array_to_string(list_sort(list_distinct(list_transform(string_split(
                regexp_extract(regexp_extract(url, '(?s)://(.*)', 1), '(?s)^[^?#]*\?([^#]*)', 1), '&'),
                lambda x: string_split(x, '=')[1]))), ',') as params,
            string_split(host, '.') as names,
            (select max_by(h || p, length(h || p)) from listed
                where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as rule
        from split),
    read as (
        select *, (select v from listed where h || p = rule) as listed_verdict,
            list_filter([
                nullif('dir=' || regexp_extract(path, '(?s)^/([^/]+)', 1), 'dir='),
                nullif('domain=' || array_to_string(names[-2:], '.'), 'domain='),
                nullif('host=' || host, 'host='),
                nullif('leaf=' || regexp_replace(regexp_extract(path, '(?s)([^/]+)/*$', 1), '[0-9]+', '0', 'g'), 'leaf='),
                nullif('params=' || params, 'params='),
                nullif('scheme=' || regexp_extract(url, '(?s)^(.*?)://', 1), 'scheme='),
                nullif('sub=' || names[1], 'sub='),
                nullif('tld=' || names[-1], 'tld=')], lambda x: x is not null) as tokens
        from parts),
    labelled as (
        select tokens, listed_verdict as verdict, count(*) over () as total from read where rule is not null),
    sets as (
        select list_filter(tokens, lambda x, i: (m >> (i - 1)) % 2 = 1) as held, verdict, total
        from (select *, unnest(range(1, 1 << len(tokens))) as m from labelled)),
    counted as (
        select held, verdict, any_value(total) as total, count(*) as n,
            sum(count(*)) over (partition by held) as of_all
        from sets group by held, verdict),
    strong as (
        select held, verdict, n / of_all as confidence, n / total as support
        from counted
        where n >= ceil({urls.MIN_SUPPORT}::DOUBLE * total) and n / of_all >= {urls.MIN_CONFIDENCE}::DOUBLE),
    rules as (
        select *, array_to_string(held, chr(31)) as name from strong a
        where not exists (
            select 1 from strong b where b.verdict = a.verdict and len(b.held) < len(a.held)
                and b.confidence >= a.confidence and list_has_all(a.held, b.held))),
    mined as (
        select n, max_by(r.verdict, {{'c': confidence, 's': support, 'k': len(held), 'name': name}}) as verdict
        from read join rules r on list_has_all(tokens, held) where rule is null group by n)
    select page_id, host, path, rule, coalesce(listed_verdict, mined.verdict, 'allow') as verdict
    from read left join mined using (n)"""


@query(URL_SQL)
def op13_url_rules(spark, sf_dir):
    return urls.judge(spark, table(spark, sf_dir, "pages"), URL_RULES)
