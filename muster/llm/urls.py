"""URL filtering: listed rules, and association rules mined from the urls that they judge.

A listed rule names a host and the beginning of a path; the longest one that fits decides.
Urls that a listed rule has judged are labelled, and become baskets of tokens (one of each
kind, see tokens()) with their verdict as one more item. FP-growth finds the token
combinations that are frequent among them; those that point to one verdict with enough
confidence are kept, unless a part of the combination does so no less. An inverted index
from each kept combination's rarest token finds the combinations that another url holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.common import written

#: Share of the labelled urls that hold a combination with its verdict, and share of those
#: holding the combination that have the verdict.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9
DEFAULT = "allow"
#: Marks the item that is a verdict; tokens begin with their kind.
VERDICT = "verdict="
#: Between the tokens of a basket's or combination's name.
SEP = "\x1f"


def host(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or hash, A-Z in small letters."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, ascii_uppercase, ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest of the rules (host, path, verdict) that fits, else null.

    One CASE from the longest rule to the shortest: no join, no shuffle.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """A url's tokens, sorted, at most one of each kind, so that a basket has 2**8 parts at most.

    Kinds: scheme, tld, domain (the last two labels), sub (the first label), host, dir (the
    first part of the path), leaf (the last one, each run of digits as 0) and params (the
    names in the query, sorted).
    """
    query = F.regexp_extract(F.regexp_extract(url, r"(?s)://(.*)", 1), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    parts = {
        "dir": F.regexp_extract(path, "(?s)^/([^/]+)", 1),
        "domain": F.substring_index(host, ".", -2),
        "host": host,
        "leaf": F.regexp_replace(F.regexp_extract(path, "(?s)([^/]+)/*$", 1), "[0-9]+", "0"),
        "params": F.array_join(F.array_sort(F.array_distinct(names)), ","),
        "scheme": F.regexp_extract(url, "(?s)^(.*?)://", 1),
        "sub": F.substring_index(host, ".", 1),
        "tld": F.substring_index(host, ".", -1),
    }
    kinds = [F.when(part != "", F.concat(F.lit(f"{kind}="), part)) for kind, part in parts.items()]
    return F.array_compact(F.array(*kinds))


def mine(
    spark: SparkSession, labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Rules (tokens, size, verdict, confidence, support, key) from labelled(tokens, verdict).

    key is the rarest of a rule's tokens. A rule is dropped if some of its tokens alone
    point to the same verdict with no less confidence. There are at most 2**8 / min_support
    rules, whatever the table's size. No labelled rows give no rules.
    """
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(minSupport=min_support, minConfidence=min_confidence).fit(items)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = model.associationRules.where(F.col("consequent")[0].startswith(VERDICT)).select(
        F.array_sort("antecedent").alias("tokens"),
        F.size("antecedent").alias("size"),
        F.substring(F.col("consequent")[0], len(VERDICT) + 1, 1 << 30).alias("verdict"),
        "confidence",
        "support",
    )
    rules = written(spark, rules.withColumn("name", F.array_join("tokens", SEP)), "rules")
    # Every proper part of a rule's tokens, by the bits of a number.
    chosen = "transform(sequence(1, greatest(1, (1 << size) - 2)), m -> array_join(filter(tokens, (x, i) -> (m >> i) % 2 = 1), '\u001f'))"
    parts = rules.where("size > 1").select("name", "verdict", "confidence", F.explode(F.expr(chosen)).alias("part"))
    shorter = rules.select(F.col("name").alias("part"), "verdict", F.col("confidence").alias("general"))
    needless = parts.join(shorter, ["part", "verdict"]).where("general >= confidence").select("name", "verdict").distinct()
    rules = rules.join(needless, ["name", "verdict"], "left_anti")
    rarest = (
        rules.select("name", F.explode("tokens").alias("token"))
        .join(single, "token")
        .groupBy("name")
        .agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    )
    return written(spark, rules.join(rarest, "name"), "index")


def held_rules(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """(basket, verdict): the verdict of the best rule that each basket(basket, tokens) holds.

    The index is entered by a rule's key alone, then the whole rule is looked for in the
    basket. Best is the highest confidence, then support, then size, then name.
    """
    entries = baskets.select("basket", "tokens", F.explode("tokens").alias("key"))
    index = rules.select("key", F.col("tokens").alias("held"), "size", "verdict", "confidence", "support", "name")
    met = entries.join(index, "key").where(F.size(F.array_except("held", "tokens")) == 0)
    order = F.struct("confidence", "support", "size", "name")
    return met.groupBy("basket").agg(F.max_by("verdict", order).alias("verdict"))


def judge(
    spark: SparkSession,
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages(page_id, url).

    rules: (host, path, verdict), each for its host and all subdomains and paths that begin
    with its path. rule names the longest one that fits, and is null if none does; then the
    verdict is that of the best mined rule that the url holds, else DEFAULT. A url that is
    null, empty or without :// has an empty host and path, no tokens but perhaps none, and
    gets DEFAULT. Urls of any length are read whole. Repeated rows are judged each, and
    count each when rules are mined. page_id may be null or repeated. No rows give no rows;
    extra columns are not looked at.

    The page's columns are read twice, for judged urls and for others. Urls of equal tokens
    are one basket; only baskets meet the index. Verdicts join back to the pages: Spark
    broadcasts them below its size threshold, and splits a hot basket beyond it.
    """
    read = pages.select("page_id", "url").select(
        "page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")
    )
    rule, verdict = listed(rules, F.col("host"), F.col("path"))
    read = read.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"),
        tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
    )
    mined = mine(spark, read.where("rule is not null").select("tokens", "verdict"), min_support, min_confidence)
    rest = read.where("rule is null").withColumn("basket", F.coalesce(F.array_join("tokens", SEP), F.lit("")))
    baskets = rest.groupBy("basket").agg(F.first("tokens").alias("tokens"))
    found = held_rules(baskets, mined).hint("rebalance")  # so that the join may split a hot basket
    rest = rest.drop("verdict").join(found, "basket", "left")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    rest = rest.withColumn("verdict", F.coalesce("verdict", F.lit(DEFAULT)))
    return read.where("rule is not null").select(*columns).unionByName(rest.select(*columns))
