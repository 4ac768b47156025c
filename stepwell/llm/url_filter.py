"""URL filters: host-suffix and path-prefix expressions, matched to rules by short hash prefix, then by full digest.

Main path: DataFrame functions only. A url is expanded into one expression for each *shape* of rule there is
(labels of its host, characters of its path), so the work for a url follows the number of different shapes, not the
number of rules nor the length of the url. Expressions meet the rules in an equi-join on the first 8 hex digits of
their SHA-256; the whole digest confirms; the longest rule wins (ties: longer host, then block, then the rule's text).

Defined results: a url that is null, empty or lacks ``://`` has an empty host and path, no rule and the default
verdict. Rows with equal urls or ids each get their own result row. An empty table gives an empty result. Columns of
the input besides the id and the url are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import LOWER, UPPER

#: Rules given as a list are broadcast up to this many (under 4 MB); beyond it the join shuffles both sides.
BROADCAST_RULES = 20_000
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    got = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows; hosts are lower-cased, repeated rules count once."""
    clean = sorted({(h.translate(str.maketrans(UPPER, LOWER)), p, v) for h, p, v in rules})
    return spark.createDataFrame(clean, "rule_host string, rule_path string, rule_verdict string")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], id_column: str = "page_id", url_column: str = "url", default: str = "allow"
) -> DataFrame:
    """One row for each row of pages: id, host, path, rule (host + path of the winner, or null), verdict."""
    table = rules_table(pages.sparkSession, rules)
    table = table.select(
        F.concat("rule_host", "rule_path").alias("rule"),
        "rule_verdict",
        F.length("rule_host").alias("host_length"),
        F.sha2(F.concat("rule_host", "rule_path").cast("binary"), 256).alias("rule_digest"),
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})

    urls = pages.select(F.col(id_column).alias("id"), url_host(F.col(url_column)).alias("host"), url_path(F.col(url_column)).alias("path"))
    if not shapes:
        return urls.select(F.col("id").alias(id_column), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    expressions = F.array_distinct(
        F.array(*[F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length)) for labels, length in shapes])
    )
    digests = (
        urls.where("host <> ''")
        .select("host", "path", F.explode(expressions).alias("expression"))
        .select("host", "path", F.sha2(F.col("expression").cast("binary"), 256).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    # Partial aggregation leaves one row for each different (host, path) of a task before anything is shuffled.
    best = (
        digests.join(table, "prefix")
        .where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(F.length("rule").alias("n"), "host_length", (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict")
            ).alias("best")
        )
    )
    # A third key, which the aggregate isn't dealt by: so both sides get a plain exchange, of which adaptive execution
    # splits the part of a url that very many rows hold. Urls without a host, which no rule fits, are spread by their id.
    spread = F.xxhash64("host", "path")
    urls = urls.withColumn("spread", F.when(F.col("host") == "", F.xxhash64("id")).otherwise(spread))
    return urls.join(best.withColumn("spread", spread), ["host", "path", "spread"], "left").select(
        F.col("id").alias(id_column),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
