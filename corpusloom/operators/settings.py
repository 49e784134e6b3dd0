"""Layered settings as tables: entries over providers over defaults, with validation and credential lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S
from corpusloom.operators import relational

KINDS = ["openai"]
STRUCTURED = ["json_schema", "json_object", "prompt"]


def merged_maps(upper: Column, lower: Column) -> Column:
    """Keys of both maps; the upper one wins and null values do not count."""
    set_ = F.map_filter(F.coalesce(upper, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    rest = F.map_filter(F.coalesce(lower, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~F.map_contains_key(set_, k))
    return F.map_concat(rest, set_)


def network_overridden(given: Column) -> Column:
    """Whether a settings map changes how a client reaches the network: by value, so a default written out changes
    nothing."""
    named = [S.blank_free(F.try_element_at(given, F.lit(n))) for n in ("proxy", "no_proxy", "ca_bundle", "connect_timeout")]
    off = [F.lower(F.try_element_at(given, F.lit(n))).eqNullSafe("false") for n in ("verify_ssl", "proxy_from_env")]
    changed = F.lit(False)
    for c in [*(n.isNotNull() for n in named), *off]:
        changed = changed | c
    return F.coalesce(changed, F.lit(False))


def unknown_fields(given: Column, allowed: list[str]) -> Column:
    """Keys of a settings map that are not allowed, sorted."""
    return F.sort_array(F.array_except(F.map_keys(given), F.array(*map(F.lit, allowed))))


def problems(entries: DataFrame, providers: DataFrame) -> DataFrame:
    """(name, problem) of every entry that breaks a rule: repeated name, unknown provider, kind or mode, no base URL."""
    repeated = entries.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name", F.lit("repeated name").alias("problem"))
    known = providers.select(F.col("name").alias("provider"), F.col("base_url").alias("_url"), F.lit(True).alias("_known"))
    joined = entries.join(known, "provider", "left")
    rules = [
        (F.col("provider").isNotNull() & F.col("_known").isNull(), "unknown provider"),
        (~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), "kind"),
        (F.col("structured").isNotNull() & ~F.col("structured").isin(STRUCTURED), "structured output mode"),
        (S.blank_free(F.coalesce("base_url", "_url")).isNull(), "no base url"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))
    return joined.select("name", F.explode(found).alias("problem")).unionByName(repeated)


def resolved(entries: DataFrame, providers: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Effective settings of every entry: entry, then provider, then defaults, blank counting as unset."""
    under = providers.select(F.col("name").alias("provider"), F.col("base_url").alias("_url"), F.col("proxy").alias("_proxy"), F.col("headers").alias("_headers"))
    rows = entries.join(under, "provider", "left")

    def setting(name: str, lower: str) -> Column:
        return relational.layered(F.col(name), F.col(lower), builtin=F.lit(defaults.get(name)).cast("string")).alias(name)

    return rows.select(
        "name", "provider", "kind", setting("base_url", "_url"), setting("proxy", "_proxy"), merged_maps(F.col("headers"), F.col("_headers")).alias("headers"),
        relational.layered(F.col("structured"), builtin=F.lit(defaults.get("structured", STRUCTURED[0]))).alias("structured"),
    )


def with_credentials(models: DataFrame, keys: DataFrame, fallback: str | None) -> DataFrame:
    """Adds ``has_key``, never the key: by exact name, else by scrubbed base URL, else the fallback."""
    by_name = keys.filter("name IS NOT NULL").groupBy("name").agg(F.max("key").alias("_by_name"))
    by_url = keys.filter("base_url IS NOT NULL").groupBy(S.scrubbed_url(F.col("base_url")).alias("_bare")).agg(F.max("key").alias("_by_url"))
    found = models.withColumn("_bare", S.scrubbed_url(F.col("base_url"))).join(by_name, "name", "left").join(by_url, "_bare", "left")
    key = relational.layered(F.col("_by_name"), F.col("_by_url"), builtin=F.lit(fallback).cast("string"))
    return found.withColumn("has_key", key.isNotNull()).drop("_bare", "_by_name", "_by_url")


def overview(models: DataFrame) -> DataFrame:
    """(name, line): one padded line per model with its network summary, credentials left out."""
    network = F.concat_ws(" · ", F.when(F.col("proxy").isNotNull(), F.concat(F.lit("proxy "), S.scrubbed_url(F.col("proxy")))), F.when(F.size("headers") > 0, F.concat(F.size("headers").cast("string"), F.lit(" headers"))))
    rows = models.select("name", F.coalesce("provider", F.lit("-")).alias("provider"), S.scrubbed_url(F.col("base_url")).alias("url"), network.alias("network"))
    return relational.fixed_width(rows.withColumn("model", F.col("name")), ["model", "provider", "url", "network"], "name")
