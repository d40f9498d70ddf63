"""Redirect chains over landed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions.text import let
from sitetide.functions.urls import (
    canonical_url,
    guard_parts,
    host_within,
    inspect_url,
    outside_reason,
    parse_http_url,
    resolve_url,
)
from sitetide.operators.joins import join_asked
from sitetide.session import cut_lineage

# Statuses that carry a location to follow.
REDIRECT_STATUSES = [301, 302, 303, 307, 308]
MAX_REDIRECTS = 5
LIMIT_CODE = "OUTBOUND_REDIRECT_LIMIT"
REFUSED_CODE = "OUTBOUND_REFUSED"
NOT_LANDED_CODE = "NOT_LANDED"


def _refusal(url: str, domain: str) -> Column:
    return inspect_url(url, domain)["reason"]


def _redirects() -> Column:
    return F.col("status").isin(REDIRECT_STATUSES) & (F.length("location") > 0)


def redirect_steps(responses: DataFrame) -> DataFrame:
    """One row per URL (and owner) whose newest response redirects: where it leads and whether that target may ever be requested.

    Resolution and the domain-independent part of the guard are settled here, once per response, so a hop
    only compares a host with a domain.
    """
    slim = responses.select("_owner", canonical_url("url").alias("_key"), "status", "location", *[c for c in ("landed_at",) if c in responses.columns])
    moving = latest_responses(slim.filter(F.col("_key").isNotNull()), ["_owner", "_key"]).filter(_redirects()).select(
        "_owner", "_key", F.col("status").alias("_hop_status"), "location")
    resolved = moving.withColumn("_next", resolve_url("location", "_key"))
    checked = resolved.withColumn(
        "_target",
        let(parse_http_url("_next"), lambda p: F.struct(
            guard_parts(p, F.coalesce("_next", F.lit("")), p["host"]).alias("reason"), p["host"].alias("host"))),
    )
    return checked.select(
        "_owner", "_key", "_hop_status", "_next", F.col("_target.reason").alias("_never"), F.col("_target.host").alias("_host"),
    )


def redirect_chains(steps: DataFrame, length: int) -> DataFrame:
    """(_owner, _key, _chain): up to ``length`` hops from every redirecting URL, by doubling.

    Each round appends to a chain the chain of the URL that it ends at, so hops double; only redirecting URLs take part.
    """
    hop = F.struct(F.col("_hop_status").alias("status"), F.col("_next").alias("next"), F.col("_never").alias("never"), F.col("_host").alias("host"))
    chains = cut_lineage(steps.select("_owner", "_key", F.array(hop).alias("_chain")))
    reach = length if chains.isEmpty() else 1
    while reach < length:
        further = chains.select("_owner", F.col("_key").alias("_end"), F.col("_chain").alias("_more"))
        joined = chains.withColumn("_end", F.element_at("_chain", -1)["next"]).join(further, ["_owner", "_end"], "left")
        whole = F.when(F.col("_more").isNull(), F.col("_chain")).otherwise(F.concat("_chain", "_more"))
        chains = joined.select("_owner", "_key", F.slice(whole, 1, length).alias("_chain"))
        reach *= 2
        if reach < length:
            chains = cut_lineage(chains)
    return chains


def _walked(max_redirects: int) -> Column:
    """struct(at, chain, limit_status, error): how far a request gets along _chain; the guard is asked at every hop."""
    kind = "struct<at:string,chain:array<string>,limit_status:int,error:string,open:boolean>"

    def state(at: Column, chain: Column, limit_status: Column, error: Column, is_open: Column) -> Column:
        return F.struct(at.alias("at"), chain.alias("chain"), limit_status.alias("limit_status"), error.alias("error"), is_open.alias("open")).cast(kind)

    def step(s: Column, hop: Column) -> Column:
        refused = F.coalesce(hop["never"], F.when(~host_within(hop["host"], "domain"), outside_reason(hop["host"], "domain")))
        limit = state(s["at"], s["chain"], hop["status"], F.lit(f"More than {max_redirects} redirects"), F.lit(False))
        stopped = state(s["at"], s["chain"], s["limit_status"], refused, F.lit(False))
        moved = state(hop["next"], F.array_append(s["chain"], hop["next"]), s["limit_status"], s["error"], F.lit(True))
        return (
            F.when(~s["open"], s).when(F.size(s["chain"]) >= max_redirects, limit).when(refused.isNotNull(), stopped).otherwise(moved)
        )

    none = F.lit(None)
    start = state(F.col("_current"), F.array(), none, none, F.lit(True))
    return F.aggregate("_chain", start, step)


def latest_responses(responses: DataFrame, keys: list[str]) -> DataFrame:
    """One response per key, the one that landed last; without times or at equal ones the smallest of the other columns."""
    landed = [F.col("landed_at").desc_nulls_last()] if "landed_at" in responses.columns else []
    rest = [F.col(c).asc_nulls_last() for c in ("status", "location", "content_type", "content_length", "error", "body", "url") if c in responses.columns]
    newest = Window.partitionBy(*keys).orderBy(*landed, *rest)
    return responses.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def resolve_redirects(
    requests: DataFrame,
    responses: DataFrame,
    max_redirects: int = MAX_REDIRECTS,
    keys: list[str] | None = None,
    by_competitor: bool = False,
) -> DataFrame:
    """Follow every request (keys, url, domain) through the landed responses.

    Adds ``final_url``, ``redirect_chain``, ``error_code``, ``error`` and, from the last response,
    ``status``, ``content_type``, ``content_length`` and ``body``. A chain that fails keeps its request URL
    and an empty chain. The chains are found first, from the slim set of redirecting responses alone; a request then meets its
    whole chain in one join, and the landed table in another; where no response redirects there are no
    chains to meet. Where it ends is written down, as it is asked for twice: which responses to read, and which one is its own.
    Refused requests get a key of their own, so they spread over all partitions and find no partner.

    A request gets one response: the newest that landed for its URL, whoever asked for it, or with ``by_competitor`` the
    newest of those that landed for the request's competitor. Where a few URLs are asked for only their bodies move.
    """
    keys = keys or [c for c in requests.columns if c not in ("url", "domain")]
    owner = F.coalesce("competitor_id", F.lit("")) if by_competitor else F.lit("")
    responses = responses.withColumn("_owner", owner)
    first = requests.select(
        *keys, owner.alias("_owner"), "url", "domain", canonical_url("url").alias("_current"), _refusal("url", "domain").alias("error"))
    resting = F.concat(F.lit("-"), F.xxhash64("url", *keys).cast("string"))
    first = first.withColumn("_key", F.when(F.col("error").isNotNull(), resting).otherwise(F.col("_current")))
    no_chain = F.array().cast("array<string>")
    if responses.filter(_redirects()).isEmpty():
        state = first.withColumns({"redirect_chain": no_chain, "_limit_status": F.lit(None).cast("int")})
    else:
        chains = redirect_chains(redirect_steps(responses), max_redirects + 1)
        state = first.join(chains, ["_owner", "_key"], "left").withColumn("_walk", _walked(max_redirects)).select(
            *keys, "_owner", "url", "domain", F.coalesce("_walk.at", "_current").alias("_current"),
            F.coalesce("_walk.chain", no_chain).alias("redirect_chain"), F.col("_walk.limit_status").alias("_limit_status"),
            F.coalesce("error", "_walk.error").alias("error"))

    failed = F.col("error").isNotNull()
    settled = cut_lineage(state.select(
        *keys,
        "_owner",
        "url",
        "domain",
        F.when(failed, F.col("url"))
        .when(F.size("redirect_chain") == 0, F.col("url"))
        .otherwise(F.col("_current")).alias("final_url"),
        F.when(failed, F.array().cast("array<string>")).otherwise(F.col("redirect_chain")).alias("redirect_chain"),
        F.when(F.col("_limit_status").isNotNull(), F.lit(LIMIT_CODE)).when(failed, F.lit(REFUSED_CODE)).alias("error_code"),
        F.col("error").alias("_chain_error"),
        "_limit_status",
        F.when(failed, resting).otherwise(F.col("_current")).alias("_key"),
    ))
    place = ["_owner", "_key"]
    answers = join_asked(responses.withColumn("_key", canonical_url("url")).filter(F.col("_key").isNotNull()), settled, place)
    last = latest_responses(answers, place).select(
        *place, "status", "content_type", "content_length", "body", F.col("error").alias("_transport"), F.lit(True).alias("_landed"))
    out = settled.join(last, place, "left")
    missing = F.col("_chain_error").isNull() & F.col("_landed").isNull()
    settles = ~missing
    return out.select(
        *keys,
        "url",
        "domain",
        F.when(settles, F.col("final_url")).otherwise(F.col("url")).alias("final_url"),
        F.when(settles, F.col("redirect_chain")).otherwise(F.array().cast("array<string>")).alias("redirect_chain"),
        F.coalesce("_limit_status", "status").alias("status"),
        "content_type",
        "content_length",
        "body",
        F.coalesce("error_code", F.when(missing, F.lit(NOT_LANDED_CODE))).alias("error_code"),
        F.coalesce("_chain_error", F.when(missing, F.lit("No landed response")), "_transport").alias("error"),
    )
