"""Access audit: routes, revocations, tool calls, binding requests, outgoing connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.functions.text import is_blank
from rosterflow.operators import limits
from rosterflow.operators.joins import fixed_table, lookup

# Private, loopback and link-local networks.
INTERNAL_IP = r"^(10\.|172\.1[6-9]\.|172\.2[0-9]\.|172\.3[01]\.|192\.168\.|127\.|169\.254\.)"


def retry_after(refill_per_minute: Column) -> Column:
    """Seconds until one more token, at least 1."""
    return F.when(refill_per_minute <= 0, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil(F.lit(60.0) / refill_per_minute).cast("int")))


def route(log: DataFrame, rules=C.RATE_RULES) -> DataFrame:
    """First rule whose prefix covers the path, the rate key, and the retry hint."""
    path = F.col("path")
    rule = F.lit(None).cast("struct<prefix:string,bucket:int,refill:int>")
    for prefix, bucket, refill in reversed(rules):
        value = F.struct(F.lit(prefix).alias("prefix"), F.lit(bucket).alias("bucket"), F.lit(refill).alias("refill"))
        rule = F.when((path == prefix) | path.startswith(prefix + "/"), value).otherwise(rule)
    routed = log.withColumn("__r", rule)
    owner = F.when(~is_blank(F.col("student_id")), F.concat(F.lit(":student:"), F.col("student_id"))).otherwise(
        F.concat(F.lit(":ip:"), F.coalesce("ip", F.lit("unknown"))))
    return routed.withColumns({
        "rule": F.col("__r.prefix"),
        "rate_key": F.concat(F.col("__r.prefix"), owner),
        "retry_after": F.when(F.col("__r").isNotNull(), retry_after(F.col("__r.refill"))),
    }).drop("__r")


def mark_revoked(log: DataFrame, revocations: DataFrame) -> DataFrame:
    """Whether the token of each access was revoked; entries that are not ``revoked`` do not count."""
    revoked = revocations.filter("revoked").groupBy("jti").agg(F.lit(True).alias("__revoked"))
    return lookup(log, revoked, "jti", ["seq"]).withColumn(
        "revoked", F.coalesce("__revoked", F.lit(False))).drop("__revoked")


def revoke_by_phone(revocations: DataFrame) -> DataFrame:
    """Distinct tokens revoked per phone; copies are dropped before the shuffle."""
    return revocations.filter("revoked").select("phone", "jti").distinct().groupBy("phone").agg(
        F.count(F.lit(1)).alias("tokens"))


def poi_lookup(requests: DataFrame, poi_id: str) -> DataFrame:
    """Name, distance and link of a point of interest, or NOT_FOUND."""
    catalogue = fixed_table(
        requests.sparkSession, C.POI_CATALOGUE,
        f"{poi_id} string, poi_name string, poi_category string, distance int")
    joined = requests.join(catalogue, poi_id, "left")
    known = F.col("poi_name").isNotNull()
    return joined.withColumns({
        "poi_error": F.when(~known, F.lit("NOT_FOUND")),
        "nav_url": F.when(known, F.concat(F.lit(C.NAV_URL_PREFIX), F.col(poi_id))),
    })


def tool_outcomes(calls: DataFrame, max_calls: int = C.TOOL_LIMIT_PER_MINUTE, window_seconds: int = 60) -> DataFrame:
    """Result of every tool call: unknown tool, over the limit, invalid parameters, then the tool itself.

    ``calls`` carries seq, ts, student_id, tool_name and a ``params`` map.
    Unknown tools do not use up the limit.
    """
    known_tool = F.col("tool_name").isin(C.TOOL_STEP, C.TOOL_NAVIGATION)
    limited = limits.anchored_window(
        calls.filter(known_tool).select("seq", "ts", "student_id"), "student_id", max_calls, window_seconds)
    checked = calls.join(limited.select("seq", "allowed"), "seq", "left").withColumns({
        "step_id": F.col("params")["step_id"], "poi_id": F.col("params")["poi_id"]})
    steps = fixed_table(
        calls.sparkSession, C.STEP_CATALOGUE, "step_id string, step_name string, page_url string")
    found = poi_lookup(checked.join(steps, "step_id", "left"), "poi_id")
    is_step = F.col("tool_name") == C.TOOL_STEP
    error = (
        F.when(~F.coalesce(known_tool, F.lit(False)), F.lit("TOOL_NOT_FOUND"))
        .when(~F.col("allowed"), F.lit("RATE_LIMITED"))
        .when(is_step & is_blank(F.col("params")["student_id"]), F.lit("INVALID_PARAM"))
        .when(is_step & is_blank(F.col("step_id")), F.lit("INVALID_PARAM"))
        .when(is_step & F.col("step_name").isNull(), F.lit("INVALID_PARAM"))
        .when(~is_step & is_blank(F.col("poi_id")), F.lit("INVALID_PARAM"))
        .when(~is_step, F.col("poi_error"))
    )
    ok = F.col("error_code").isNull()
    return found.withColumn("error_code", error).withColumns({
        "success": ok,
        "shown_name": F.when(ok, F.when(is_step, F.col("step_name")).otherwise(F.col("poi_name"))),
        "url": F.when(ok, F.when(is_step, F.col("page_url")).otherwise(F.col("nav_url"))),
    }).drop("allowed", "step_name", "page_url", "poi_name", "poi_category", "poi_error", "nav_url")


def bind_outcomes(
    requests: DataFrame, registrations: DataFrame, window_seconds: int = C.CODE_REQUEST_WINDOW_SECONDS,
    max_requests: int = C.CODE_REQUEST_MAX, max_errors: int = C.MAX_ERROR_COUNT, lock_seconds: int = C.LOCK_SECONDS,
) -> DataFrame:
    """Result code of code requests and binding attempts; only registered phones reach the limiters."""
    phones = registrations.filter("registered").groupBy("phone").agg(F.lit(True).alias("registered"))
    checked = lookup(requests, phones, "phone", ["seq"])
    known = checked.filter("registered")
    asked = limits.sliding_log(
        known.filter("kind = 'verify-code'").select("seq", "ts", "phone"), "phone", max_requests, window_seconds)
    tried = limits.lockout(
        known.filter("kind = 'bind'").select("seq", "ts", "phone", "result"), "phone", max_errors, lock_seconds)
    codes = asked.select("seq", F.when(F.col("allowed"), F.lit(C.CODE_OK)).otherwise(
        F.lit(C.CODE_RATE_LIMITED)).alias("code")).unionByName(
        tried.select("seq", F.when(F.col("outcome") == "ok", F.lit(C.CODE_OK)).when(
            F.col("outcome") == "locked", F.lit(C.CODE_LOCKED)).otherwise(F.lit(C.CODE_WRONG)).alias("code")))
    return checked.join(codes, "seq", "left").withColumn(
        "code", F.coalesce("code", F.lit(C.CODE_NOT_REGISTERED))).drop("registered")


def egress_audit(connections: DataFrame, allow_list: DataFrame) -> DataFrame:
    """Connections per target, most frequent first, with their class and verdict."""
    counted = connections.groupBy("dest_ip", "dest_port").agg(F.count(F.lit(1)).alias("connections"))
    allowed = allow_list.select(F.col("ip").alias("dest_ip"), F.lit(True).alias("__allowed")).distinct()
    judged = lookup(counted, allowed, "dest_ip", ["dest_port"])
    kind = F.when(F.col("dest_ip").rlike(INTERNAL_IP), F.lit("internal")).when(
        F.col("__allowed"), F.lit("allow_listed")).otherwise(F.lit("violation"))
    return judged.withColumn("class", kind).withColumn(
        "verdict", F.when(F.col("class") == "violation", F.lit("FAIL")).otherwise(F.lit("PASS"))
    ).drop("__allowed").orderBy(F.col("connections").desc(), "dest_ip", "dest_port")
