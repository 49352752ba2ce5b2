"""Not-modified revisits of web archives, resolved to the full response they stand for.

A revisit record (status 304) has headers and no payload.  It is matched, as of its capture time, to the latest earlier
full response (status 200) with the same canonical URL.  Validators are checked: entity tags where both have one (weak
comparison), else Last-Modified dates.  A resolved revisit takes the response's payload and its headers, with those that a
not-modified answer may change replaced by its own.

The as-of join goes by URL and stretch of time: inside a stretch the last full response before each revisit, across
stretches the last one of the nearest earlier stretch that has any, found on one row for each URL and stretch.  So a URL
with a third of all captures is spread over its stretches, and payloads are fetched by record id at the end, once.

Outcomes: `resolved` (validators agree), `unverified` (no validator on both sides; resolved all the same), `mismatch` (the
latest earlier response has another validator: nothing is merged) and `missing` (no earlier response).

Defined results: records with a null URL, time or id match nothing (revisits are `missing`); captures at the same time go
in order of record id; a response does not serve revisits of its own time with a lower id; null headers are none; header
names compare without case and come out in lower case; a record that is stored several times gives as many rows as a
revisit and serves once as a response, and of responses that differ under one id, URL and time the one whose payload and
headers have the least hash serves; an empty table gives no rows.

A window holds the captures of one URL in one stretch (an hour by default), as slim rows that sort with spilling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that a not-modified answer may send anew (fixed values, RFC 9110 15.4.5 and Last-Modified).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not tell pages apart.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, www, default port, fragment, tracking parameters and trailing slashes; parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    given = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(given, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then coincide the last one in order counts."""
    entries = F.array_sort(F.map_entries(headers))
    return F.aggregate(
        entries, F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.map_from_entries(F.array(F.struct(F.lower(e["key"]), e["value"])))),
    )


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.element_at(headers, "etag"), r"^W/", "")


def resolve_revisits(records: DataFrame, *, stretch_seconds: int = 3_600) -> DataFrame:
    """records: record_id, url, captured_at timestamp, status int, headers map, payload string.  One row per revisit:
    record_id, canonical_url, captured_at, response_id, outcome, headers, payload."""
    own = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", "status",
        lower_names(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers"), "payload",
    )
    valid = F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull() & F.col("record_id").isNotNull()
    slim = own.filter(valid & F.col("status").isin(200, 304)).select(
        "record_id", "canonical_url", "captured_at", (F.col("status") == 200).alias("full"), F.floor(F.unix_timestamp("captured_at") / stretch_seconds).alias("stretch")
    )
    at = F.struct("captured_at", "record_id")
    inside = Window.partitionBy("canonical_url", "stretch").orderBy("captured_at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    key = ["record_id", "canonical_url", "captured_at"]
    near = slim.withColumn("near", F.last(F.when(F.col("full"), at), True).over(inside)).filter(~F.col("full"))
    ends = slim.groupBy("canonical_url", "stretch").agg(F.max(F.when(F.col("full"), at)).alias("end"))
    across = Window.partitionBy("canonical_url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("canonical_url", "stretch", F.last("end", True).over(across).alias("far"))
    served = F.coalesce("near", "far")
    found = near.join(ends, ["canonical_url", "stretch"]).select(*key, served["record_id"].alias("response_id"), served["captured_at"].alias("response_at"))
    found = found.groupBy(*key).agg(F.max(F.struct("response_at", "response_id")).alias("r")).select(*key, "r.response_id", "r.response_at")
    revisits = own.filter("status = 304").select(*key, F.col("headers").alias("sent"))
    lines = F.array_sort(F.map_entries("headers"))
    full = (
        own.filter((F.col("status") == 200) & valid)
        .groupBy(F.col("record_id").alias("response_id"), "canonical_url", F.col("captured_at").alias("response_at"))
        .agg(F.min_by(F.struct(F.col("headers").alias("stored"), F.col("payload").alias("body")), F.xxhash64("payload", lines)).alias("f"))
        .select("response_id", "canonical_url", "response_at", "f.stored", "f.body")
    )
    both = revisits.join(found, key, "left").join(full, ["response_id", "canonical_url", "response_at"], "left")
    tag, old_tag = _tag(F.col("sent")), _tag(F.col("stored"))
    date, old_date = F.element_at("sent", "last-modified"), F.element_at("stored", "last-modified")
    outcome = (
        F.when(F.col("response_id").isNull(), "missing").when(tag.isNotNull() & old_tag.isNotNull(), F.when(tag == old_tag, "resolved").otherwise("mismatch"))
        .when(date.isNotNull() & old_date.isNotNull(), F.when(date == old_date, "resolved").otherwise("mismatch")).otherwise("unverified")
    )
    both = both.withColumn("outcome", outcome)
    changed = F.map_filter("sent", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys(changed), k)), changed)
    taken = F.col("outcome").isin("resolved", "unverified")
    return both.select(
        "record_id", "canonical_url", "captured_at", "response_id", "outcome",
        F.when(taken, merged).otherwise(F.col("sent")).alias("headers"), F.when(taken, F.col("body")).alias("payload"),
    )
