"""WARC: resolution of not-modified revisits.

A revisit is answered by the latest full response of the same canonical URL that is strictly earlier. That response must bear the revisit's
validators: the entity tag (weak comparison) where the revisit has one, else the payload digest, else a last-modified time that is not
later. The answer's headers are merged as for a 304: the revisit's permitted headers replace the stored ones, all others stay.

The as-of join works on different (url, time) points only. Times are cut into buckets; within a bucket the latest response is carried forward by a
window, and the last response of each bucket is carried over the buckets by a second window. So a URL with a third of all rows spreads over its
buckets. What is carried is a time and an id; validators and headers are joined afterwards by the response's id, in a join whose partitions Spark can split where one
response answers many; revisits without an answer are dealt out by their own ids.

Defined results: a null URL or time, or a URL without an earlier response, is `no-response`; validators that differ are `validator-mismatch`; a
revisit without any validator is `no-validator`; of several responses at one time the largest record id stands; an empty table gives an empty
result; other columns are ignored; header names are told apart without case, the first in a map stands; a missing map is empty. A full response has a status from 200 to 299 but 206.
Records: record_id, url, ts (timestamp), kind (response or revisit), status, etag, digest, last_modified, headers (map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import cut

#: Headers that a 304 may update (RFC 9111, section 3.2, and RFC 9110, section 15.4.5), fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning")
BUCKET_SECONDS = 6 * 3600
#: Parts into which revisits without an answer are dealt.
SALTS = 4096
#: Query parameters that name a visit, not a page, as a pattern.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref)="


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host in lower case without www. and default port, no fragment, tracking parameters or last slash; other parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "(?i)^https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def latest_before(points: DataFrame, responses: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """points (u, ts), all different, with `answer`: record_id of the latest response of u with a strictly earlier time."""
    bucket = F.floor(F.unix_micros("ts") / (bucket_seconds * 1_000_000)).cast("long")
    at = responses.groupBy("u", "ts").agg(F.max("record_id").alias("rid"))
    marked = points.select("u", "ts", F.lit(0).alias("is_response"), F.lit(None).cast(dict(responses.dtypes)["record_id"]).alias("rid")).unionByName(at.select("u", "ts", F.lit(1).alias("is_response"), "rid")).withColumn("bucket", bucket)
    held = F.when(F.col("is_response") == 1, F.struct("ts", "rid"))
    inside = Window.partitionBy("u", "bucket").orderBy("ts", "is_response").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marked.withColumn("near", F.last(held, ignorenulls=True).over(inside)).filter("is_response = 0")
    # the last response of each bucket that has one, over the points' buckets
    ends = at.withColumn("bucket", bucket).groupBy("u", "bucket").agg(F.max(F.struct("ts", "rid")).alias("end"))
    asked = local.filter("near is null").select("u", "bucket").distinct()
    steps = asked.select("u", "bucket", F.lit(0).alias("k"), F.lit(None).cast(dict(ends.dtypes)["end"]).alias("end")).unionByName(ends.select("u", "bucket", F.lit(1).alias("k"), "end"))
    over = Window.partitionBy("u").orderBy("bucket", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = steps.withColumn("far", F.last("end", ignorenulls=True).over(over)).filter("k = 0").select("u", "bucket", "far")
    return local.join(far, ["u", "bucket"], "left").select("u", "ts", F.coalesce("near", "far")["rid"].alias("answer"))


FIELDS = ("record_id", "url", "ts", "kind", "status", "etag", "digest", "last_modified", "headers")


def lower_names(headers: Column) -> Column:
    """The map with names in lower case; of names that differ in case only, the first stands. Null is empty."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Every revisit with u (canonical URL), answer (record_id or null), outcome and merged headers."""
    r = records.select(*FIELDS).withColumn("u", canonical_url(F.col("url")))
    full = r.filter("kind = 'response' and status between 200 and 299 and status <> 206 and u is not null and ts is not null and record_id is not null")
    asked = r.filter("kind = 'revisit'")
    points = asked.filter("u is not null and ts is not null").select("u", "ts").distinct()
    found = latest_before(points, full.select("u", "ts", "record_id"), bucket_seconds)
    # cut off here, else the join below would stand in one stage with this one's aggregate and could not be split
    have = cut(full.select(F.col("record_id").alias("answer"), *[F.col(c).alias(f"r_{c}") for c in ("etag", "digest", "last_modified", "headers")]).dropDuplicates(["answer"]))
    j = asked.join(found, ["u", "ts"], "left")
    j = j.withColumn("salt", F.when(F.col("answer").isNull(), F.pmod(F.xxhash64("record_id", "url", "ts"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    j = j.join(have.withColumn("salt", F.lit(0)), ["answer", "salt"], "left").drop("salt")
    weak = lambda c: F.regexp_replace(F.col(c), "^W/", "")
    same = F.when(F.col("etag").isNotNull(), weak("etag") == weak("r_etag")).when(F.col("digest").isNotNull(), F.col("digest") == F.col("r_digest")).when(F.col("last_modified").isNotNull(), F.col("r_last_modified") <= F.col("last_modified"))
    outcome = F.when(F.col("answer").isNull(), "no-response").when(F.col("etag").isNull() & F.col("digest").isNull() & F.col("last_modified").isNull(), "no-validator").when(same, "resolved").otherwise("validator-mismatch")
    fresh = F.map_filter(lower_names(F.col("headers")), lambda k, _: k.isin(*PERMITTED))
    stored = F.map_filter(lower_names(F.col("r_headers")), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    j = j.withColumn("outcome", outcome)
    j = j.withColumn("merged", F.when(F.col("outcome") == "resolved", F.map_concat(stored, fresh)))
    return j.withColumn("answer", F.when(F.col("outcome") == "resolved", F.col("answer"))).drop("r_etag", "r_digest", "r_last_modified", "r_headers")
