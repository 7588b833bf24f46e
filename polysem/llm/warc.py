"""Not-modified revisits of a web archive, resolved to what they confirm.

A revisit record says that a page had not changed. It is resolved to the latest
full response (status 200) with the same canonical URL that was captured
strictly earlier; of several captured at once, to the one with the largest
record id. The two are compared by the first validator that both have: entity
tag (weak comparison), date of last change, digest of the payload. Where they
agree, headers of the revisit that a 304 response may update replace those of
the response.

The as-of join is one range sort by URL, time and record: revisits stand before
responses of the same time, each task carries the last full response along, and
the last one of each partition (one row each) is handed to the partitions after
it. A URL with a third of all captures is spread over many partitions.

Header names are expected in lower case. A revisit without URL (null, or
empty but for a scheme or fragment) or time is an orphan; null headers are no headers; null record ids sort first. Repeated
records are resolved each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysem.session import stored

# The header fields of RFC 9110, 15.4.5, that a 304 response sends.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
VALIDATORS = ("etag", "last-modified", "warc-payload-digest")
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical_url(url: Column) -> Column:
    """Without scheme, user, default port, leading www, fragment and tracking
    parameters; host in lower case, parameters sorted. Null if nothing is left."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_extract(rest, "^[^/?]*(/[^?]*)", 1)
    split = F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&")
    params = F.array_sort(F.filter(split, lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(rest != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


HEADERS = "map<string,string>"
FOUND = (
    f"part int, last boolean, record_id bigint, url string, ts bigint, headers {HEADERS}, "
    f"target_id bigint, target_ts bigint, target_headers {HEADERS}, found boolean"
)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (record_id, url, ts, full, headers): every revisit with the
    last full response before it in this partition, then that response which is
    the last of all in the partition."""
    part, carry = TaskContext.get().partitionId(), None
    for batch in batches:
        here = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
        full = here["full"].to_numpy()
        last = np.maximum.accumulate(np.where(full, np.arange(len(full)), -1))
        rows = np.flatnonzero(~full)
        at = last[rows]
        url = one_array(here["url"]).dictionary_encode().indices.to_numpy()
        found = (at >= 0) & (url[rows] == url[np.maximum(at, 0)])
        mine = here.take(pa.array(rows))
        target = here.take(pa.array(at, mask=~found))
        yield _batch(part, False, mine, target, found)
        if last[-1] >= 0:
            carry = here.slice(int(last[-1]), 1)
    if carry is not None:
        yield _batch(part, True, carry, carry, np.ones(1, bool))


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _batch(part: int, last: bool, rows: pa.Table, target: pa.Table, found: np.ndarray) -> pa.RecordBatch:
    n = len(rows)
    arrays = [
        pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, last)), *[one_array(rows[c]) for c in ("record_id", "url", "ts", "headers")],
        *[one_array(target[c]) for c in ("record_id", "ts", "headers")], pa.array(found),
    ]
    names = ["part", "last", "record_id", "url", "ts", "headers", "target_id", "target_ts", "target_headers", "found"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def as_of(records: DataFrame) -> DataFrame:
    """Revisits (record_id, url, ts, headers) with target_id, target_ts and
    target_headers of the response each goes back to, null without one.
    `records`: record_id, url (canonical), ts, full, headers."""
    known = records.where("url is not null and ts is not null")
    lost = records.where("not full and (url is null or ts is null)")
    ordered = known.orderBy("url", "ts", "full", "record_id").select("record_id", "url", "ts", "full", "headers")
    met = stored(ordered.mapInArrow(_carried, FOUND), "revisits")
    ends = {r["part"]: r for r in met.where("last").collect()}  # one row for each partition at most
    latest, handed = (None,) * 4, []
    for part in range(max(ends, default=-1) + 2):
        handed.append((part, *latest))
        if part in ends:
            latest = tuple(ends[part][c] for c in ("url", "record_id", "ts", "headers"))
    after = max(ends, default=-1) + 1  # from here on nothing changes
    table = records.sparkSession.createDataFrame(
        handed, f"at int, end_url string, end_id bigint, end_ts bigint, end_headers {HEADERS}"
    )
    joined = met.where("not last").join(F.broadcast(table), F.least("part", F.lit(after)) == F.col("at"), "left")
    from_end = ~F.col("found") & F.coalesce(F.col("url") == F.col("end_url"), F.lit(False))
    target = lambda c: F.when(from_end, F.col(f"end_{c}")).otherwise(F.col(f"target_{c}")).alias(f"target_{c}")
    found = joined.select("record_id", "url", "ts", "headers", target("id"), target("ts"), target("headers"))
    none = lost.select(
        "record_id", "url", "ts", "headers", F.lit(None).cast("bigint").alias("target_id"),
        F.lit(None).cast("bigint").alias("target_ts"), F.lit(None).cast(HEADERS).alias("target_headers"),
    )
    return found.unionByName(none)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, target_id, age, outcome
    (resolved, mismatch, unverified, orphan), merged (map, null unless resolved).
    `records`: record_id, url, ts (seconds), kind (response, revisit), status,
    headers; other columns and other kinds are left out."""
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = records.where(F.coalesce(full, F.lit(False)) | (F.col("kind") == "revisit")).select(
        F.col("record_id").cast("bigint").alias("record_id"), canonical_url(F.col("url")).alias("url"),
        F.col("ts").cast("bigint").alias("ts"), F.coalesce(full, F.lit(False)).alias("full"),
        F.coalesce("headers", F.expr(f"cast(map() as {HEADERS})")).alias("headers"),
    )
    met = as_of(rows)
    outcome = F.when(F.col("target_ts").isNull(), "orphan")
    for name in VALIDATORS:
        mine, other = (F.regexp_replace(F.element_at(c, name), "^W/", "") for c in ("headers", "target_headers"))
        both = mine.isNotNull() & other.isNotNull()
        outcome = outcome.when(both & (mine == other), "resolved").when(both, "mismatch")
    allowed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    stays = F.map_filter("target_headers", lambda k, _: ~(k.isin(*PERMITTED) & F.map_contains_key(F.col("headers"), k)))
    met = met.withColumn("outcome", outcome.otherwise("unverified"))
    return met.select(
        "record_id", F.col("url").alias("canonical_url"), "target_id", (F.col("ts") - F.col("target_ts")).alias("age"), "outcome",
        F.when(F.col("outcome") == "resolved", F.map_concat(stays, allowed)).alias("merged"),
    )
