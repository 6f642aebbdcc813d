"""Resolution of WARC revisit records (304 Not Modified) to the responses that they repeat.

Method: an as-of join by canonical URL. Responses and revisits of one URL and time become one point of a timeline;
the timeline is cut into cells of equal size across all URLs, each cell passes its last response on, and inside a
cell a window looks back. A URL may hold any share of the rows: no task gets more of it than a cell. The validators
of the latest earlier response are checked, and headers that a 304 may update are merged into the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import salted_join
from spindrift.llm.sharding import positioned
from spindrift.session import durable, shuffle_width

# Header fields that a 304 response may update (RFC 9110, section 15.4.5, and RFC 9111, section 3.2).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that do not choose a resource.
TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid)(=|$)"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, www., default port, trailing slash, fragment and tracking parameters.

    Null for a null url; a text that is not an absolute URL is kept as it is.
    """
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, _AUTHORITY, 1)), r"^www\.|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(bare, _PATH, 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    chosen = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(chosen) > 0, F.concat(F.lit("?"), F.array_join(chosen, "&"))).otherwise("")
    return F.when(host == "", url).otherwise(F.concat(host, path, tail))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, with those that a 304 may update taken from the fresh ones. Names are lower case."""
    empty = F.create_map().cast("map<string,string>")
    stored = F.coalesce(stored, empty)
    allowed = F.map_filter(F.coalesce(fresh, empty), lambda k, _: k.isin(*PERMITTED))
    rest = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row a revisit: record_id, uri_key, resolved_id, status, headers, payload.

    records has record_id, uri, ts, kind ('response' or 'revisit'), etag, last_modified, headers and payload. A
    revisit looks for the latest response of its canonical URL with an earlier ts (of equal ones the largest
    record_id). status is 'orphan' if there is none; 'stale' if a validator that both carry differs, and then
    neither headers nor payload are filled in; else 'resolved'. ETags are compared weakly, as a 304 is: ``W/`` does not
    count. Rows without uri or ts have no key and stay orphans; other kinds are ignored. Repeated revisits are answered
    each. Of responses that repeat a record_id at one URL and time, that of the largest etag, last_modified and payload
    stands. An empty payload stays empty, payloads are passed on whole; an empty table gives no rows. Columns of other
    names are ignored, whatever they are called.
    """
    spark = records.sparkSession
    own = ("record_id", "uri", "ts", "kind", "etag", "last_modified", "headers", "payload")
    keyed = records.select(*own, canonical_url(F.col("uri")).alias("uri_key"))
    responses = keyed.where("kind = 'response' AND uri_key IS NOT NULL AND ts IS NOT NULL AND record_id IS NOT NULL")
    revisits = keyed.where("kind = 'revisit'")
    slim = F.struct("record_id", "etag", "last_modified")
    points = responses.select("uri_key", "ts", slim.alias("response")).union(
        revisits.where("uri_key IS NOT NULL AND ts IS NOT NULL").select("uri_key", "ts", F.lit(None).cast(responses.select(slim.alias("s")).schema["s"].dataType))
    )
    timeline = durable(points.groupBy("uri_key", "ts").agg(F.max("response").alias("response")))
    cells = 4 * shuffle_width(spark)
    width = max(1, -(-timeline.count() // cells))
    placed = durable(
        positioned(timeline, "ts", F.lit(1)).select("uri_key", "ts", "response", F.expr(f"_index div {width}").alias("cell"))
    )
    seen = F.when(F.col("response").isNotNull(), F.struct("ts", "response"))
    placed = placed.withColumn("seen", seen)
    passed = placed.groupBy("uri_key", "cell").agg(F.max("seen").alias("held"))
    earlier = Window.partitionBy("uri_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = passed.select("uri_key", "cell", F.last("held", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("uri_key", "cell").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    latest = (
        placed.withColumn("near", F.last("seen", ignorenulls=True).over(inside))
        .join(carried, ["uri_key", "cell"])
        .select("uri_key", "ts", F.coalesce("near", "carried").alias("seen"))
        .where("seen IS NOT NULL")
        .select("uri_key", "ts", F.col("seen.response").alias("found"), F.col("seen.ts").alias("found_ts"))
    )
    asked = revisits.join(latest, ["uri_key", "ts"], "left")
    bare = lambda tag: F.regexp_replace(tag, "^[Ww]/", "")
    differ = lambda name: F.coalesce(bare(F.col(name)) != bare(F.col(f"found.{name}")), F.lit(False))
    status = (
        F.when(F.col("found").isNull(), "orphan").when(differ("etag") | differ("last_modified"), "stale").otherwise("resolved")
    )
    asked = asked.select(
        "record_id", "uri_key", F.col("found.record_id").alias("resolved_id"), F.col("found_ts"), status.alias("status"), F.col("headers").alias("fresh")
    )
    asked = durable(asked)
    on = ["resolved_id", "uri_key", "found_ts"]
    named = responses.withColumnsRenamed({"record_id": "resolved_id", "ts": "found_ts"})
    fits = asked.where("status = 'resolved'")
    wanted = durable(fits.groupBy(*on).agg(F.count("*").alias("n")))
    order = F.struct("etag", "last_modified", "payload")
    stored = named.join(wanted, on).groupBy(*on, "n").agg(F.max_by(F.struct(F.col("headers").alias("stored"), "payload"), order).alias("s"))
    got = salted_join(fits, stored, on, counted=wanted)
    headers = merge_headers(F.col("s.stored"), F.col("fresh")).alias("headers")
    got = got.select("record_id", "uri_key", "resolved_id", "status", headers, F.col("s.payload").alias("payload"))
    none = [F.lit(None).cast(got.schema[c].dataType).alias(c) for c in ("headers", "payload")]
    return got.union(asked.where("status != 'resolved'").select("record_id", "uri_key", "resolved_id", "status", *none))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log over pages: each page is fetched once, and asked for again a little later.

    The second request spells the URL in another way; some name a page that was never fetched, some carry another
    validator.
    """
    own = F.col("page_id")
    date = lambda ts: F.create_map(F.lit("date"), ts.cast("string"))
    first, later = own * 4, own * 4 + 2 + own % 3
    tag = F.md5(F.coalesce("html", F.lit("")))
    respelt = F.when(own % 2 == 0, F.concat("url", F.lit("#again"))).otherwise(F.regexp_replace("url", "^http:", "https:"))
    respelt = F.when(own % 11 == 0, F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/missing"))).otherwise(respelt)
    got = F.map_concat(date(first), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag))
    asked = F.map_concat(date(later), F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=60")))
    none = F.lit(None).cast("string")
    responses = pages.select(
        (own * 2).alias("record_id"), F.col("url").alias("uri"), first.alias("ts"), F.lit("response").alias("kind"),
        tag.alias("etag"), none.alias("last_modified"), got.alias("headers"), F.col("html").alias("payload"),
    )
    again = pages.select(
        (own * 2 + 1).alias("record_id"), respelt.alias("uri"), later.alias("ts"), F.lit("revisit").alias("kind"),
        F.when(own % 5 == 0, F.md5(own.cast("string"))).otherwise(tag).alias("etag"), none.alias("last_modified"),
        asked.alias("headers"), none.alias("payload"),
    )
    return responses.union(again)
