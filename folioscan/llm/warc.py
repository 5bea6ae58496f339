"""Not-modified revisits in web archives, resolved to the response they stand for.

A revisit record says that a page was unchanged: it has headers but no body. It is joined as of its capture time to the
latest earlier full response for the same canonical URL. If both have an entity tag, or else a modification time, these
must agree; if not, the revisit is a mismatch and gets no body. A resolved revisit has the response's headers, but for
those that a not-modified reply may renew.

A URL may have any share of all captures: captures are joined within ranges of time, and each range starts with the
latest response of the URL's earlier ranges, so no task holds a whole URL.

A null or empty URL matches nothing (status `no_url`). A null time matches nothing either (`no_time`). Captures at
the same time are ordered by id; a response isn't earlier than itself. A response without headers has none to keep, so
the revisit's permitted ones are the result. Repeated rows are resolved each; an empty table gives no rows. Bodies are
neither read nor moved; a resolved revisit names its response, by which they can be joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import settle

#: Headers that a not-modified reply carries for the stored response (RFC 9110, section 15.4.5).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age")
#: Ranges of time into which captures are cut.
RANGES = 512


def canonical(url: Column) -> Column:
    """Scheme, www prefix, default port, fragment, tracking parameters and closing slash removed; host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))), "&")
    return F.when(url.isNull() | (host == ""), F.lit(None)).otherwise(F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def resolved(captures: DataFrame) -> DataFrame:
    """Revisits with their response.

    captures has record_id long, kind (`response` or `revisit`), url, at (capture time, long) and headers
    (map of lower-case names). The result has the revisit's record_id, url_key, at, status (`resolved`,
    `mismatch`, `no_response`, `no_url` or `no_time`), response_id, response_at and headers.
    """
    rows = captures.select("record_id", "kind", canonical(F.col("url")).alias("url_key"), "at", "headers")
    usable = rows.filter("url_key IS NOT NULL AND at IS NOT NULL")
    span = usable.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    low, width = span["low"] or 0, max(1, -(-((span["high"] or 0) - (span["low"] or 0) + 1) // RANGES))
    # Decimals, as the distance of two longs may not be one.
    ranged = usable.withColumn("_range", F.expr(f"(cast(at AS decimal(20,0)) - {low}) div cast({width} AS decimal(20,0))"))
    response = F.struct("at", F.col("record_id").alias("id"), "headers")
    placed = F.when(F.col("kind") == "response", response)
    latest = ranged.filter("kind = 'response'").groupBy("url_key", "_range").agg(F.max(F.struct("at", "record_id")).alias("_last"))
    # The latest response before each range of its URL, for ranges with a revisit.
    carried = latest.select("url_key", "_range", "_last", F.lit(0).alias("_asks")).unionByName(
        ranged.filter("kind = 'revisit'").select("url_key", "_range").distinct().select("url_key", "_range", F.lit(None).cast("struct<at:bigint,record_id:bigint>").alias("_last"), F.lit(1).alias("_asks"))
    )
    before = Window.partitionBy("url_key").orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("_carried", F.max("_last").over(before)).filter("_asks = 1 AND _carried IS NOT NULL")
    heads = carried.select("url_key", "_range", F.col("_carried.at").alias("at"), F.col("_carried.record_id").alias("record_id"))
    heads = heads.join(usable.filter("kind = 'response'").select("url_key", "at", "record_id", "headers"), ["url_key", "at", "record_id"])
    heads = heads.select("record_id", F.lit("response").alias("kind"), "url_key", "at", "headers", "_range")
    inside = Window.partitionBy("url_key", "_range").orderBy("at", "record_id", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.unionByName(heads).withColumn("_found", F.last(placed, ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    lost = rows.filter("kind = 'revisit' AND (url_key IS NULL OR at IS NULL)").withColumns({"_range": F.lit(None).cast("long"), "_found": F.lit(None).cast(joined.schema["_found"].dataType)})
    joined = joined.unionByName(lost)
    tags = [F.col("headers")["etag"], F.col("_found.headers")["etag"]]
    dates = [F.col("headers")["last-modified"], F.col("_found.headers")["last-modified"]]
    both = [x[0].isNotNull() & x[1].isNotNull() for x in (tags, dates)]
    weak = [F.regexp_replace(t, "^W/", "") for t in tags]
    agrees = F.when(both[0], weak[0] == weak[1]).when(both[1], dates[0] == dates[1]).otherwise(F.lit(True))
    status = F.when(F.col("url_key").isNull(), "no_url").when(F.col("at").isNull(), "no_time").when(F.col("_found").isNull(), "no_response").when(agrees, "resolved").otherwise("mismatch")
    renewed = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*RENEWED))
    stored = F.map_filter(F.coalesce(F.col("_found.headers"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(renewed, k))
    out = joined.withColumn("status", status)
    merged = F.when(F.col("status") == "resolved", F.map_concat(stored, renewed)).otherwise(F.col("headers"))
    ok = F.col("status") == "resolved"
    return out.select("record_id", "url_key", "at", "status", F.when(ok, F.col("_found.id")).alias("response_id"), F.when(ok, F.col("_found.at")).alias("response_at"), merged.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Captures as a crawl of pages would leave them: each page in full, in the order of ids, and a revisit of it after the last one.

    The entity tag is the body's digest, so a revisit agrees with the latest page of its URL only if that has its body.
    Both captures of a page have its id; times stop at the largest long.
    """
    last = pages.agg(F.max("page_id")).first()[0] or 0
    later = F.expr(f"cast(least(cast(page_id AS decimal(20,0)) + {last} + 1, {2**63 - 1}) AS long)")
    tag = F.concat(F.lit('"'), F.sha1(F.coalesce(F.col("html"), F.lit(""))), F.lit('"'))
    size = F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    narrow = settle(pages.select("page_id", "url", tag.alias("tag"), size.alias("size")))
    full = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"), F.lit("etag"), F.col("tag"), F.lit("date"), F.col("page_id").cast("string"))
    again = F.create_map(F.lit("etag"), F.col("tag"), F.lit("date"), later.cast("string"), F.lit("server"), F.lit("cache"))
    responses = narrow.select(F.col("page_id").alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("at"), full.alias("headers"))
    revisits = narrow.select(F.col("page_id").alias("record_id"), F.lit("revisit").alias("kind"), "url", later.alias("at"), again.alias("headers"))
    return responses.unionByName(revisits)


def report(pages: DataFrame) -> DataFrame:
    found = resolved(captures(pages))
    names = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select(F.col("record_id").alias("page_id"), "url_key", "status", F.col("response_id").alias("response_page_id"), names.alias("headers"))
