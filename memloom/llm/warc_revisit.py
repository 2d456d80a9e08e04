"""Not-modified revisits of a web archive: an as-of join to the latest earlier full response.

Captures: record_id, url, at (a time as a long), kind (`response` or `revisit`), etag, last_modified,
headers (map), digest (of the payload). A revisit takes the payload of the last response before it, by
(at, record_id), with the same canonical URL, if the validators agree: entity tags where both have one (weakly
compared), else Last-Modified where both have one.

The join is a window over a URL and a slice of time, and what was last in earlier slices is carried
over on one row a URL and slice. Slices hold about equally many captures, whatever their times, so a URL
with a third of all captures is still many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import materialize

#: Captures in a slice of time, about, and the most slices: their bounds are a list on the driver.
SLICE_ROWS, SLICES = 50_000, 4096
#: Headers that a not-modified answer may renew (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = "^(utm_[^=]*|fbclid|gclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and a default port, path without a trailing slash, sorted query without tracking; no scheme, no fragment. Null if there is no host."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), "(:80|:443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that become equal the last value stays. Null: no headers."""
    entries = F.coalesce(F.map_entries(headers), F.expr("CAST(array() AS array<struct<key:string,value:string>>)"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e.key)))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e.key) == n), -1).value))


def merged(full: Column, renewed: Column) -> Column:
    """full's headers, with those renewed that are permitted."""
    new = F.map_filter(renewed, lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(full, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def slice_bounds(captures: DataFrame, slice_rows: int) -> list[float]:
    """Times that part the captures into about equal slices: approximate quantiles, at most SLICES - 1."""
    n = captures.count()
    slices = min(SLICES, -(-n // slice_rows))
    if slices < 2:
        return []
    shares = [i / slices for i in range(1, slices)]
    return sorted({float(x) for x in captures.agg(F.percentile_approx("at", shares, 10 * slices)).first()[0] or []})


def resolve(captures: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per capture: record_id, canonical_url, kind, status, refers_to, digest, headers.

    status: `response`; `resolved`; `unverified` (no validator to compare); `mismatch`; `orphan` (no earlier response, or
    no usable url or time). Only resolved and unverified revisits get refers_to, digest and merged headers. Any kind other than
    `response` is a revisit; of captures with one time the smaller record_id is earlier, a null one first; repeated rows are
    captures of their own; other columns are ignored; an empty table gives no rows.
    """
    c = captures.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("canonical_url"), F.col("at").cast("long").alias("at"),
        F.when(F.col("kind") == "response", "response").otherwise("revisit").alias("kind"), "etag", "last_modified", lower_names(F.col("headers")).alias("headers"), "digest",
    )
    c = materialize(c, "captures")
    full = F.when(F.col("kind") == "response", F.struct("at", "record_id", "etag", "last_modified", "headers", "digest"))
    placed = c.where("canonical_url IS NOT NULL AND at IS NOT NULL").withColumn("full", full)
    bounds = slice_bounds(placed, slice_rows)
    if bounds:
        from pyspark.ml.feature import Bucketizer  # here, since it is large

        # equal times are equal as doubles too, so slices follow the times
        cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="slice_at", outputCol="slice")
        placed = cut.transform(placed.withColumn("slice_at", F.col("at").cast("double"))).drop("slice_at")
    else:
        placed = placed.withColumn("slice", F.lit(0.0))
    group = Window.partitionBy("canonical_url", "slice").orderBy("at", "record_id")
    inside = placed.withColumn("inside", F.last("full", ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, -1)))
    ends = placed.where("kind = 'response'").groupBy("canonical_url", "slice").agg(F.max_by("full", F.struct("at", "record_id")).alias("end"))
    slices = placed.select("canonical_url", "slice").distinct().join(ends, ["canonical_url", "slice"], "left")
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = slices.withColumn("before", before).where("before IS NOT NULL").select("canonical_url", "slice", "before")
    found = inside.join(carried, ["canonical_url", "slice"], "left").withColumn("r", F.coalesce("inside", "before"))
    aside = c.where("canonical_url IS NULL OR at IS NULL")
    rows = found.select(*c.columns, "r").unionByName(aside.withColumn("r", F.lit(None).cast(found.schema["r"].dataType)))
    strong = lambda t: F.regexp_replace(t, "^W/", "")
    tags = strong(F.col("etag")) == strong(F.col("r.etag"))
    dates = F.col("last_modified") == F.col("r.last_modified")
    status = (
        F.when(F.col("kind") == "response", "response")
        .when(F.col("r").isNull(), "orphan")
        .when(F.coalesce(tags, dates).isNull(), "unverified")
        .when(F.coalesce(tags, dates), "resolved")
        .otherwise("mismatch")
    )
    rows = rows.withColumn("status", status)
    own, taken = F.col("kind") == "response", F.col("status").isin("resolved", "unverified")
    return rows.select(
        "record_id", "canonical_url", "kind", "status",
        F.when(taken, F.col("r.record_id")).alias("refers_to"),
        F.when(own, F.col("digest")).when(taken, F.col("r.digest")).alias("digest"),
        F.when(own, F.col("headers")).when(taken, merged(F.col("r.headers"), F.col("headers"))).alias("headers"),
    )


def table_captures(pages: DataFrame) -> DataFrame:
    """Two full crawls of the pages and three rounds of revisits, one before each crawl and one after the last.

    Revisits carry the entity tag and date of the crawl before; some have none, a foreign tag, or those of the crawl before that one.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    known = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("tag"), digest.alias("sha"))
    p, none = F.col("page_id"), F.lit(None).cast("string")
    no_tag, no_date = p % 5 == 2, p % 6 == 1

    def response(j: int) -> Column:
        at = p + j * 1_000_000_000
        names = [F.lit("CONTENT-TYPE"), F.lit("x"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), at.cast("string")]
        headers = F.when(p % 2 == 0, F.create_map(*names, F.lit("Cache-Control"), F.lit("no-store"))).otherwise(F.create_map(*names))
        return F.struct(
            (p * 8 + j).alias("record_id"), at.alias("at"), F.lit("response").alias("kind"), F.when(~no_tag, F.concat("tag", F.lit(f":{j}"))).alias("etag"),
            F.when(~no_date, F.lit(f"day {j}")).alias("last_modified"), headers.alias("headers"), F.concat("sha", F.lit(f":{j}")).alias("digest"),
        )

    def revisit(i: int) -> Column:
        at = p + (i * 1_000_000_000 - 500_000_000)
        tag = F.when(p % 7 == 3, F.concat(F.lit("x"), "tag")).when(p % 4 == 1, F.concat("tag", F.lit(f":{i - 2}"))).otherwise(F.concat(F.lit("W/"), "tag", F.lit(f":{i - 1}")))
        date = F.when((p + i) % 3 == 0, F.lit(f"day {i - 2}")).otherwise(F.lit(f"day {i - 1}"))
        headers = F.create_map(F.lit("Date"), at.cast("string"), F.lit("Set-Cookie"), F.lit("a=1"), F.lit("CACHE-control"), F.lit(f"max-age={i}"))
        return F.struct(
            (p * 8 + 4 + i).alias("record_id"), at.alias("at"), F.lit("revisit").alias("kind"), F.when(~no_tag, tag).alias("etag"),
            F.when(~no_date, date).alias("last_modified"), headers.alias("headers"), none.alias("digest"),
        )

    captures = F.array(*map(response, range(2)), *map(revisit, range(3)))
    return known.select("url", F.explode(captures).alias("c")).select("url", "c.*")


def summary(resolved: DataFrame) -> DataFrame:
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e.key, e.value)))
    return resolved.withColumn("headers", F.array_join(entries, "\n"))
