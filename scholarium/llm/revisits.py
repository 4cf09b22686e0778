"""WARC not-modified revisits: an as-of join, by canonical URL, to the latest earlier full response.

One URL may have a third of all records, so a URL's records are cut at fixed points in time: windows run inside a
(URL, stretch) and the last response of each earlier stretch is handed on, one row a stretch. A stretch in which one URL
has more than MOST records is cut finer, for this URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarium.llm.frames import materialise, small

#: The stretches into which the time from the first to the last record is cut, at least; more for many records.
STRETCHES = 512
#: Records of one URL in a stretch above which it is cut, so that about so many are in a part; parts of a stretch at most.
MOST, FINEST = 100_000, 1 << 20
# Header fields that a 304 response may bring up to date.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that name a campaign or referrer, not a page.
TRACKING = "utm_[^=]*|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, www. and default port, path without trailing slash, query sorted and without
    tracking parameters; scheme and fragment go (first, as a fragment may hold what looks like a query). Null for what has
    no host."""
    url = F.regexp_extract(url, r"^\s*([^#\s]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?]+)", 1)), r"^([^@]*@)?(www\.)?|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^\w+://[^/?]+([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(url, r"\?(.*)", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))
    return F.when(host != "", F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, stretches: int = STRETCHES, most: int = MOST) -> DataFrame:
    """For each revisit: record_id, url_key, at, outcome, response_id, headers (array of name, value, sorted).

    records: record_id long, url string, at timestamp, type ('response' or 'revisit'), headers map. Names are compared in
    lower case. outcome: 'resolved'; 'mismatch' if ETags (weakly) or, lacking those, modification dates differ;
    'unverified' if there is nothing to compare; 'missing' if no response is earlier. Only a resolved revisit has a
    response_id and headers: those of the response, brought up to date by the permitted ones of the revisit.

    Strictly earlier counts; of responses at one time the largest record_id. Null or hostless URLs and null times find
    nothing and are found by none; null headers are none. Bodies are not looked at, however long. Repeated rows are resolved one by one. Other columns are ignored.
    """
    entries = F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    rows = records.select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("at").cast("timestamp").alias("at"), "type", F.array_sort(entries).alias("headers"))
    one = lambda name: F.try_element_at(F.filter("headers", lambda e: e["name"] == name), F.lit(1))["value"]
    rows = rows.where("type in ('response', 'revisit')").withColumns({"us": F.unix_micros("at"), "etag": one("etag"), "modified": one("last-modified")})
    placed = F.col("url_key").isNotNull() & F.col("us").isNotNull()
    astray = rows.where(~placed & (F.col("type") == "revisit"))
    rows = rows.where(placed)
    low, high, n = rows.agg(F.min("us"), F.max("us"), F.count("*")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(stretches, n // most)))
    since = F.col("us") - F.lit(low or 0)
    rows = rows.withColumns({"stretch": F.floor(since / F.lit(width)), "inside": since % F.lit(width)})
    busy = rows.groupBy("url_key", "stretch").agg(F.count("*").alias("c")).where(F.col("c") > most)
    busy = materialise(busy.select(F.col("url_key").alias("_key"), F.col("stretch").alias("_stretch"), F.least(F.lit(FINEST), F.ceil(F.col("c") / most)).alias("cuts")))  # a row for `most` records at least
    rows = rows.join(small(busy), (F.col("url_key") == F.col("_key")) & (F.col("stretch") == F.col("_stretch")), "left")
    rows = rows.withColumn("stretch", F.col("stretch") * FINEST + F.coalesce(F.floor(F.col("inside") * (F.col("cuts") / F.lit(width))), F.lit(0))).drop("_key", "_stretch", "cuts", "inside")
    rows = rows.withColumn("full", F.when(F.col("type") == "response", F.struct("us", "record_id", "etag", "modified", "headers")))
    lasts = rows.groupBy("url_key", "stretch").agg(F.max("full").alias("last_full"))
    handed = lasts.withColumn("handed", F.max("last_full").over(Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("url_key").alias("_key"), F.col("stretch").alias("_stretch"), "handed")
    within = Window.partitionBy("url_key", "stretch").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("inside", F.max("full").over(within)).where("type = 'revisit'")
    joined = seen.join(handed.where("handed is not null"), (F.col("url_key") == F.col("_key")) & (F.col("stretch") == F.col("_stretch")), "left")
    found = joined.withColumn("found", F.coalesce("inside", "handed"))
    both = lambda a: F.col(a).isNotNull() & F.col(f"found.{a}").isNotNull()
    outcome = (
        F.when(F.col("found").isNull(), "missing")
        .when(both("etag"), F.when(_weak(F.col("etag")) == _weak(F.col("found.etag")), "resolved").otherwise("mismatch"))
        .when(both("modified"), F.when(F.col("modified") == F.col("found.modified"), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    news = F.filter("headers", lambda e: e["name"].isin(PERMITTED))
    merged = F.array_sort(F.concat(F.filter("found.headers", lambda e: ~F.array_contains(F.transform(news, lambda x: x["name"]), e["name"])), news))
    done = found.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    done = done.select("record_id", "url_key", "at", "outcome", F.when(ok, F.col("found.record_id")).alias("response_id"), F.when(ok, merged).alias("headers"))
    return done.unionByName(astray.select("record_id", "url_key", "at", F.lit("missing").alias("outcome")), allowMissingColumns=True)


def crawl_records(pages: DataFrame) -> DataFrame:
    """Records of a crawl derived from pages: each is fetched in the order of page_id and asked for again later (every
    13th earlier), with its ETag, its weak form, another one, or only a date."""
    base, h = F.lit(1_700_000_000), F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 5), 16, 10).cast("long")
    fetched = base + F.col("page_id") * 60
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    date = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss")
    base_map = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), date(fetched), F.lit("ETag"), etag, F.lit("Last-Modified"), date(fetched - 3600))
    responses = pages.select(F.col("page_id").cast("long").alias("record_id"), "url", F.timestamp_seconds(fetched).alias("at"), F.lit("response").alias("type"), base_map.alias("headers"))
    again = F.when(h % 13 == 0, fetched - 1800).otherwise(fetched + 60 * (1 + h % 5000))
    dated = F.create_map(F.lit("Date"), date(again), F.lit("Last-Modified"), date(fetched - 3600), F.lit("Content-Type"), F.lit("text/plain"))
    tagged = lambda e: F.map_concat(dated, F.create_map(F.lit("ETag"), e))
    headers = F.when(h % 5 == 0, dated).when(h % 11 == 0, tagged(F.lit('"other"'))).when(h % 7 == 0, tagged(F.concat(F.lit("W/"), etag))).otherwise(tagged(etag))
    revisits = pages.select((F.col("page_id").cast("long") + (1 << 40)).alias("record_id"), "url", F.timestamp_seconds(again).alias("at"), F.lit("revisit").alias("type"), headers.alias("headers"))
    return responses.unionByName(revisits)
