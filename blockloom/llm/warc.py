"""Resolution of not-modified revisit records in web archives.

A revisit record says that a server answered "not modified". It is resolved by
the latest earlier full response for the same canonical address: validators
must agree, and the revisit's headers that a not-modified answer may update
are merged over the response's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Headers that a 304 answer may update (RFC 9110, section 15.4.5), and tracking parameters.
UPDATABLE = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"
#: Time units of one step of the as-of join.
SPAN = 4096


def canonical(url: Column) -> Column:
    """The address without scheme, fragment, default port, tracking parameters and closing slashes.

    The host is lower case and parameters are sorted; a null address is null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each revisit record: what it refers to and its full headers.

    ``records`` has ``record_id, url, at`` (a time in whole units), ``kind``
    (``response`` or ``revisit``), ``headers`` (a map with lower-case names)
    and ``payload_digest``. Returns ``record_id, url, at, refers_to, outcome,
    payload_digest, headers``.

    ``refers_to`` is the response that comes last before the revisit by (at,
    record_id), at the same canonical address. Entity tags are compared
    weakly; without them modification times are compared; without both the
    payload digests. The outcome is ``resolved``, ``no earlier response``,
    ``validator mismatch`` or ``no validator``; payload and merged headers come
    only with the first, otherwise the headers are the revisit's own.

    Records without an address, time or id are no candidates, and as revisits
    have no earlier response; null headers are none; repeated records are
    resolved each; other kinds and columns are ignored; an empty table gives
    none.

    The join is two-levelled: within a span of time rows look back in their
    (address, span) group, beyond it at the last response of each earlier span.
    So an address with any share of all records is dealt over its spans.
    """
    none = F.create_map().cast("map<string,string>")
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "url", F.col("at").cast("bigint").alias("at"), "kind", F.coalesce("headers", none).alias("headers"), "payload_digest",
        canonical(F.col("url")).alias("address"), F.floor(F.col("at") / span).cast("bigint").alias("span"),
    )
    placed = F.col("address").isNotNull() & F.col("at").isNotNull() & F.col("record_id").isNotNull()
    full = F.when(F.col("kind") == "response", F.struct("at", "record_id", F.to_json("headers").alias("known"), "payload_digest"))
    known = rows.where(placed).withColumn("full", full)
    group = ["address", "span"]
    near = F.last("full", ignorenulls=True).over(W.partitionBy(*group).orderBy("at", "record_id").rowsBetween(W.unboundedPreceding, -1))
    ends = known.where("full is not null").groupBy(*group).agg(F.max("full").alias("full"))
    # Spans of an address that have revisits look at the spans before them.
    asked = known.where("full is null").select(*group).distinct()
    steps = asked.join(ends, group, "full")
    earlier = F.last("full", ignorenulls=True).over(W.partitionBy("address").orderBy("span").rowsBetween(W.unboundedPreceding, -1))
    steps = steps.select(*group, earlier.alias("before"))
    looked = known.withColumn("near", near).where("full is null").join(steps, group, "left").withColumn("found", F.coalesce("near", "before"))
    looked = looked.drop("full", "near", "before").unionByName(rows.where(~placed & (F.col("kind") == "revisit")).withColumn("found", F.lit(None).cast(looked.schema["found"].dataType)))

    old = F.from_json("found.known", "map<string,string>")
    looked = looked.withColumn("old", old)
    etag, was = _strong(F.col("headers")["etag"]), _strong(F.col("old")["etag"])
    time, then = F.col("headers")["last-modified"], F.col("old")["last-modified"]
    digest = F.col("payload_digest")
    agree = (
        F.when(etag.isNotNull(), etag.eqNullSafe(was)).when(time.isNotNull(), time.eqNullSafe(then))
        .when(digest.isNotNull(), digest.eqNullSafe(F.col("found.payload_digest")))
    )
    outcome = (
        F.when(F.col("found").isNull(), "no earlier response").when(agree.isNull(), "no validator").when(agree, "resolved").otherwise("validator mismatch")
    )
    looked = looked.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    fresh = F.map_filter("headers", lambda k, v: F.lower(k).isin(UPDATABLE) & v.isNotNull())
    kept = F.map_filter("old", lambda k, v: ~F.map_contains_key(fresh, k))
    return looked.select(
        "record_id", "url", "at", F.when(good, F.col("found.record_id")).alias("refers_to"), "outcome",
        F.when(good, F.col("found.payload_digest")).alias("payload_digest"),
        F.when(good, F.map_concat(kept, fresh)).otherwise(F.col("headers")).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    """The headers as sorted ``name: value`` lines."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(lines, "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """An archive of the pages: full answers, and later ones that say "not modified".

    Four units of time are one page. Pages whose number is divisible by 3
    share sixteen addresses. A page's response comes first, but is missing
    where the number leaves 2 over multiples of 5; its revisit comes three
    units on, or 20,003 where the number is divisible by 13. So a revisit may
    meet its own page's response, another page's of any span before, or none.

    Revisits of numbers divisible by 5 hold a tag that no response had, of
    other numbers divisible by 7 only a modification time, and of others
    divisible by 11 no validator. Of the rest, those that leave 0 or 3 over
    multiples of 9 ask for an edition, which responses have that leave 0.
    """
    n, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    tag, day = F.concat(F.lit('"'), digest, F.lit('"')), (n % 28).cast("string")
    edition = F.lit('"edition"')
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    shared = F.concat(F.lit("https://shared.example/"), (n % 16).cast("string"))
    url = F.when(F.col("url").isNotNull() & (n % 3 == 0), shared).otherwise(F.col("url")).alias("url")

    def headers(**of: Column) -> Column:
        return F.map_filter(F.create_map(*[x for k, v in of.items() for x in (F.lit(k.replace("_", "-")), v)]), lambda _, v: v.isNotNull())

    known = F.when(n % 9 == 0, edition).otherwise(tag)
    first = headers(content_type=F.lit("text/html"), content_length=length, etag=known, last_modified=day, cache_control=F.lit("max-age=60"))
    wanted = F.when((n % 9).isin(0, 3), edition).otherwise(tag)
    again = headers(
        etag=F.when(n % 5 == 0, '"none"').when((n % 7 == 0) | (n % 11 == 0), None).otherwise(F.concat(F.lit("W/"), wanted)),
        last_modified=F.when((n % 5 != 0) & (n % 7 == 0), day), cache_control=F.lit("max-age=90"), server=F.lit("edge"), content_length=F.lit("0"),
    )
    late = n * 4 + F.when(n % 13 == 0, 20003).otherwise(3)
    full = pages.where(n % 5 != 2).select((n * 2).alias("record_id"), url, (n * 4).alias("at"), F.lit("response").alias("kind"), first.alias("headers"), digest.alias("payload_digest"))
    return full.unionByName(pages.select((n * 2 + 1).alias("record_id"), url, late.alias("at"), F.lit("revisit").alias("kind"), again.alias("headers"), F.lit(None).cast("string").alias("payload_digest")))
