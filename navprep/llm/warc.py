"""Not-modified revisits of web captures: an as-of join by canonical URL to the latest earlier full response, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

#: Header fields that a 304 response may bring up to date (RFC 9110, section 15.4.5). Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Width of a time bucket: captures of one URL within it meet in one window.
BUCKET = 1_000_000


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default port, fragment, tracking parameters (utm_*, ref) and closing slash; the host in lower case."""
    x = F.regexp_replace(F.trim(url), "#.*$", "")
    x = F.regexp_replace(x, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(x, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[.]", "")
    rest = F.regexp_replace(F.regexp_extract(x, "^[^/?]*(.*)$", 1), "([?&])(utm_[a-z]*|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "[&]+", "&"), "[?]&", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/$", ""))


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """record_id, url_key, ts, state, response_id, status, headers for every revisit of records.

    records: record_id long, kind ('response' or 'revisit'), url, ts long, status int, etag, last_modified, headers map<string, string> (names in lower case).
    state: 'resolved' if the latest full response (status 200) strictly before the revisit has the revisit's ETag, or, where the revisit brings none, its
    Last-Modified, or if it brings neither; 'changed' if they differ; 'missing' if there is no such response. A resolved revisit has the response's
    status and headers, of which the permitted ones are replaced by the revisit's; others have none.

    Equal times: the response of larger record_id is the later. A null URL or time is 'missing' and no response to others; a null map is empty; repeated rows are
    resolved each. A URL's captures are dealt by time buckets, and the last response of each bucket is carried on by a window over buckets.
    """
    r = records.select("record_id", "kind", F.col("ts").cast("long").alias("ts"), "status", "etag", "last_modified", F.coalesce("headers", F.expr("cast(map() as map<string, string>)")).alias("headers"), canonical_url(F.col("url")).alias("url_key"))
    r = r.withColumn("bucket", F.floor(F.col("ts") / bucket))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    r = r.where(full | (F.col("kind") == "revisit")).withColumn("response", F.when(full, F.struct("ts", "record_id", "status", "etag", "last_modified", "headers")))
    earlier = W.partitionBy("url_key", "bucket").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    plain = F.struct("ts", "record_id")
    # revisits without a URL or time are missing: they stay out of windows and joins, where all would meet
    placed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    ids = r.where(placed).select("url_key", "bucket", "ts", "record_id", "kind", F.when(full, plain).alias("own"))
    inside = ids.withColumn("asof", F.max("own").over(earlier))
    by_bucket = ids.where("own is not null").groupBy("url_key", "bucket").agg(F.max("own").alias("top"))
    steps = ids.select("url_key", "bucket").distinct().join(by_bucket, ["url_key", "bucket"], "left")
    carry = steps.withColumn("carried", F.max("top").over(W.partitionBy("url_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("url_key", "bucket", "carried")
    found = inside.where("kind = 'revisit'").select("record_id", "ts", "url_key", "bucket", "asof").join(carry.where("carried is not null"), ["url_key", "bucket"], "left")
    found = found.select("record_id", "ts", "url_key", F.coalesce(F.col("asof"), F.col("carried")).alias("asof")).distinct()
    revisits = r.where("kind = 'revisit'").select("record_id", "ts", "url_key", "etag", "last_modified", "headers")
    here = (F.col("v.ts") == F.col("f.ts")) & (F.col("v.url_key") == F.col("f.url_key")) & F.col("v.record_id").eqNullSafe(F.col("f.record_id"))
    both = revisits.alias("v").join(found.alias("f"), here, "left").select("v.*", F.col("f.asof.record_id").alias("response_id"), F.col("f.asof.ts").alias("response_ts"))
    # those without a response are dealt by a hash of their own, not all by null
    both = both.withColumn("at", F.coalesce("response_ts", F.xxhash64("record_id", "ts")))
    original = r.where(full).select(F.col("url_key").alias("o_key"), F.col("ts").alias("o_ts"), F.col("record_id").alias("o_id"), F.lit(True).alias("there"), F.struct("status", "etag", "last_modified", "headers").alias("o"))
    # a response is told by URL, time and id: one id may name several
    same_one = (F.col("at") == F.col("o_ts")) & (F.col("url_key") == F.col("o_key")) & F.col("response_id").eqNullSafe(F.col("o_id")) & F.col("response_ts").isNotNull()
    x = both.join(original.dropDuplicates(["o_key", "o_ts", "o_id"]), same_one, "left")
    same = F.when(F.col("etag").isNotNull(), F.col("etag").eqNullSafe(F.col("o.etag"))).when(F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(F.col("o.last_modified"))).otherwise(True)
    state = F.when(F.col("there").isNull(), "missing").when(same, "resolved").otherwise("changed")
    may = F.array(*map(F.lit, PERMITTED))
    new = F.map_filter("headers", lambda k, _: F.array_contains(may, k))
    merged = F.map_concat(F.map_filter("o.headers", lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    done = F.col("state") == "resolved"
    return x.withColumn("state", state).select("record_id", "url_key", "ts", "state", "response_id", F.when(done, F.col("o.status")).alias("status"), F.when(done, merged).alias("headers"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures as a crawl of pages would hold them: each page's response and two later revisits by other forms of its URL, one of which comes before the response for
    each seventh page and brings another validator for each fifth."""
    h = F.md5(F.coalesce("html", F.lit("")))
    p = pages.select("page_id", "url", h.alias("h"), F.length(F.coalesce("html", F.lit(""))).alias("n"))
    text = lambda c: c.cast("string")
    base = F.col("page_id") * 1000
    response = F.struct((F.col("page_id") * 3).alias("record_id"), F.lit("response").alias("kind"), F.col("url"), base.alias("ts"), F.lit(200).alias("status"), F.col("h").alias("etag"), text(base).alias("last_modified"), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.col("n")), F.lit("date"), text(base), F.lit("cache-control"), F.lit("no-cache")).alias("headers"))
    t1 = F.when(F.col("page_id") % 7 == 0, base - 1).otherwise(base + 500)
    first = F.struct((F.col("page_id") * 3 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), t1.alias("ts"), F.lit(304).alias("status"), F.when(F.col("page_id") % 5 == 0, F.lit("other")).otherwise(F.col("h")).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), text(t1)).alias("headers"))
    t2 = base + 3_000_000
    second = F.struct((F.col("page_id") * 3 + 2).alias("record_id"), F.lit("revisit").alias("kind"), F.regexp_replace("url", "^https?", "http").alias("url"), t2.alias("ts"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("etag"), text(base).alias("last_modified"), F.create_map(F.lit("date"), text(t2), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"))
    return p.select(F.explode(F.array(response, first, second)).alias("r")).select("r.*")


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    pick = lambda k, a: F.col("headers")[k].alias(a)
    return out.select("record_id", "url_key", "ts", "state", "response_id", "status", pick("content-type", "content_type"), pick("content-length", "content_length"), pick("date", "header_date"), pick("cache-control", "cache_control"))


_REST = r"regexp_replace(regexp_extract(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]*|ref)=[^&]*', '\1', 'g')"
_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '')"
ORACLE = f"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) h, length(coalesce(html, '')) n, page_id * 1000 base FROM pages),
c AS (
  SELECT page_id * 3 record_id, 'response' kind, url, base ts, h etag, CAST(base AS VARCHAR) lm, 'text/html' ct, CAST(n AS VARCHAR) cl, CAST(base AS VARCHAR) d, 'no-cache' cc FROM p
  UNION ALL SELECT page_id * 3 + 1, 'revisit', url || '#again', CASE WHEN page_id % 7 = 0 THEN base - 1 ELSE base + 500 END, CASE WHEN page_id % 5 = 0 THEN 'other' ELSE h END, NULL, NULL, '0', CAST(CASE WHEN page_id % 7 = 0 THEN base - 1 ELSE base + 500 END AS VARCHAR), NULL FROM p
  UNION ALL SELECT page_id * 3 + 2, 'revisit', url, base + 3000000, NULL, CAST(base AS VARCHAR), NULL, NULL, CAST(base + 3000000 AS VARCHAR), 'max-age=60' FROM p),
k AS (SELECT *, {_HOST} || regexp_replace(regexp_replace(regexp_replace(regexp_replace({_REST}, '[&]+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/$', '') url_key FROM c),
o AS (SELECT * FROM k WHERE kind = 'response'),
j AS (SELECT v.record_id, v.url_key, v.ts, v.etag v_etag, v.lm v_lm, v.d v_d, v.cc v_cc, o.* EXCLUDE (record_id, url_key, ts, kind, url), o.record_id o_id,
        row_number() OVER (PARTITION BY v.record_id ORDER BY o.ts DESC, o.record_id DESC) rn
      FROM k v LEFT JOIN o ON o.url_key = v.url_key AND o.ts < v.ts WHERE v.kind = 'revisit'),
s AS (SELECT *, CASE WHEN o_id IS NULL THEN 'missing' WHEN (CASE WHEN v_etag IS NOT NULL THEN v_etag = etag WHEN v_lm IS NOT NULL THEN v_lm = lm ELSE true END) THEN 'resolved' ELSE 'changed' END state FROM j WHERE rn = 1)
SELECT record_id, url_key, ts, state, o_id response_id, CASE WHEN state = 'resolved' THEN 200 END status, CASE WHEN state = 'resolved' THEN ct END content_type,
  CASE WHEN state = 'resolved' THEN cl END content_length, CASE WHEN state = 'resolved' THEN v_d END header_date, CASE WHEN state = 'resolved' THEN coalesce(v_cc, cc) END cache_control
FROM s
"""
