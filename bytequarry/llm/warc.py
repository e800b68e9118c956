"""Web archive revisits: not-modified records resolved to the latest earlier full response.

An as-of join by canonical URL and time. It never sorts a URL's whole history
in one task: times are cut into ranges at quantiles, so that neither outliers nor
bunched captures put most records in one (only records of one URL and one time
can't be parted), the last response of each URL and range
is aggregated before the shuffle, carried over the ranges (few rows a URL), and
only records of one URL and range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import below, ranges, table

#: Headers that a 304 answer may replace in the stored response (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Lower-case host without scheme, ``www.``, user and default port; path without fragment, tracking parameters and closing slashes."""
    plain = F.regexp_replace(F.trim(url), "(?i)^https?://", "")
    plain = F.regexp_replace(plain, "#.*$", "")
    host = F.regexp_extract(plain, "^([^/?]*)", 1)
    rest = F.substring(plain, F.length(host) + 1, F.length(plain))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(host), "^[^@]*@", ""), r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), r"\?&", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/+$", ""))


def _plain_etag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """All rows and columns of ``records`` with what their revisits refer to.

    Records have record_id (long), url, time (long), kind ('response' or
    'revisit'), digest and headers (map of lower-case names). Added are url_key,
    refers_to and refers_time (the latest response of the canonical URL at an
    earlier time; of several at that time the largest record_id), status and
    merged_headers. Status is 'response', 'resolved', 'mismatch' (entity tags,
    or without both of them modification dates, differ), 'unverified' (no
    validator on both sides) or 'no_original'. Tags compare weakly. A resolved
    or unverified revisit has the response's headers with the permitted ones
    of its own in their place; other revisits have none, responses their own.

    Null urls and null times never resolve; other kinds get a null status and
    pass. Repeated revisits are resolved each. An empty table gives no rows.
    Columns with the added names are replaced.
    """
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = ("url_key", "refers_to", "refers_time", "status", "merged_headers")
    records = records.select(*(c for c in records.columns if c not in added)).withColumn("url_key", canonical_url(F.col("url")))
    bounds = ranges(records, "time", parts)
    records = records.withColumn("_bq_range", below(F.col("time"), bounds).cast("long"))
    usable = (F.col("kind") == "response") & F.col("url_key").isNotNull() & F.col("time").isNotNull()
    offer = F.struct(F.col("time").alias("t"), F.col("record_id").alias("id"), "digest", F.to_json("headers").alias("headers"))

    last = records.where(usable).groupBy("url_key", "_bq_range").agg(F.max(F.struct("time", "record_id")).alias("at"))
    points = last.union(records.where("kind = 'revisit'").select("url_key", "_bq_range", F.lit(None).alias("at")).distinct()).groupBy("url_key", "_bq_range").agg(F.max("at").alias("at"))
    earlier = Window.partitionBy("url_key").orderBy("_bq_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = points.withColumn("carried", F.last("at", ignorenulls=True).over(earlier)).where("carried is not null").select(F.col("url_key").alias("_bq_k"), F.col("_bq_range").alias("_bq_r"), F.col("carried").alias("_bq_carried"))

    # Within a range: the latest response at an earlier time, by ranks of time and not of rows.
    # Rows that have no place there, however many, are dealt out by number.
    alone = F.when(F.col("url_key").isNull() | F.col("time").isNull() | ~F.coalesce(F.col("kind").isin("response", "revisit"), F.lit(False)), F.xxhash64("record_id", "url", "time"))
    order = Window.partitionBy("url_key", "_bq_range", alone).orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    near = F.max(F.when(usable, F.struct("time", "record_id"))).over(order)
    keyed = records.withColumn("_bq_near", near)
    keyed = keyed.join(carried, (F.col("url_key") == F.col("_bq_k")) & (F.col("_bq_range") == F.col("_bq_r")), "left").drop("_bq_k", "_bq_r")
    keyed = keyed.withColumn("_bq_at", F.when(F.col("kind") == "revisit", F.coalesce("_bq_near", "_bq_carried"))).drop("_bq_near", "_bq_carried")
    pick = records.where(usable).groupBy(F.col("url_key").alias("_bq_k"), F.col("time").alias("_bq_t"), F.col("record_id").alias("_bq_i")).agg(F.max(offer).alias("_bq_o"))
    out = keyed.join(pick, (F.col("url_key") == F.col("_bq_k")) & (F.col("_bq_at.time") == F.col("_bq_t")) & (F.col("_bq_at.record_id") == F.col("_bq_i")), "left").drop("_bq_k", "_bq_t", "_bq_i", "_bq_range")
    mine, theirs = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.coalesce(F.from_json("_bq_o.headers", "map<string,string>"), F.create_map().cast("map<string,string>"))
    out = out.withColumn("_bq_mine", mine).withColumn("_bq_theirs", theirs)
    tag_a, tag_b = _plain_etag(F.col("_bq_mine")), _plain_etag(F.col("_bq_theirs"))
    date_a, date_b = F.col("_bq_mine")["last-modified"], F.col("_bq_theirs")["last-modified"]
    found = F.when(tag_a.isNotNull() & tag_b.isNotNull(), F.when(tag_a == tag_b, "resolved").otherwise("mismatch")).when(date_a.isNotNull() & date_b.isNotNull(), F.when(date_a == date_b, "resolved").otherwise("mismatch")).otherwise("unverified")
    status = F.when(F.col("kind") == "response", "response").when(F.col("kind") == "revisit", F.when(F.col("_bq_o").isNull(), "no_original").otherwise(found))
    out = out.withColumn("status", status)
    fresh = F.map_filter("_bq_mine", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("_bq_theirs", lambda k, v: ~(k.isin(*PERMITTED) & F.array_contains(F.map_keys("_bq_mine"), k)))
    merged = F.when(F.col("kind") == "response", F.col("headers")).when(F.col("status").isin("resolved", "unverified"), F.map_concat(kept, fresh))
    return out.withColumn("merged_headers", merged).withColumn("refers_to", F.col("_bq_at.record_id")).withColumn("refers_time", F.col("_bq_at.time")).drop("_bq_at", "_bq_o", "_bq_mine", "_bq_theirs")


def header_line(headers: Column) -> Column:
    """Headers as one line: name=value by name, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture records of the pages table: a full response of every page, and a not-modified answer after it.

    The answer comes an hour of the crawl (100 pages) later, by the other scheme
    and with a tracking parameter. Of seven pages one has a stale entity tag, of
    five one has its modification date only, and of eleven one no validator.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    when = lambda t: F.concat(F.lit("tick "), t.cast("string"))
    time = F.col("page_id") * 10
    full = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), when(time), F.lit("etag"), F.concat(F.lit('"'), "digest", F.lit('"')), F.lit("last-modified"), day)
    later = time + 1005
    none = F.lit(None).cast("string")
    tag = F.when(F.col("page_id") % 7 == 0, F.lit('"stale"')).when((F.col("page_id") % 5 == 0) | (F.col("page_id") % 11 == 0), none).otherwise(F.concat(F.lit('W/"'), "digest", F.lit('"')))
    modified = F.when((F.col("page_id") % 11 == 0) & (F.col("page_id") % 7 != 0), none).otherwise(day)
    answer = F.map_filter(F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-type"), F.lit("text/plain"), F.lit("date"), when(later), F.lit("etag"), tag, F.lit("last-modified"), modified), lambda k, v: v.isNotNull())
    other = F.concat(F.when(F.col("url").startswith("https"), F.lit("http")).otherwise(F.lit("https")), F.regexp_replace("url", "^https?|#.*$", ""))
    other = F.concat(other, F.when(F.instr(other, "?") > 0, "&").otherwise("?"), F.lit("utm_medium=again"))
    responses = pages.select((F.col("page_id") * 2).alias("record_id"), "url", time.alias("time"), F.lit("response").alias("kind"), "digest", full.alias("headers"))
    return responses.union(pages.select((F.col("page_id") * 2 + 1).alias("record_id"), other.alias("url"), later.alias("time"), F.lit("revisit").alias("kind"), none.alias("digest"), answer.alias("headers")))


def page_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve(page_records(spark, sf_dir))
    return done.select("record_id", "kind", "url_key", "time", "refers_to", "refers_time", "status", header_line(F.col("merged_headers")).alias("merged"))


REVISIT_SQL = r"""
with pages_ as (
  select page_id, url, md5(coalesce(html, '')) as digest, 'day ' || (page_id % 28) as day, page_id * 10 as t from pages
), other as (
  select *, case when url like 'https%' then 'http' else 'https' end || regexp_replace(url, '^https?|#.*$', '', 'g') as u from pages_
), records as (
  select page_id * 2 as record_id, url, t as time, 'response' as kind, '"' || digest || '"' as etag, day as modified from pages_
  union all
  select page_id * 2 + 1, u || case when instr(u, '?') > 0 then '&' else '?' end || 'utm_medium=again', t + 1005, 'revisit',
         case when page_id % 7 = 0 then '"stale"' when page_id % 5 = 0 or page_id % 11 = 0 then null else 'W/"' || digest || '"' end,
         case when page_id % 11 = 0 and page_id % 7 <> 0 then null else day end
  from other
), cut as (
  select *, regexp_replace(regexp_replace(trim(url), '^https?://', '', 'i'), '#.*$', '') as plain from records
), parted as (
  select *, regexp_extract(plain, '^([^/?]*)', 1) as host from cut
), keyed as (
  select record_id, time, kind, etag, modified,
    regexp_replace(regexp_replace(regexp_replace(lower(host), '^[^@]*@', ''), '^www\.', ''), ':(80|443)$', '') ||
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(plain, length(host) + 1),
      '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/+$', '') as url_key
  from parted
), best as (
  select v.record_id, max(struct_pack(t := r.time, i := r.record_id)) as at
  from keyed v join keyed r on v.url_key = r.url_key and r.kind = 'response' and r.time < v.time where v.kind = 'revisit' group by v.record_id
), joined as (
  select v.*, b.at.i as refers_to, b.at.t as refers_time, o.etag as o_etag, o.modified as o_modified
  from keyed v left join best b on v.record_id = b.record_id left join keyed o on o.record_id = b.at.i
), judged as (
  select *, case when kind = 'response' then 'response' when refers_to is null then 'no_original'
    when etag is not null then case when replace(etag, 'W/', '') = o_etag then 'resolved' else 'mismatch' end
    when modified is not null then case when modified = o_modified then 'resolved' else 'mismatch' end
    else 'unverified' end as status
  from joined
)
select record_id, kind, url_key, time, refers_to, refers_time, status,
  case when kind = 'response' then 'content-type=text/html;date=tick ' || time || ';etag=' || etag || ';last-modified=' || modified
       when status in ('resolved', 'unverified') then 'cache-control=max-age=60;content-type=text/html;date=tick ' || time || ';etag=' || coalesce(etag, o_etag) || ';last-modified=' || o_modified
  end as merged
from judged
"""
