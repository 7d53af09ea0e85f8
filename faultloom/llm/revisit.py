"""Resolution of WARC revisit records that say "not modified".

A revisit of the server-not-modified profile has no body: it stands for the latest earlier full response of the same
page. `resolve_revisits` finds it by an as-of join on the canonical URL, checks that the revisit's validators
(ETag compared weakly, Last-Modified) agree with it, takes its payload, and merges the headers: those that a 304
response may update replace the stored ones, the others stay as stored.

Status of a record: "response" (a full response), "resolved", "mismatch" (a validator that both
sides have differs: an ETag decides over a date), "unverified" (the revisit and the response share no validator; it is
resolved as the profile allows) or "orphan" (no earlier response). Mismatches and orphans get no payload.

How it is dealt out: the as-of join is one pass of windows and never meets a page's whole history in one
task. The records of a page are split into blocks of capture time; each block hands on its last full
response, a window over blocks (one row each) carries it to the blocks after, and a window within a block does the
rest. So a page with a third of all records spreads over its blocks. The window carries only the
reference and its headers; payloads are joined afterwards, by the record's id, to the revisits alone.

Edge cases: records without a canonical URL or a time are orphans if revisits; of records of one time, the lower record id
is earlier; an empty table gives an empty result; repeated rows resolve alike;
a revisit without a record id is an orphan, as it can't be told apart; other columns pass through, but page, status and refers_to are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Headers that a 304 response may carry for the stored one to be updated by (fixed values, RFC 9110 section 15.4.5 and RFC 9111 section 3.2).
UPDATED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Scheme, "www.", port 80 or 443, fragment, a trailing slash and the order of parameters don't count; host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: p != "")), "&")
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def header_map(lines: Column) -> Column:
    """Headers by lower-case name from "Name: value" lines; the last of a repeated name holds."""
    parts = F.filter(F.split(lines, r"\r?\n"), lambda x: F.position(F.lit(":"), x) > 1)
    entry = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.position(F.lit(":"), x) + 1)).alias("v"))
    pairs = F.transform(parts, entry)
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"].alias("value"))))


#: What a record must have.
_OWN = ("record_id", "url", "captured", "kind", "headers", "payload")


def resolve_revisits(records: DataFrame, block: Column | None = None) -> DataFrame:
    """The records (record_id, url, captured, kind, headers: map, payload, …) with page, status, refers_to, merged headers and payload.

    kind: "response" or "revisit"; `block` dates a record's block of capture time, by default its day.
    """
    # Columns of the records that the result defines itself are replaced; the caller's others lie in a struct, so no name of theirs meets one used here.
    kept = [c for c in records.columns if c not in ("page", "status", "refers_to")]
    others = [c for c in kept if c not in _OWN]
    page, time = canonical_url(F.col("url")), F.col("captured")
    block = block if block is not None else F.date_trunc("day", time.cast("timestamp"))
    held = records.select(*_OWN, *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("wv_others")] if others else []), page.alias("page"), block.alias("wv_block"))
    full = (F.col("kind") == "response") & F.col("page").isNotNull() & time.isNotNull()
    own = F.when(full, F.struct(time.alias("captured"), "record_id", F.col("headers").alias("headers")))
    narrow = held.select("record_id", "page", "wv_block", "captured", "kind", "headers", own.alias("own"))
    last = narrow.where("own IS NOT NULL").groupBy("page", "wv_block").agg(F.max_by("own", F.struct("captured", "record_id")).alias("own"))
    blocks = narrow.where("page IS NOT NULL").select("page", "wv_block").distinct().join(last, ["page", "wv_block"], "left")
    before = Window.partitionBy("page").orderBy("wv_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("page", "wv_block", F.last("own", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("page", "wv_block").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = narrow.withColumn("inside", F.last("own", ignorenulls=True).over(within)).join(carried, ["page", "wv_block"], "left")
    usable = F.col("page").isNotNull() & F.col("captured").isNotNull()
    seen = seen.withColumn("ref", F.when((F.col("kind") == "revisit") & usable, F.coalesce("inside", "carried")))
    mine, theirs = F.col("headers"), F.col("ref.headers")
    tag = lambda h: F.regexp_replace(h["etag"], r"^W/", "")
    agree = F.coalesce(tag(mine) == tag(theirs), mine["last-modified"] == theirs["last-modified"])
    status = (
        F.when(F.col("kind") != "revisit", "response").when(F.col("ref").isNull(), "orphan")
        .when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    )
    fresh = F.map_filter(mine, lambda k, _: k.isin(UPDATED))
    stored = F.map_filter(theirs, lambda k, _: ~F.map_contains_key(fresh, k))
    good = F.col("status").isin("resolved", "unverified")
    seen = seen.withColumn("status", status)
    found = seen.where("kind = 'revisit'").select("record_id", "status", F.when(good, F.col("ref.record_id")).alias("refers_to"), F.when(good, F.map_concat(stored, fresh)).alias("merged"))
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("wv_payload"))
    found = found.join(bodies, "refers_to", "left").dropDuplicates(["record_id"])
    out = held.drop("wv_block").join(found, "record_id", "left")
    return out.select(
        *(F.col("wv_others")[c].alias(c) if c in others else F.col(c) for c in kept if c not in ("payload", "headers")), "page", F.coalesce("status", F.when(F.col("kind") == "revisit", "orphan").otherwise("response")).alias("status"), "refers_to",
        F.coalesce("merged", "headers").alias("headers"), F.when(F.col("kind") == "revisit", F.col("wv_payload")).otherwise(F.col("payload")).alias("payload"),
    )


def crawl_of(pages: DataFrame) -> DataFrame:
    """The pages as a crawl of two rounds: each is fetched in full, and again ten days later, when most answer 304.

    Every page whose id is divisible by 5 fails in the first round; of the second round's answers, ids that leave 1 by 7 have another ETag.
    """
    day = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(86_400 * n) + F.pmod("page_id", F.lit(7)) * 86_400 + F.pmod("page_id", F.lit(86_400)))
    tag = F.md5(F.coalesce("html", F.lit("")))
    first = F.concat(F.lit('Content-Type: text/html\nETag: "'), tag, F.lit('"\nServer: a\nDate: first'))
    again = F.concat(F.lit('ETag: W/"'), F.when(F.pmod("page_id", F.lit(7)) == 1, F.lit("other")).otherwise(tag), F.lit('"\nServer: b\nDate: again'))
    full = pages.where("page_id % 5 <> 0").select((F.col("page_id") * 2).alias("record_id"), "url", day(0).alias("captured"), F.lit("response").alias("kind"), header_map(first).alias("headers"), F.col("html").alias("payload"))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", day(10).alias("captured"), F.lit("revisit").alias("kind"), header_map(again).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(revisit)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(crawl_of(table(spark, sf_dir, "pages").where("page_id IS NOT NULL")))
    h = F.col("headers")
    return out.select("record_id", "page", "status", "refers_to", h["server"].alias("server"), h["date"].alias("date"), h["etag"].alias("etag"), F.sha2("payload", 256).alias("payload_sha256"))


SQL = {
    "op4_warc_revisits": r"""
WITH p AS (SELECT page_id, html, md5(coalesce(html, '')) AS tag, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(regexp_replace(bare, '^[^/?]*', ''), '^[^?]*'), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '')), '&') AS query FROM p),
u AS (SELECT page_id, html, tag, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS page,
    1700000000 + (page_id % 7) * 86400 + page_id % 86400 AS t FROM q),
f AS (SELECT page_id * 2 AS id, page, t, tag, html FROM u WHERE page_id % 5 <> 0),
r AS (SELECT page_id * 2 + 1 AS id, page, t + 864000 AS t, CASE WHEN page_id % 7 = 1 THEN 'other' ELSE tag END AS tag FROM u),
m AS (SELECT r.id, r.page, r.tag, f.id AS ref, f.tag AS old, f.html, row_number() OVER (PARTITION BY r.id ORDER BY f.t DESC NULLS LAST, f.id DESC) AS k
    FROM r LEFT JOIN f ON f.page = r.page AND f.t <= r.t)
SELECT id AS record_id, page, CASE WHEN ref IS NULL THEN 'orphan' WHEN tag = old THEN 'resolved' ELSE 'mismatch' END AS status,
    CASE WHEN tag = old THEN ref END AS refers_to, CASE WHEN tag = old THEN 'a' ELSE 'b' END AS server, 'again' AS date,
    'W/"' || tag || '"' AS etag, CASE WHEN tag = old THEN sha256(html) END AS payload_sha256 FROM m WHERE k = 1
UNION ALL SELECT id, page, 'response', NULL, 'a', 'first', '"' || tag || '"', sha256(html) FROM f""",
}
