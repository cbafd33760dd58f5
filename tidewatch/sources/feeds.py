"""Feeds and pages that have been landed as files, to rows of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import html, text
from tidewatch.functions.indicators import host
from tidewatch.operators.views import top_per

#: Items that a source keeps of one pull.
MOST_ITEMS = 40
ITEM = "title string, link string, description string, contentSnippet string, summary string, pubDate string, isoDate string, updated string"


def rss(spark: SparkSession, path: str, source: str, tag: str = "item") -> DataFrame:
    """Entries of RSS (tag item) or Atom (tag entry) files: title, url, description, published_at, source_name.

    Entries need a title and a link. Dates that cannot be read are null, never wrong.
    """
    raw = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(ITEM).load(path)
    body = F.coalesce("contentSnippet", "description", "summary")
    rows = raw.select(text.to_ascii(F.col("title")).alias("title"), F.trim("link").alias("url"), text.clean(body).alias("description"), text.feed_date(F.coalesce("isoDate", "pubDate", "updated")).alias("published_at"), F.lit(source).alias("source_name"))
    return rows.where("title <> '' and url <> ''")


def entries(fetched: DataFrame, tag: str = "item") -> DataFrame:
    """Entries of fetched feeds (source_name, body: the XML): title, url, description, published_at, source_name; as rss(), from a column."""
    items = fetched.select("source_name", F.explode(F.regexp_extract_all("body", F.lit(rf"(?is)<{tag}[ >].*?</{tag}>"), F.lit(0))).alias("x"))
    raw = items.select("source_name", F.from_xml("x", ITEM).alias("i")).select("source_name", "i.*")
    body = F.coalesce("contentSnippet", "description", "summary")
    rows = raw.select(text.to_ascii(F.col("title")).alias("title"), F.trim("link").alias("url"), text.clean(body).alias("description"), text.feed_date(F.coalesce("isoDate", "pubDate", "updated")).alias("published_at"), "source_name")
    return rows.where("title <> '' and url <> ''")


#: The host's end and the path's beginning of listing pages, and patterns of an item, its link, description and time, by reader.
READERS = {
    "cert-eu-blog": (
        "cert.europa.eu", "/blog",
        r'(?is)<article class="news--articles--item">.*?</article>',
        r'(?is)<h3[^>]*class="news--articles--item--title"[^>]*>.*?<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>',
        r'(?is)<p[^>]*class="news--articles--item--description"[^>]*>(.*?)</p>',
        r'(?is)<time[^>]*class="news--articles--item--time"[^>]*>(.*?)</time>',
    )
}


def reader_for(url: Column) -> Column:
    """The name of the reader for a listing page's URL, null if there is none."""
    at, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH"))
    found = F.lit(None).cast("string")
    for name, (end, start, *_) in READERS.items():
        found = F.when(at.endswith(end) & path.startswith(start), name).otherwise(found)
    return found


def read_listing(pages: DataFrame) -> DataFrame:
    """page_id, reader, url, title, description, published_at of the items of listing pages (page_id, html, base: the page's URL).

    Each page is read by its URL's reader. Items need a title and a link; one without a date that can be read has none. A page that no
    reader knows, or without items, is an error: it has one row with a null url, and errors() tells of it.
    """
    empty = F.array().cast("array<struct<href:string,title:string,description:string,time:string>>")
    found, reader = empty, reader_for(F.col("base"))
    for name, (_, _, *patterns) in READERS.items():
        found = F.when(reader == name, html.listing(F.col("html"), *patterns)).otherwise(found)
    rows = pages.select("page_id", "base", reader.alias("reader"), F.explode_outer(found).alias("i"))
    root = F.regexp_extract("base", "^https?://[^/?#]+", 0)
    absolute = F.when(F.col("i.href").rlike("^https?://"), F.col("i.href")).when(F.col("i.href").startswith("/"), F.concat(root, "i.href")).otherwise(F.concat(F.regexp_extract("base", "^https?://[^?#]*/|^https?://[^/?#]+", 0), F.col("i.href")))
    return rows.select("page_id", "reader", F.when(F.col("i").isNotNull(), absolute).alias("url"), "i.title", F.nullif(F.substring("i.description", 1, 500), F.lit("")).alias("description"), text.listing_date(F.col("i.time")).alias("published_at"))


def errors(listed: DataFrame) -> DataFrame:
    return listed.where("url is null").select("page_id", F.when(F.col("reader").isNull(), "no reader").otherwise("no items").alias("error")).distinct()


def newest(candidates: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """The newest candidates of each source; undated ones last, ties by ord."""
    return top_per(candidates, "source_name", most, F.col("published_at").desc_nulls_last(), F.col("ord"))


def health(kept: DataFrame, failed: DataFrame) -> DataFrame:
    """source_name, items, latest_item_at, error for every source pulled."""
    ok = kept.groupBy("source_name").agg(F.count("*").alias("items"), F.max("published_at").alias("latest_item_at"))
    return ok.join(failed.select("source_name", "error"), "source_name", "full_outer").withColumn("items", F.coalesce("items", F.lit(0)))


def source_of(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """url with the source whose feed or site has its host, the first by name; null where a new one is needed."""
    known = sources.select("name", F.explode(F.array(host(F.col("feed_url")), host(F.col("url")))).alias("h")).where("h <> ''").groupBy("h").agg(F.min("name").alias("source"))
    return urls.withColumn("_h", host(F.col("url"))).join(known, F.col("_h") == F.col("h"), "left").drop("_h", "h")


def fresh_name(base: Column, taken: Column) -> Column:
    """base, or base (n) with the least n from 2 that is not taken; taken is an array of names."""
    tries = F.concat(F.array(base), F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")"))))
    return F.get(F.filter(tries, lambda t: ~F.array_contains(taken, t)), F.lit(0))


def created(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources that a batch of articles (ord, url, site_name) makes: domain, name, url, for each domain that no source has.

    The first article of a domain names its source: its site's name or, where that is taken, the name with the least free number from 2
    on, as if articles came one after the other. The k-th new source of a name gets the k-th gap among the numbers taken, so nothing is
    counted up one by one. A site whose own name ends in such a number keeps it; no other gets it.
    """
    domain = host(F.col("url"))
    open_ = source_of(articles, sources).where("source is null").where(domain != "")
    origin = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    first = open_.groupBy(domain.alias("domain")).agg(F.min(F.struct("ord", "site_name", origin.alias("url"))).alias("f")).select("domain", F.col("f.ord").alias("ord"), F.col("f.site_name").alias("base"), "f.url")
    new = first.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("ord", "domain")))
    # a name is number 1 of itself, and, if it ends in a number, that one of what stands before
    numbered = F.regexp_extract("name", r" \(([1-9][0-9]{0,8})\)\z", 1)
    both = F.array(F.struct(F.col("name").alias("base"), F.lit(1).alias("n")), F.struct(F.regexp_replace("name", r" \([0-9]+\)\z", "").alias("base"), F.when(numbered != "", numbered.cast("int")).alias("n")))
    names = sources.select("name").unionByName(new.where(F.col("base").rlike(r" \([1-9][0-9]{0,8}\)\z")).select(F.col("base").alias("name"))).distinct()
    # those sites whose own name ends in a number are no hindrance to themselves
    own = sources.select("name").distinct().withColumn("had", F.lit(True))
    used = names.join(own, "name", "left").select("had", F.inline(both)).where("n is not null and (had or n > 1)")
    taken = used.groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("taken")).withColumnRenamed("base", "of")
    placed = new.join(taken, F.col("base") == F.col("of"), "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    # before the i-th taken number there are taken - i free ones (i from 1): those with fewer than k are passed over
    number = F.col("k") + F.size(F.filter("taken", lambda t: t - F.array_position(F.col("taken"), t) < F.col("k")))
    return placed.select("domain", F.when(number == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), number.cast("string"), F.lit(")"))).alias("name"), "url")
