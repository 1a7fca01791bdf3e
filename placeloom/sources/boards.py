"""Job boards: payloads of eight providers to one posting shape, and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeloom.functions import extract
from placeloom.operators import diff
from placeloom.operators.cut import cut

# provider -> (path of the list, {column: paths in order}); fixed values of the providers' formats
FORMATS = {
    "greenhouse": ("$.jobs", dict(title=["$.title"], url=["$.absolute_url"], location=["$.location.name"], posted_at=["$.updated_at"])),
    "lever": ("$", dict(title=["$.text"], url=["$.hostedUrl", "$.applyUrl"], location=["$.categories.location"], department=["$.categories.team", "$.categories.department"], employment_type=["$.categories.commitment"])),
    "ashby": ("$.jobs", dict(title=["$.title"], url=["$.jobUrl", "$.applyUrl"], location=["$.location"], department=["$.department", "$.team"], employment_type=["$.employmentType"], posted_at=["$.publishedAt"])),
    "recruitee": ("$.offers", dict(title=["$.title"], url=["$.careers_url", "$.careers_apply_url"], location=["$.location", "$.city"], department=["$.department"], employment_type=["$.employment_type_code"], posted_at=["$.published_at"])),
    "workable": ("$.jobs", dict(title=["$.title"], url=["$.url", "$.application_url"], department=["$.department"], employment_type=["$.type"], posted_at=["$.published_on"])),
    "teamtailor": ("$.jobs", dict(title=["$.title"], url=["$.careersite_job_url", "$.url"], location=["$.location"], department=["$.department"])),
    "smartrecruiters": ("$.content", dict(title=["$.name"], location=["$.location.fullLocation", "$.location.city"], department=["$.department.label"], employment_type=["$.typeOfEmployment.label"], posted_at=["$.releasedDate"])),
}
FIELDS = ["title", "url", "location", "department", "employment_type", "posted_at"]


def postings(boards: DataFrame) -> DataFrame:
    """``boards(provider, token, payload)`` -> ``(provider, token, title, url, location, department, employment_type, posted_at)``.

    Unreadable payloads and providers without a public format give no rows; a posting without a title is "(untitled)".
    """
    out = None
    for provider, (path, fields) in FORMATS.items():
        d = boards.where(F.col("provider") == provider).select("provider", "token", F.explode(F.coalesce(F.try_variant_get(F.try_parse_json("payload"), path, "array<variant>"), F.array().cast("array<variant>"))).alias("j"))
        first = lambda paths: F.coalesce(*[F.nullif(F.trim(F.try_variant_get("j", p, "string")), F.lit("")) for p in paths])
        cols = {f: first(fields[f]) if f in fields else F.lit(None).cast("string") for f in FIELDS}
        if provider == "workable":
            cols["location"] = F.nullif(F.concat_ws(", ", first(["$.city"]), first(["$.country"])), F.lit(""))
        if provider == "lever":
            cols["posted_at"] = F.date_format(F.timestamp_millis(F.try_variant_get("j", "$.createdAt", "long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        if provider == "smartrecruiters":
            cols["url"] = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.coalesce(first(["$.company.identifier"]), F.col("token")), F.lit("/"), first(["$.id"]))
        part = d.select("provider", "token", *[(F.coalesce(c, F.lit("(untitled)")) if f == "title" else c).alias(f) for f, c in cols.items()])
        out = part if out is None else out.unionByName(part)
    return out.unionByName(_personio(boards))


def one_of_each(jobs: DataFrame, place: str = "place_id", order: str = "ord") -> DataFrame:
    """One posting per place, title and location, case aside: the same opening may stand on two boards. The first stays."""
    same = F.lower(F.concat_ws("|", "title", F.coalesce("location", F.lit(""))))
    return diff.first_seen(jobs, F.struct(F.col(place), same), F.col(order))


def boards_of_place(found: DataFrame) -> DataFrame:
    """``found(place_id, ord, provider, token)`` of all pages of a place -> each board once, where it was first seen."""
    return found.groupBy("place_id", "provider", "token").agg(F.min("ord").alias("ord"))


def _personio(boards: DataFrame) -> DataFrame:
    """XML positions; descriptions are cut first since they repeat tag names."""
    p = boards.where("provider = 'personio'").select("provider", "token", F.explode(F.regexp_extract_all("payload", F.lit(r"(?is)<position>(.*?)</position>"), F.lit(1))).alias("x"))
    p = p.withColumn("x", F.regexp_replace("x", r"(?is)<jobDescriptions>.*?</jobDescriptions>", ""))

    def tag(name: str) -> Column:
        raw = F.regexp_extract("x", rf"(?is)<{name}>(.*?)</{name}>", 1)
        inner = F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
        for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            inner = F.replace(inner, F.lit(entity), F.lit(plain))
        return F.nullif(F.trim(inner), F.lit(""))

    return p.select(
        "provider", "token", F.coalesce(tag("name"), F.lit("(untitled)")).alias("title"), F.concat(F.lit("https://"), "token", F.lit(".jobs.personio.de/job/"), tag("id")).alias("url"),
        tag("office").alias("location"), tag("department").alias("department"), tag("employmentType").alias("employment_type"), tag("createdAt").alias("posted_at"),
    )


def _sitemap_items(files: DataFrame, *keep: str) -> DataFrame:
    """Entries of ``body`` in their order: ``(keep..., pos, loc, lastmod, is_index)``. Entries of an index and ``sitemap`` blocks are nested files."""
    items = F.regexp_extract_all("body", F.lit(r"(?is)(<(sitemap|url)\b.*?</\2>)"), F.lit(1))
    d = files.select(*keep, F.col("body").rlike(r"(?i)<sitemapindex\b").alias("whole"), F.posexplode(items).alias("pos", "x"))

    def get(tag: str) -> Column:
        raw = F.regexp_extract("x", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
        inner = F.regexp_replace(raw, r"(?s)^.*?<!\[CDATA\[(.*?)\]\]>.*$", "$1")
        plain = extract.decode_entities(F.regexp_replace(inner, "<[^>]+>", " "))
        return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))

    nested = F.col("whole") | F.col("x").rlike("(?i)^<sitemap")
    return d.select(*keep, "pos", get("loc").alias("loc"), get("lastmod").alias("lastmod"), nested.alias("is_index")).where("loc is not null")


def sitemap_entries(files: DataFrame, most: int = 3) -> DataFrame:
    """``files(site, ord, body)`` -> ``(site, loc, lastmod, is_index)``: pages and nested sitemaps of the first ``most`` files
    that were read of a site."""
    files = files.withColumn("rn", F.row_number().over(W.partitionBy("site").orderBy("ord"))).where(F.col("rn") <= most)
    return _sitemap_items(files, "site").select("site", "loc", "lastmod", "is_index")


def follow_sitemaps(spark: SparkSession, starts: DataFrame, bodies: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Follow sitemap indexes over recorded answers, breadth first, each file of a site once and at most ``most`` a site.

    ``starts(site, ord, url)`` are the files a site names itself, ``bodies(url, body)`` what each answered; a file without an answer
    counts as read and is empty. Returns ``asked(site, rank, url)``, ranks from 1 in order of reading, and ``entries(site, rank, pos, loc, lastmod)``.
    A round reads all files of its depth that a site may still read; as each takes one at least, there are ``most`` rounds at most, fewer if no site
    has anything left. Waiting files are kept by site, so a round joins what is asked for with the answers and never reads entries again.
    """
    waiting = starts.where("site is not null and url is not null").select("site", "url", F.array(F.col("ord").cast("long")).alias("place"))
    asked = entries = None
    for _ in range(most):
        first = waiting.groupBy("site", "url").agg(F.min("place").alias("place"))
        if asked is not None:
            first = first.join(asked.select("site", "url"), ["site", "url"], "left_anti")
            used = asked.groupBy("site").agg(F.count("*").alias("used"))
            first = first.join(used, "site", "left")
        else:
            first = first.withColumn("used", F.lit(0).cast("long"))
        rank = F.coalesce("used", F.lit(0)) + F.row_number().over(W.partitionBy("site").orderBy("place"))
        now = cut(spark, first.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("site", "rank", "url", "place"))
        if now.isEmpty():
            break
        found = cut(spark, _sitemap_items(now.join(bodies.select("url", "body"), "url"), "site", "rank", "place"))
        asked = now.drop("place") if asked is None else asked.unionByName(now.drop("place"))
        pages = found.where("not is_index").select("site", "rank", "pos", "loc", "lastmod")
        entries = pages if entries is None else entries.unionByName(pages)
        waiting = found.where("is_index").select("site", F.col("loc").alias("url"), F.array(F.col("rank"), F.col("pos").cast("long")).alias("place"))
    if asked is None:
        asked = waiting.select("site", F.lit(0).cast("long").alias("rank"), "url")
        entries = asked.select("site", "rank", F.lit(0).alias("pos"), F.col("url").alias("loc"), F.col("url").alias("lastmod")).where("false")
    return asked, entries


def sitemap_summary(entries: DataFrame) -> DataFrame:
    """Pages per site and the newest lastmod, compared as text."""
    return entries.where("not is_index").groupBy("site").agg(F.count("*").alias("urls"), F.max("lastmod").alias("last_content_at"))
