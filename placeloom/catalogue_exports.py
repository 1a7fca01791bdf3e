"""Registered queries over real files: zip, bz2 and CSV exports, recordings of a run, an activity catalogue, followed sitemaps.

The files are written from the given tables by tasks and then read by the library's readers.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom import scratch_dir
from placeloom.catalogue import _base, _query, _table
from placeloom.sources import archives, boards, bulk, places, registers


def _archive_of(folder: str):
    """Two members of one group of rows: the first stored with its columns in another order, the second deflated; and one that is no CSV."""

    def write(group):
        import csv

        name = int(group["pack"].iloc[0])
        members = []
        for half, columns in ((0, ["note", "id", "name"]), (1, ["id", "name", "note"])):
            out = io.StringIO()
            w = csv.writer(out, lineterminator="\r\n")
            w.writerow([f" {c} " for c in columns])
            w.writerows(group.loc[group["half"] == half, columns].itertuples(index=False, name=None))
            members.append("﻿" + out.getvalue())
        whole = io.BytesIO()
        with zipfile.ZipFile(whole, "w") as z:
            z.writestr("a/first.csv", members[0], zipfile.ZIP_STORED)
            z.writestr("read.me", "not,a,table", zipfile.ZIP_DEFLATED)
            z.writestr("second.CSV", members[1], zipfile.ZIP_DEFLATED)
        system, inner = archives.locate(f"{folder}/{name:06d}.zip")
        with system.open_output_stream(inner) as f:
            f.write(whole.getvalue())
        return group[["pack"]].head(1)

    return write


ODD = """CASE s_suppkey % 4 WHEN 0 THEN concat('say "', s_name, '"') WHEN 1 THEN concat('two\\nlines, ', s_name) WHEN 2 THEN '' ELSE s_name END"""
ODD_SQL = """CASE s_suppkey % 4 WHEN 0 THEN 'say "' || s_name || '"' WHEN 1 THEN 'two' || chr(10) || 'lines, ' || s_name WHEN 2 THEN '' ELSE s_name END"""


@_query(f"SELECT s_suppkey::VARCHAR AS id, s_name AS name, {ODD_SQL} AS note FROM supplier")
def zip_exports(spark: SparkSession, d: str) -> DataFrame:
    """Archives of a stored and a deflated member each, read member by member in tasks; quotes, line ends, blanks, columns in any order."""
    where = scratch_dir(spark, "zip")
    rows = _base(spark, d, f"SELECT s_suppkey DIV 50 AS pack, CAST(s_suppkey % 2 AS INT) AS half, CAST(s_suppkey AS STRING) AS id, s_name AS name, {ODD} AS note FROM {{supplier}}", "supplier")
    rows.groupBy("pack").applyInPandas(_archive_of(where), "pack long").count()
    return archives.read_zip_csv(spark, where).select("id", "name", "note")


@_query(f"SELECT s_suppkey::VARCHAR AS id, s_name AS name, {ODD_SQL} AS note, s_nationkey::VARCHAR AS nation FROM supplier")
def csv_exports(spark: SparkSession, d: str) -> DataFrame:
    """CSV files with quoted line ends and doubled quotes."""
    where = f"{scratch_dir(spark, 'csv')}/rows"
    rows = _base(spark, d, f"SELECT CAST(s_suppkey AS STRING) AS id, concat(' ', s_name) AS name, {ODD} AS note, CAST(s_nationkey AS STRING) AS nation FROM {{supplier}}", "supplier")
    rows.write.csv(where, header=True, quoteAll=True, escape='"', sep=";", ignoreLeadingWhiteSpace=False)
    return bulk.read_csv(spark, where, sep=";").select("id", "name", "note", "nation")


@_query("SELECT doc_id, coalesce(length(text), -1)::BIGINT AS n_chars, lang FROM documents WHERE doc_id IS NOT NULL")
def bz2_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as JSON lines under bz2, with blank lines between, read in splits."""
    where = f"{scratch_dir(spark, 'bz2')}/lines"
    lines = _table(spark, d, "documents").where("doc_id is not null").select(F.to_json(F.struct("doc_id", "text", "lang")).alias("value"))
    lines.select(F.explode(F.array("value", F.lit(" "))).alias("value")).write.text(where, compression="bzip2")
    said = bulk.read_json_lines(spark, where).select(F.from_json("payload", "doc_id long, text string, lang string").alias("r")).select("r.*")
    return said.select("doc_id", F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("n_chars"), "lang")


@_query("SELECT 'target' AS lane, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 'osm', c_custkey, c_name FROM customer UNION ALL SELECT 'registry', s_suppkey, s_name FROM supplier")
def replayed_lanes(spark: SparkSession, d: str) -> DataFrame:
    """A recording of three lanes played back."""
    where = f"{scratch_dir(spark, 'lanes')}/recording"
    lane = lambda t, p: _table(spark, d, t).select(F.col(f"{p}key").alias("k"), F.col(f"{p[:2]}name").alias("name"))
    places.record_lanes(where, lane("nation", "n_nation"), lane("customer", "c_cust"), lane("supplier", "s_supp"))
    out = None
    for name, rows in places.load_lanes(spark, where).items():
        one = rows.select(F.lit(name).alias("lane"), "k", "name")
        out = one if out is None else out.unionByName(one)
    return out


@_query(
    """WITH c AS (SELECT DISTINCT lpad((p_partkey % 97)::VARCHAR, 2, '0') AS division, lpad((p_partkey % 97)::VARCHAR, 2, '0') || '.' || (p_partkey % 13)::VARCHAR || 'Z' AS code FROM part)
SELECT division, string_agg(code, '|' ORDER BY code) AS codes FROM c WHERE division::INT BETWEEN 10 AND 33 GROUP BY 1"""
)
def catalogue_divisions(spark: SparkSession, d: str) -> DataFrame:
    """Codes of manufacturing by division, out of a catalogue file."""
    where = f"{scratch_dir(spark, 'catalogue')}/codes"
    codes = _base(spark, d, "SELECT DISTINCT concat(lpad(CAST(p_partkey % 97 AS STRING), 2, '0'), '.', CAST(p_partkey % 13 AS STRING), 'Z') AS code, 'x, \"y\"' AS label FROM {part}", "part")
    codes.write.csv(where, header=True, quoteAll=True, escape='"')
    return registers.divisions_of_section(spark, where, "C").select("division", F.array_join("codes", "|").alias("codes"))


# which files a site's file j names: an index over an index, a cycle, repeats, a file that never answered
KIDS = """CASE WHEN j = 0 AND site % 3 = 1 THEN {o}1, 2, 1{c} WHEN j = 0 AND site % 3 = 2 THEN {o}9, 1, 3{c} WHEN j = 0 AND site % 12 = 3 THEN {o}1{c} WHEN j = 1 THEN {o}0, 3, 4{c} ELSE {o}{c} END"""
FILES = "SELECT page_id DIV 5 AS site, CAST(page_id % 5 AS INT) AS j FROM {pages}"
KIDS_SPARK, KIDS_SQL = KIDS.format(o="array(", c=")").replace("array()", "CAST(array() AS ARRAY<INT>)"), KIDS.format(o="[", c="]").replace("[]", "[]::INT[]")


@_query(
    rf"""WITH RECURSIVE f AS (SELECT page_id // 5 AS site, (page_id % 5)::INT AS j FROM pages), e AS (SELECT site, j, k.kid, k.pos FROM (SELECT site, j, unnest({KIDS_SQL}) AS kid, generate_subscripts({KIDS_SQL}, 1) AS pos FROM f) k),
w AS (SELECT DISTINCT site, 0 AS j, 0 AS level, ''::VARCHAR AS place FROM f UNION ALL SELECT w.site, e.kid, w.level + 1, w.place || lpad(e.pos::VARCHAR, 3, '0') FROM w JOIN e ON e.site = w.site AND e.j = w.j WHERE w.level < 3),
s AS (SELECT site, j, min(lpad(level::VARCHAR, 2, '0') || ':' || place) AS place FROM w GROUP BY ALL), r AS (SELECT site, j, row_number() OVER (PARTITION BY site ORDER BY place) AS rk FROM s),
u AS (SELECT r.site, r.rk, r.j FROM r JOIN f USING (site, j) WHERE rk <= 3 AND len({KIDS_SQL.replace("site", "f.site").replace("j =", "f.j =")}) = 0)
SELECT r.site, count(DISTINCT rk)::BIGINT AS asked, 2 * count(DISTINCT CASE WHEN (site, rk) IN (SELECT (site, rk) FROM u) THEN rk END)::BIGINT AS urls, (SELECT max('2024-0' || (u.j + 1)::VARCHAR || '-01') FROM u WHERE u.site = r.site) AS last_content_at FROM r WHERE rk <= 3 GROUP BY r.site"""
)
def followed_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """Index to index to files, in order, three files a site: cycles, repeats, missing answers, CDATA and entities."""
    url = lambda j: f"concat('https://s', CAST(site AS STRING), '.example/m?a=1&j=', CAST({j} AS STRING))"
    nested = f"concat('<sitemapindex xmlns=\"x\">', array_join(transform(kids, k -> concat('<sitemap>\\n<loc> ', replace({url('k')}, '&', '&amp;'), ' </loc></sitemap>')), ''), '</sitemapindex>')"
    plain = f"concat('<urlset><url><loc><![CDATA[', {url('j')}, ']]></loc><lastmod>2024-0', CAST(j + 1 AS STRING), '-01</lastmod></url><URL><loc>b</loc></URL><url><loc> </loc></url></urlset>')"
    bodies = _base(spark, d, f"SELECT site, {url('j')} AS url, CASE WHEN size(kids) > 0 THEN {nested} ELSE {plain} END AS body FROM (SELECT *, {KIDS_SPARK} AS kids FROM ({FILES}))", "pages")
    starts = bodies.select("site", F.lit(0).alias("ord"), F.concat(F.lit("https://s"), F.col("site").cast("string"), F.lit(".example/m?a=1&j=0")).alias("url")).distinct()
    asked, entries = boards.follow_sitemaps(spark, starts, bodies)
    said = entries.groupBy("site").agg(F.count("*").alias("urls"), F.max("lastmod").alias("last_content_at"))
    return asked.groupBy("site").agg(F.count("*").alias("asked")).join(said, "site", "left").select("site", "asked", F.coalesce("urls", F.lit(0)).alias("urls"), "last_content_at")
