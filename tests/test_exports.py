"""Zip members as partitions, followed sitemaps, the row at a shared budget."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from placeloom.plans import sweep
from placeloom.sources import archives, boards


def zipped(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for k, (name, body) in enumerate(members.items()):
            z.writestr(f"{name}.csv", body, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        z.writestr("folder/", "")
        z.writestr("note.txt", "a,b\n9,9\n")


def test_members_are_partitions(spark, tmp_path):
    zipped(tmp_path / "1.zip", x='﻿ a ,b\n1," say ""hi"", \nthere "\n\n2\n', y="b,a,c\nB,3,more\n", empty="", header="a,b\n")
    zipped(tmp_path / "2.ZIP", z="a,b\n" + "".join(f"{i},v{i}\n" for i in range(10_000)))
    rows = archives.read_zip_csv(spark, str(tmp_path))
    assert rows.columns == ["a", "b"] and rows.rdd.getNumPartitions() == 5
    got = {r.a: r.b for r in rows.where("length(a) = 1 and b not like 'v%'").collect()}
    assert got == {"1": 'say "hi", \nthere', "2": "", "3": "B"}
    assert rows.count() == 3 + 10_000
    wide = archives.read_zip_csv(spark, f"file://{tmp_path}/1.zip", schema="c string, a string")
    assert {(r.a, r.c) for r in wide.collect()} == {("1", ""), ("2", ""), ("3", "more")}


def test_damaged_and_missing_archives_fail(spark, tmp_path):
    zipped(tmp_path / "bad.zip", x="a,b\n" + "1,2\n" * 50_000, y="a,b\n" + "1,2\n" * 50_000)
    whole = bytearray((tmp_path / "bad.zip").read_bytes())
    whole[1000] ^= 1  # inside the stored member: its checksum no longer holds
    (tmp_path / "bad.zip").write_bytes(whole)
    with pytest.raises(Exception, match="CRC"):
        archives.read_zip_csv(spark, str(tmp_path / "bad.zip")).collect()
    with pytest.raises(Exception, match="none.zip"):
        archives.read_zip_csv(spark, str(tmp_path / "none.zip"), schema="a string").collect()
    with pytest.raises(Exception, match="no member"):
        archives.read_zip_csv(spark, str(tmp_path / "bad.zip"), suffix=".tsv").collect()


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def pages(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc><lastmod>2024</lastmod></url>" for u in urls) + "</urlset>"


def test_sitemaps_are_followed_breadth_first(spark):
    bodies = {
        "s": index("a", "b", "a", "s"), "a": index("c", "s"), "b": pages("p1"), "c": pages("p2", "p3"),  # index to index, a cycle, a repeat
        "t": index("gone", "b"), "loop": index("loop"), "own": pages("p4") + "<sitemap><loc>b</loc></sitemap>", "odd": "no xml",
    }
    bodies = spark.createDataFrame(list(bodies.items()), "url string, body string")
    starts = spark.createDataFrame([(1, 0, "s"), (2, 0, "t"), (3, 0, "loop"), (4, 0, "own"), (5, 0, "odd"), (5, 1, "b"), (6, 0, None), (None, 0, "s"), (7, 3, "c"), (7, 2, "b")], "site long, ord int, url string")

    def run(most):
        asked, entries = boards.follow_sitemaps(spark, starts, bodies, most)
        said = {}
        for r in asked.orderBy("site", "rank").collect():
            said.setdefault(r.site, []).append(r.url)
        return said, {(r.site, r["loc"]) for r in entries.collect()}

    said, found = run(3)
    assert said == {1: ["s", "a", "b"], 2: ["t", "gone", "b"], 3: ["loop"], 4: ["own", "b"], 5: ["odd", "b"], 7: ["b", "c"]}
    assert found == {(1, "p1"), (2, "p1"), (4, "p4"), (4, "p1"), (5, "p1"), (7, "p1"), (7, "p2"), (7, "p3")}
    said, found = run(10)
    assert said[1] == ["s", "a", "b", "c"] and {(1, "p2"), (1, "p3")} <= found
    asked, entries = boards.follow_sitemaps(spark, starts.where("false"), bodies)
    assert asked.count() == 0 and entries.count() == 0


@pytest.mark.parametrize("budget", [0, 1, 250, 900])
@pytest.mark.parametrize("spread", [1, 1000])
def test_budget_is_exact_on_ties(spark, budget, spread):
    r = random.Random(budget * 31 + spread)
    rows = [(r.choice(["x", "y", None]), r.choice([None, r.randrange(spread)]), float(r.randrange(3))) for _ in range(500)]
    first = sorted(rows, key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[0] is not None, t[0] or ""))[:budget]
    d = spark.createDataFrame(rows, "lane string, a long, b double").repartition(4)
    got = sweep.budgeted(d, "lane", [F.col("a"), F.col("b")], budget, splitters=3, small=20)
    assert {x.lane: (x.requested, x.returned, x.truncated) for x in got.collect()} == {
        k: (n, m := sum(t[0] == k for t in first), m < n) for k in {t[0] for t in rows} for n in [sum(t[0] == k for t in rows)]
    }


def test_budget_sorts_nothing(spark):
    d = spark.range(200_000).select((F.col("id") % 7).alias("lane"), (F.col("id") * 7919 % 100_003).alias("a"))
    out = sweep.budgeted(d, "lane", [F.col("a")], 100_000, small=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "SinglePartition" not in plan and out.agg(F.sum("returned")).first()[0] == 100_000
