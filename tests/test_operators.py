import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placeloom import catalogue
from placeloom.operators import confirm, diff, gate, match, resolve, score, summary
from placeloom.plans import render, sweep

L = F.lit


def test_verdict_fold(spark):
    places = spark.createDataFrame(
        [("osm:1", ["osm"], None, None, None), ("osm:2", ["osm"], None, None, None), ("fr:9", ["registry"], "fr:9", None, None), ("de:7", ["registry"], "de:7", None, None)],
        "place_id string, sources array<string>, rec_key string, match_confidence double, matched_by string",
    )
    verdicts = spark.createDataFrame([("osm:1", "9", True, ""), ("osm:2", "fr:9", True, ""), ("osm:2", "de:7", False, ""), ("osm:x", "9", True, "")], "place_id string, rec_key string, merge boolean, why string")
    out, outcome = match.fold_verdicts(places, verdicts)
    assert {(r.place_id, r.rec_key): r.outcome for r in outcome.collect()} == {("osm:1", "9"): "merged", ("osm:2", "fr:9"): "rejected", ("osm:2", "de:7"): "kept apart", ("osm:x", "9"): "unknown"}
    got = {r.place_id: (r.rec_key, r.match_confidence) for r in out.collect()}
    assert got == {"osm:1": ("fr:9", 1.0), "osm:2": (None, None), "de:7": ("de:7", None)}


def test_assignment_equals_greedy(spark):
    import random

    g = random.Random(4)
    pairs = [(f"p{p}", f"r{r}", g.choice([0.8, 0.9]), p, 0, 0, r) for p in range(25) for r in range(25) if g.random() < 0.2]
    df = spark.createDataFrame(pairs, "poi_id string, rec_key string, score double, poi_ord int, dy int, dx int, rec_ord int")
    used, want = set(), set()
    for p in sorted(pairs, key=lambda x: (-x[2], *x[3:])):
        if p[0] not in used and p[1] not in used:
            used |= {p[0], p[1]}
            want.add(p[:2])
    assert {(r.poi_id, r.rec_key) for r in match.assign_one_to_one(spark, df, match.pair_order()).collect()} == want


def test_role_age_counts_fractions_of_seconds(value):
    as_of = L("2024-06-01").cast("timestamp")
    assert value(score.oldest_role_days(F.array(L("2024-05-01T00:00:00.400000"), L("2024-05-02")), as_of)) == 30
    assert value(score.oldest_role_days(F.array(L("2024-05-01T00:00:00")), as_of)) == 31
    assert 30 < value(score.days_since(L("2024-05-01T00:00:00.4"), as_of)) < 31


def test_open_role_age_at_midnight(spark, tmp_path):
    ts = pd.to_datetime(["2024-05-01 00:00:00.4", "2024-05-01 00:00:00.0"]).astype("datetime64[us]")
    pd.DataFrame({"user_id": [1, 2], "ts": ts, "event_type": "purchase", "value": 1.0}).to_parquet(f"{tmp_path}/events.parquet")
    oracle.same(catalogue.queries()["open_role_age"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), catalogue.oracle_sql()["open_role_age"])


def test_three_valued_hiring(value):
    yes = lambda b, c, n: value(score.is_hiring(L(b), L(c), L(n)))
    assert (yes(0, False, 3), yes(1, False, 3), yes(0, True, 0)) == (False, True, None)
    assert value(score.oldest_role_days(F.array(L("2024-01-01"), L("bad")), L("2024-01-31").cast("timestamp"))) == 30
    assert value(score.oldest_role_days(F.array(L("bad")), L("2024-01-31").cast("timestamp"))) is None


def test_score_parts(spark):
    row = dict(site_confidence="corroborated", site_reachable=True, last_content_at="2024-09-11", page_count=9, is_hiring=True, open_roles=7, employee_floor=0, revenue=1e8, registered=True,
               contactable=True, has_ecommerce=False, has_pricing=None, matched_roles=1, term_matches=2, oldest_role_days=90)
    schema = "site_confidence string, site_reachable boolean, last_content_at string, page_count int, is_hiring boolean, open_roles int, employee_floor long, revenue double, registered boolean, contactable boolean, has_ecommerce boolean, has_pricing boolean, matched_roles int, term_matches int, oldest_role_days int"
    p = score.score_places(spark.createDataFrame([tuple(row.values())], schema), L("2024-09-01").cast("timestamp")).first()
    # a future date gives more than the weight, no employees still one point
    assert p.parts == dict(hasSite=10, siteWorks=5, fresh=16, depth=5, hiring=15, openRoles=10, size=1, revenue=8, registered=8, contactable=10, matchedRoles=4, termMatches=12, staleRole=8)
    assert p.total == sum(p.parts.values())


def test_ranking_order(spark):
    d = spark.createDataFrame([("a", "no", 90), ("b", None, 10), ("c", "weak", 5), ("d", "strong", 1), ("e", None, 20)], "place_id string, fit string, total long")
    assert [r.place_id for r in score.ranked(d).collect()] == ["d", "c", "e", "b", "a"]
    assert [r.place_id for r in score.keep_rows(d, 5, "weak").collect()] == ["c"]


def test_corroboration(value):
    c = lambda page, shared=False: value(
        resolve.corroboration(L(page), F.array(L("SARL Étoile Dorée")), L("302474648"), L("rue Montorgueil"), L("75002"), L(shared))
    )
    assert c("SIREN 302 474 648") == ["registration number on the page"]
    assert c("12 rue Montorgueil 75002") == ["address on the page"] and c("12 rue Montorgueil 75002", True) == []
    assert c("L'étoile dorée") == ["name on the page: SARL Étoile Dorée"]


def test_tagged_hits_silence_the_rest(spark):
    hits = spark.createDataFrame([("https://a.fr", "Acme works", "", None), ("https://b.fr", "x", "", 2)], "url string, title string, snippet string, tag long")
    places = spark.createDataFrame([(1, "Acme Works"), (2, "Other")], "place_id long, name string")
    assert [tuple(r) for r in resolve.attribute_hits(hits, places).collect()] == [(2, "https://b.fr")]
    assert {tuple(r) for r in resolve.attribute_hits(hits.where("tag is null"), places).collect()} == {(1, "https://a.fr")}


def test_confirmation_outcomes(spark):
    todo = spark.createDataFrame([(i,) for i in range(5)], "place_id long")
    by_id = spark.createDataFrame([(0, True)], "place_id long, attached boolean")
    names = spark.createDataFrame([(1, "merge"), (2, "undecided")], "place_id long, band string")
    asked = spark.createDataFrame([(3,)], "place_id long")
    assert confirm.outcomes(todo, by_id, names, asked).first().asDict() == dict(verified=1, matched=1, undecided=1, not_found=1, not_asked=1)


def test_gate(spark):
    pages = spark.createDataFrame([("a", "P1", "call +33 1 43 28 00 00"), ("b", "P2", "x")], "place_id string, page_id string, text string")
    claims = spark.createDataFrame([("a", "+33143280000", "web", "P1"), ("a", "z@x.fr", "web", "P1"), ("a", "y", "web", "P9"), ("a", "q", "osm", None)], "place_id string, value string, lane string, `from` string")
    assert sorted(r.rule for r in gate.contacts(claims, pages).collect()) == ["contact-not-on-page", "contact-unsourced"]
    d = spark.createDataFrame([("a", "see [P1] [P2] [P7]")], "place_id string, body string")
    assert {(r.rule, r.subject) for r in gate.citations(d, pages).collect()} == {("citation-foreign", "P2"), ("citation-unresolved", "P7")}
    q = gate.quotes(spark.createDataFrame([("a", 1, "0143280000", "P1"), ("a", 2, "none", "P1")], "place_id string, ord int, value string, `from` string"), pages)
    assert {r.value: r.found for r in q.collect()} == {"0143280000": True, "none": False}


def test_summary_tables(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, ""), (5, None), (6, "b")], "ord long, k string")
    assert [(r.key, r.n) for r in summary.tally(d, F.col("k"), F.col("ord")).collect()] == [("a", 2), ("b", 2)]
    assert [r.n for r in summary.score_histogram(spark, spark.createDataFrame([(75,), (0,)], "total long")).collect()] == [1, 0, 0, 0, 1]


def test_rrf_and_dedupe(spark):
    d = spark.createDataFrame([("u", "x", 1), ("u", "y", 2), ("v", "x", 2)], "url string, l string, r int")
    got = {r.url: r.score for r in diff.reciprocal_rank_fusion(d, "url", "l", "r").collect()}
    assert abs(got["u"] - (1 / 61 + 1 / 62)) < 1e-12 and abs(got["v"] - 1 / 62) < 1e-12


def test_render(spark, tmp_path):
    p = spark.createDataFrame([("1", 'A "x"', 5, ["osm"], None, 48.8, 2.4, "strong", True, ["a@x.fr"], [])], "place_id string, name string, total long, sources array<string>, site_confidence string, lat double, lon double, fit string, is_hiring boolean, emails array<string>, phones array<string>")
    p = p.selectExpr("*", "1 as open_roles", "0 as matched_roles", "0 as term_matches", "cast(null as string) as connector", "cast(null as string) as as_of", "0 as n_officers", "0 as n_people")
    lanes = spark.createDataFrame([("osm", "map", 3, 2, True)], "lane string, mode string, requested long, returned long, truncated boolean")
    notes = spark.createDataFrame([(1, "scan: ok")], "ord long, text string")
    md = render.report(p, lanes, notes, "Town")
    assert "Truncated" in md and "map places only" in md
    page = render.html_page(p, "Town <1>")
    assert "&quot;x&quot;" in page and "Town &lt;1&gt;" in page and "Town <1>" not in page and "blank(x)" in page
    more = p.selectExpr("*", "cast(null AS string) AS cms", "true AS has_pricing", "false AS has_ecommerce", "2 AS page_count", "'because' AS why", "'call' AS angle")
    more = more.unionByName(more.withColumn("place_id", F.lit("2")).withColumn("fit", F.lit(None).cast("string")))
    md = render.report(more, lanes.withColumn("connector", F.lit("no-brreg")), notes, "Town")
    assert "2 pages read" not in md and "4 pages read" in md and "## Judged (1 of 2)" in md and "**Why.** because" in md and "1 companies have" in md and "## Sources" in md and "NLOD" in md
    assert render.privacy_note(p) is None
    run = render.Run(spark, str(tmp_path), "r1")
    run.write("places", p)
    assert run.manifest(a=1) == {"a": 1} and run.manifest(b=2) == {"a": 1, "b": 2}
    assert render.Run.newest(spark, str(tmp_path)).endswith("/r1") and run.manifest() == {"a": 1, "b": 2}
    assert len(render.CSV_HEADER) == 51 and render.csv_frame(p.drop("term_matches").withColumnRenamed("place_id", "id")).columns == render.CSV_HEADER


def test_rivals(spark):
    c = spark.createDataFrame([("q", 1, 0.5, 48.8, 2.4), ("q", 2, 0.45, 43.3, 5.4), ("q", 3, 0.1, 43.3, 5.4), ("q", 4, 0.5, 48.81, 2.4)], "query string, ord int, importance double, lat double, lon double")
    assert [r.ord for r in sweep.rivals(c).collect()] == [2]


def test_stream_deltas(spark, tmp_path):
    from placeloom.streaming.deltas import DeltaFeed, windowed_tally

    schema = "key string, ord int, status string, is_hiring boolean, titles array<string>, site_url string, site_confidence string, reachable boolean"
    row = lambda key, hiring: (key, 1, "active", hiring, ["a"], None, None, True)
    feed = DeltaFeed(str(tmp_path))
    feed(spark.createDataFrame([row("x", None)], schema), 0)
    feed(spark.createDataFrame([row("x", True), row("y", None)], schema), 1)
    got = {(r.delta_kind, r.key) for r in spark.read.parquet(f"{tmp_path}/delta-1").collect()}
    assert {("startedHiring", "x"), ("appeared", "y")} <= got
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_tally(events, "ts", "event_type").agg(F.sum("n")).first()[0] == events.count()


def test_names_meet_through_rare_trigrams(spark):
    """No pair that passes is lost by blocking."""
    import random

    from placeloom.functions import text
    from placeloom.operators import confirm

    g = random.Random(4)
    words = ["boulangerie", "martin", "du", "reve", "ab", "cd", "la", "garage", "x", "soleil", "sol", "rest", "restaurant", "etoile", "dor", "7", "abc"]
    name = lambda: " ".join(g.choice(words) for _ in range(g.randint(1, 4)))
    places = spark.createDataFrame([(i, name(), "Lyon") for i in range(120)] + [(900, "martin", ""), (901, None, "Lyon")], "place_id long, name string, locality string")
    records = spark.createDataFrame([(f"r{i}", [name() for _ in range(g.randint(1, 2))], "LYON", "active", None) for i in range(120)], "rec_key string, names array<string>, locality string, status string, postcode_r string")
    got = {(r.place_id, r.rec_key): round(r.similarity, 9) for r in confirm.lookup(places, records, limit=1000).collect()}
    n, m = text.normalize_name, F.col("name")
    every = places.where("locality = 'Lyon' and name is not null").crossJoin(records.select("rec_key", F.explode("names").alias("r")))
    inside = (F.length(n(m)) >= 3) & (F.length(n(F.col("r"))) >= 3) & (F.contains(n(m), n(F.col("r"))) | F.contains(n(F.col("r")), n(m)))
    judged = every.select("place_id", "rec_key", text.name_similarity(m, F.col("r")).alias("s"), inside.alias("inside")).groupBy("place_id", "rec_key").agg(F.max("s").alias("s"), F.bool_or("inside").alias("inside"))
    want = {(r.place_id, r.rec_key): round(r.s, 9) for r in judged.where("s >= 0.6 or inside").collect()}
    assert got == want and len(want) > 500


def test_closest_names(spark):
    """Both ways give the most similar candidate of all."""
    import random

    from placeloom.functions import text

    g = random.Random(8)
    words = ["boulangerie", "martin", "reve", "ab", "garage", "soleil", "restaurant", "etoile", "dor", "7", "xyz"]
    rows = [(i, f"l{i % 3}", " ".join(g.choice(words) for _ in range(g.randint(0, 3)))) for i in range(150)]
    names = spark.createDataFrame(rows, "id long, loc string, name string")
    pairs = names.select(F.col("id").alias("a"), "loc", F.col("name").alias("x")).join(names.select(F.col("id").alias("b"), "loc", F.col("name").alias("y")), "loc").where("a <> b")
    scored = pairs.select("a", "b", text.name_similarity(F.col("x"), F.col("y")).alias("s")).where("s > 0").collect()
    want = {}
    for r in scored:
        want[r.a] = max(want.get(r.a, (0, 0)), (r.s, -r.b))
    for few in (10, 1000):
        got = {r.id: (r.similarity, -r.other) for r in confirm.closest_names(spark, names, names, few=few).collect()}
        assert got == want


def _pairs_seen(monkeypatch, step):
    """Counts of the pairs that a step of the name comparison gives."""
    seen, own = [], getattr(confirm, step)
    monkeypatch.setattr(confirm, step, lambda *a, **k: (lambda out: (seen.append(out.count()), out)[1])(own(*a, **k)))
    return seen


def test_copies_of_a_name_are_compared_once(spark, monkeypatch):
    """Closest names: of copies the smallest other id, whether a town is crowded or not, and as few comparisons as there are different names."""
    rows = [(i, "t", ["garage martin", "garage", "pharmacie soleil"][i % 3]) for i in range(300)] + [(7, "t", "garage martin"), (1000, "t", "zzz"), (1001, None, "garage"), (1002, "t", None)]
    names = spark.createDataFrame(rows, "id long, loc string, name string")
    want = {i: (1 if i % 3 == 1 else 0 if i % 3 == 0 else 2) for i in range(300)} | {0: 3, 1: 4, 2: 5, 7: 0}
    for few in (2, 1000):
        seen = _pairs_seen(monkeypatch, "two_way")
        got = {r.id: (r.other, r.similarity) for r in confirm.closest_names(spark, names, names, few=few).collect()}
        monkeypatch.undo()
        assert got == {i: (o, 1.0) for i, o in want.items()}
        assert max(seen) < 300  # 90,000 pairs of rows


def test_lookup_compares_copies_of_a_name_once(spark, monkeypatch):
    places = spark.createDataFrame([(i, ["Garage Martin", "Martin"][i % 2], "Lyon") for i in range(200)], "place_id long, name string, locality string")
    records = spark.createDataFrame([(f"r{i:03}", ["SARL Garage Martin"], "Lyon", "active", f"{i % 9}") for i in range(200)], "rec_key string, names array<string>, locality string, status string, postcode_r string")
    seen = _pairs_seen(monkeypatch, "_sharing")
    got = confirm.lookup(places, records, limit=5).collect()
    assert len(got) == 1000 and {(r["rank"], r.rec_key, r.postcode_r) for r in got} == {(i + 1, f"r{i:03}", f"{i % 9}") for i in range(5)}
    assert seen == [2]  # 40,000 pairs of rows


def test_record_in_several_towns_is_found_once_in_each(spark):
    places = spark.createDataFrame([(1, "Garage Martin", "Lyon"), (2, "Garage Martin", "PARIS"), (3, "Garage Martin", "Nice")], "place_id long, name string, locality string")
    records = spark.createDataFrame([("r1", ["Garage Martin"], t, "active", None) for t in ("Lyon", "Paris", "LYON")] + [("r2", ["Garage Martin"], "Lyon", "active", None)], "rec_key string, names array<string>, locality string, status string, postcode_r string")
    got = sorted((r.place_id, r["rank"], r.rec_key) for r in confirm.lookup(places, records).collect())
    assert got == [(1, 1, "r1"), (1, 2, "r2"), (2, 1, "r1")]


def test_second_verdict_takes_a_free_record(spark):
    places = spark.createDataFrame(
        [(f"osm:{c}", ["osm"], None, None, None) for c in "ABC"] + [(f"reg:{n}", ["registry"], f"reg:{n}", None, None) for n in (1, 2, 3)],
        "place_id string, sources array<string>, rec_key string, match_confidence double, matched_by string",
    )
    rows = [("osm:A", "reg:1", 2), ("osm:A", "2", 3), ("osm:B", "reg:1", 1), ("osm:C", "2", 4), ("osm:C", "reg:2", 5), ("osm:C", "3", 6)]
    verdicts = spark.createDataFrame([(p, k, True, "", o) for p, k, o in rows], "place_id string, rec_key string, merge boolean, why string, ord int")
    out, outcome = match.fold_verdicts(places, verdicts)
    assert {(r.place_id, r.rec_key) for r in outcome.where("outcome = 'merged'").collect()} == {("osm:B", "reg:1"), ("osm:A", "2"), ("osm:C", "3")}
    assert {r.place_id: r.rec_key for r in out.collect()} == {"osm:A": "reg:2", "osm:B": "reg:1", "osm:C": "reg:3"}
    _, by_key = match.fold_verdicts(places, verdicts.drop("ord"))
    assert {(r.place_id, r.rec_key) for r in by_key.where("outcome = 'merged'").collect()} == {("osm:A", "2"), ("osm:B", "reg:1"), ("osm:C", "3")}


def test_words_inside_hosts(spark):
    """Equal to brute force; a word that many hosts and many places share is dealt out."""
    import random

    g = random.Random(5)
    hosts = ["".join(g.choice("abc") for _ in range(g.randint(1, 14))) for _ in range(300)] + [f"garage{i}" for i in range(80)]
    words = ["".join(g.choice("abc") for _ in range(g.randint(1, 7))) for _ in range(200)] + ["garage", "gara", "rage", "zzzz"]
    h, w = spark.createDataFrame([(x,) for x in hosts], "host string"), spark.createDataFrame([(x,) for x in words], "word string")
    want = {(a, b) for a in hosts for b in words if len(a) >= 4 and len(b) >= 4 and b in a}
    for block in (10, 20_000):
        got = [tuple(r) for r in resolve.words_inside(h, w, block=block).select("host", "word").collect()]
        assert set(got) == want and len(got) == len(want)


def test_hot_words_do_not_make_one_task(spark):
    hits = spark.range(2000).select(F.concat(F.lit("https://x"), "id", F.lit(".fr")).alias("url"), F.lit("garage central").alias("title"), F.lit("").alias("snippet"), F.lit(None).cast("long").alias("tag"))
    places = spark.range(300).select(F.col("id").alias("place_id"), F.lit("Garage Dupont").alias("name"))
    j = resolve.attribute_hits(hits, places, block=50)
    assert j.count() == 600_000
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    tagged = hits.limit(3).unionByName(hits.limit(1).withColumn("tag", F.lit(7).cast("long")))
    assert [tuple(r) for r in resolve.attribute_hits(tagged, places).select("place_id").collect()] == [(7,)]


def test_two_way_join_splits_hot_keys(spark):
    from placeloom.operators.skew import two_way

    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("a", 1), (None, 2), ("l", 3)], "k string, x int")
    right = spark.createDataFrame([("hot", i) for i in range(300)] + [("a", 1), ("a", 2), (None, 2), ("r", 3)], "k string, y int")
    got = two_way(left, right, ["k"], block=40)
    assert got.columns == ["k", "x", "y"] and got.count() == 150_002 and got.distinct().count() == 150_002


@pytest.mark.parametrize("depth, cap, stride", [(20, 3, 4), (20, 1, 7), (3, 40, 4), (0, 5, 4), (5, 10_000, 4)])
def test_quad_tiles_equal_recursion(spark, depth, cap, stride):
    """Skewed points: two dense knots, repeats that no depth can part, and points on tile borders."""
    import random

    g = random.Random(2)
    box = (48.8, 48.9, 2.4, 2.47)
    pts = [(g.uniform(48.8, 48.9), g.uniform(2.4, 2.47)) for _ in range(150)] + [(48.81 + g.gauss(0, 1e-5), 2.41 + g.gauss(0, 1e-5)) for _ in range(150)]
    pts += [(48.85, 2.435)] * 9 + [(48.8, 2.4), (48.9, 2.4), (48.85, 2.47), (None, 2.41), (50.0, 2.41)]

    def tiles(path, s, n, w, e, inside):
        inside = [(y, x) for y, x in inside if y is not None and s <= y < n and w <= x < e]
        if len(inside) <= cap or len(path) == depth:
            return [(len(path), path, len(inside), len(inside) > cap, s, n, w, e)]
        y, x = (s + n) / 2, (w + e) / 2
        parts = [(s, y, w, x), (s, y, x, e), (y, n, w, x), (y, n, x, e)]
        return [t for q, b in enumerate(parts) for t in tiles(f"{path}{q}", *b, inside)]

    df = spark.createDataFrame(pts, "lat double, lon double")
    got = sorted((r.level, r.path, r.n, r.incomplete, r.south, r.north, r.west, r.east) for r in sweep.quad_tiles(spark, box, df, cap, depth, stride).collect())
    assert got == sorted(tiles("", *box, pts))
    assert [r.n for r in sweep.quad_tiles(spark, box, df.limit(0), cap, depth).collect()] == [0]


def test_robots_of_many_rules(spark):
    """Equal to testing every rule; a hundred thousand rules on one site make no pairs of rules and urls."""
    import random
    import re

    from placeloom.sources import pages

    g = random.Random(3)
    alphabet = ["/", "a", "b", "*", "$", ".", "?", "+"]
    rules = [("s", "*", g.random() < 0.5, "/" + "".join(g.choice(alphabet) for _ in range(g.randint(0, 5)))) for _ in range(150)]
    paths = ["/" + "".join(g.choice("/ab.?+$") for _ in range(g.randint(0, 7))) for _ in range(200)]

    def says(path):
        best = (0, True)
        for _, _, allow, rule in rules:
            pattern = "".join(".*" if c == "*" else "$" if c == "$" and i == len(rule) - 1 else re.escape(c) for i, c in enumerate(rule))
            if re.match(pattern, path, re.S):
                best = max(best, (len(rule), allow))
        return best[1]

    schema = "site string, agent string, allow boolean, path string"
    urls = spark.createDataFrame([("s", p) for p in paths] + [("other", "/a")], "site string, path string")
    for block in (5, 20_000):
        got = {(r.site, r.path): r.allowed for r in pages.allowed(urls, spark.createDataFrame(rules, schema), "Bot/1", block).collect()}
        assert got == {("s", p): says(p) for p in paths} | {("other", "/a"): True}
    many = spark.range(100_000).selectExpr("concat('s', id % 1) AS site", "'*' AS agent", "id % 2 = 0 AS allow", "concat('/p/', id, CASE WHEN id % 3 = 0 THEN '/*.pdf$' ELSE '/' END) AS path")
    asked = spark.range(20_000).selectExpr("concat('s', id % 1) AS site", "concat('/p/', id * 5, '/x.pdf') AS path")
    out = pages.allowed(asked, many, "bot")
    assert out.where("allowed").count() == 10_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_task_holds_a_whole_component(spark, monkeypatch):
    """Pairs of one large component are not dealt by it."""
    pairs = spark.createDataFrame([(f"p{i:03}", f"r{(i + j) % 7}", i * 3 + j) for i in range(90) for j in range(2)], "poi_id string, rec_key string, ord int")
    most, cut = [], match._cut

    def watched(session, df):
        out = cut(session, df)
        if {"component", "__o"} <= set(out.columns):
            most.append(out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(match, "_cut", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = match.assign_one_to_one(spark, pairs, [F.col("ord")], large=10).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r.poi_id, r.rec_key) for r in got) == [(f"p{i:03}", f"r{i}") for i in range(7)]
    assert most and max(most) < 120  # of 180 rows
