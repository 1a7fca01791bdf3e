"""Register confirmation: by legal identifier, by name and place, and the outcome account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeloom.functions import text
from placeloom.operators.cut import cut
from placeloom.operators.skew import two_way

ID_ROUTE_SCORE = 0.3
LOOKUP_SIMILARITY = 0.6


def needs_confirming(places: DataFrame) -> DataFrame:
    """Places without a record that have a name; those with pages first, else in order."""
    out = places.where("rec_key is null and trim(coalesce(name, '')) <> ''")
    return out.orderBy((F.coalesce("page_count", F.lit(0)) > 0).desc(), "ord")


def shares_token(a: Column, b: Column, least: int = 4) -> Column:
    words = lambda c: F.filter(F.split(text.normalize_name(c), " "), lambda t: F.length(t) >= least)
    return F.arrays_overlap(words(a), words(b))


def by_identifier(claims: DataFrame, registers: DataFrame) -> DataFrame:
    """``claims(place_id, name, page_ord, id_ord, kind, value)`` against ``registers(rec_key, reg_name, kind, value)``.

    Values are compared without separators. A claim is verified when the register has the number and the names
    agree (similarity >= 0.3 or a shared word of four letters); of a place's verified claims the first by page and
    position attaches. One row per place, kind and value with the strongest status.
    """
    c = claims.withColumn("id", text.id_form(F.col("value")))
    r = registers.select("rec_key", "reg_name", F.col("kind").alias("r_kind"), text.id_form(F.col("value")).alias("r_id"))
    j = c.join(r, (F.col("kind") == F.col("r_kind")) & (F.col("id") == F.col("r_id")), "left")
    agrees = (text.name_similarity(F.col("name"), F.col("reg_name")) >= ID_ROUTE_SCORE) | shares_token(F.col("name"), F.col("reg_name"))
    j = j.withColumn("verified", F.coalesce(F.col("rec_key").isNotNull() & agrees, F.lit(False)))
    one = j.groupBy("place_id", "kind", "id").agg(
        F.bool_or("verified").alias("verified"), F.min(F.struct("page_ord", "id_ord")).alias("at"), F.min(F.when(F.col("verified"), F.col("rec_key"))).alias("rec_key")
    )
    first = F.row_number().over(W.partitionBy("place_id").orderBy(F.col("verified").desc(), "at", "kind", "id"))
    return one.select(
        "place_id", "kind", F.col("id").alias("value"), F.when(F.col("verified"), "verified").otherwise("unverified").alias("status"), "rec_key", (F.col("verified") & (first == 1)).alias("attached")
    )


def lookup(places: DataFrame, snapshot: DataFrame, limit: int = 20) -> DataFrame:
    """Name lookup inside a locality: live records whose best name similarity is >= 0.6, or one of whose normalised names
    contains the place's or lies in it (three letters at least); up to ``limit`` per place, best first.

    ``places(place_id, name, locality)``, ``snapshot(rec_key, names, locality, status, postcode_r)``. A record may be listed under several
    localities, a row each; it is found in each of them, and once in one. Localities are compared by slug, and names meet through rare trigrams (``name_keys``), which every pair that can pass shares, so a town's places
    are not compared with all its records. Places and records that share a name and a town are compared once.
    """
    spark = places.sparkSession
    p = places.select("place_id", "name", text.slug(F.col("locality")).alias("loc")).where("loc <> '' and name is not null")
    s = snapshot.where("status <> 'ceased'").select("rec_key", text.slug(F.col("locality")).alias("loc"), "postcode_r", "names").where("loc <> '' and names is not null")
    s = cut(spark, s.dropDuplicates(["rec_key", "loc"]))  # read twice below; spellings of a town are one
    pt = _texts(spark, p, "name", "pt", text.name_forms(F.col("name")).alias("pf"), text.normalize_name(F.col("name")).alias("pn"))
    st = _texts(spark, s, "names", "st", F.transform("names", lambda n: text.name_forms(n)).alias("rf"), F.transform("names", lambda n: text.normalize_name(n)).alias("rn"))
    forms = lambda df, key, one, whole: df.select(F.col(key).alias("id"), "loc", F.explode(F.array_union(F.transform(one, lambda f: f["n"]), whole)).alias("n")).where("n <> ''")
    pk = name_keys(forms(pt, "pt", F.col("pf"), F.array("pn")))
    rk = name_keys(forms(st, "st", F.flatten("rf"), F.col("rn")))
    pairs = _sharing(cut(spark, pk), cut(spark, rk), "pt", "st")
    sim = F.coalesce(F.array_max(F.transform("rf", lambda f: text.forms_similarity(F.col("pf"), f))), F.lit(0.0))
    inside = F.exists("rn", lambda n: (F.length(n) >= 3) & (F.length(F.col("pn")) >= 3) & (F.contains(n, F.col("pn")) | F.contains(F.col("pn"), n)))
    alike = pairs.join(pt.drop("name").hint("merge"), ["pt", "loc"]).join(st.drop("names").hint("merge"), ["st", "loc"]).withColumn("similarity", sim)
    alike = alike.where((F.col("similarity") >= LOOKUP_SIMILARITY) | inside).select("pt", "st", "similarity")
    # of records with the same names in a town none but the first ``limit`` can be among a place's
    first = s.withColumn("n_", F.row_number().over(W.partitionBy("loc", "names").orderBy("rec_key"))).where(F.col("n_") <= limit)
    first = first.join(st.select("loc", "names", "st"), ["loc", "names"]).select("st", "rec_key", "postcode_r")
    best = lambda key: F.row_number().over(W.partitionBy(key).orderBy(F.col("similarity").desc(), "rec_key"))
    hit = alike.join(first, "st").withColumn("n_", best("pt")).where(F.col("n_") <= limit).join(pt.select("pt", "loc", "name"), "pt").select("loc", "name", "rec_key", "similarity", "postcode_r")
    hit = p.join(cut(spark, hit), ["loc", "name"]).select("place_id", "rec_key", "similarity", "postcode_r")
    return hit.withColumn("rank", best("place_id")).where(F.col("rank") <= limit).select("place_id", "rec_key", "similarity", "postcode_r", "rank")


def _texts(spark: SparkSession, rows: DataFrame, name: str, key: str, *built: Column) -> DataFrame:
    """The different names of every ``loc``, numbered by ``key``, with what is built from them; rows that share a name are compared once."""
    return cut(spark, rows.select("loc", name).distinct().select("loc", name, *built, F.monotonically_increasing_id().alias(key)))


def _sharing(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs of ids, with their locality, of keys that share a trigram that is rare for either side."""
    side = lambda k, c, name: k.select(F.col("id").alias(name), "loc", F.explode(c).alias("gram"))
    meet = lambda a, b: two_way(side(left, a, left_id), side(right, b, right_id), ["loc", "gram"]).select(left_id, right_id, "loc")
    return meet("rare", "every").unionByName(meet("every", "rare")).distinct()


def closest_names(spark: SparkSession, names: DataFrame, candidates: DataFrame, level: float = LOOKUP_SIMILARITY, few: int = 256) -> DataFrame:
    """``names(id, loc, name)`` against ``candidates(id, loc, name)`` of the same ``loc`` and another id -> ``(id, other, similarity)``: the most similar
    candidate, the smallest id on ties; names that nothing is like at all are left out.

    What is compared are the different names of a ``loc``, not their rows: a name stands for its two smallest ids, and of each name's partners as
    many are kept as make sure that one of them has another id. Where a ``loc`` has more than ``few`` different candidates, pairs that can reach ``level``
    are compared first (``name_keys``). What is found there is the best there is, since no pair at or above the level is lost. Names without
    such a find, and all in small ``loc``s, are compared with all of theirs."""
    whole = lambda df: df.select("id", "loc", "name").where("id is not null and loc is not null and name is not null")
    names, known = whole(names), cut(spark, whole(candidates).distinct())
    forms = text.name_forms(F.col("name"))
    mine = _texts(spark, names, "name", "a", forms.alias("fa"))
    two = known.withColumn("n_", F.row_number().over(W.partitionBy("loc", "name").orderBy("id"))).where("n_ <= 2")
    two = two.groupBy("loc", "name").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    theirs = _texts(spark, known, "name", "b", forms.alias("fb"))
    theirs = cut(spark, theirs.join(two.hint("merge"), ["loc", "name"]).drop("name"))
    deep = 1 + (known.groupBy("loc", "id").count().agg(F.max("count").alias("n")).first()["n"] or 0)  # an id may have several names
    crowded = theirs.groupBy("loc").count().where(F.col("count") > few).select("loc")

    def best(rows: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
        good = pairs.select("a", "ids", text.forms_similarity(F.col("fa"), F.col("fb")).alias("s")).where((F.col("s") >= least) & (F.col("s") > 0))
        rank = F.row_number().over(W.partitionBy("a").orderBy(F.col("s").desc(), F.col("ids")[0]))
        kept = good.withColumn("n_", rank).where(F.col("n_") <= deep).join(mine.select("a", "loc", "name"), "a").select("loc", "name", "s", "ids")
        other = F.when(F.col("ids")[0] != F.col("id"), F.col("ids")[0]).otherwise(F.get("ids", F.lit(1)))
        found = rows.join(cut(spark, kept).hint("merge"), ["loc", "name"]).select("id", "s", other.alias("other")).where("other is not null")
        found = found.groupBy("id").agg(F.max(F.struct("s", (-F.col("other")).alias("o"))).alias("x"))
        return found.select("id", (-F.col("x.o")).alias("other"), F.col("x.s").alias("similarity"))

    if crowded.isEmpty():
        return best(names, two_way(mine.drop("name"), theirs, ["loc"]), 0.0)
    keys = lambda df, key, f: cut(spark, name_keys(df.join(crowded, "loc", "left_semi").select(F.col(key).alias("id"), "loc", F.explode(F.transform(f, lambda x: x["n"])).alias("n")), level))
    pairs = _sharing(keys(mine, "a", "fa"), keys(theirs, "b", "fb"), "a", "b")
    found = cut(spark, best(names, pairs.join(mine.drop("name").hint("merge"), ["a", "loc"]).join(theirs.hint("merge"), ["b", "loc"]), level))
    rest = cut(spark, names.join(found.select("id"), "id", "left_anti"))
    left = mine.join(rest.select("loc", "name").distinct(), ["loc", "name"], "left_semi").drop("name")
    return found.unionByName(best(rest, two_way(left, theirs, ["loc"]), 0.0))


def name_keys(names: DataFrame, similarity: float = LOOKUP_SIMILARITY) -> DataFrame:
    """``names(id, loc, n)``, n normalised -> ``(id, loc, rare, every)``: all trigrams of a name, and the few of which a partner must
    have one among all of its own.

    Of names with trigram sets of Jaccard similarity s each has one of the other's first ``|x| - ceil(s |x|) + 1`` trigrams in any
    fixed order; token sets alike, a token standing for its first trigram; where one's tokens, or its letters, all lie in
    the other's, its very first does. The order is by rarity, taken from all names; normalised letters, digits and blanks make
    37^3 trigrams at most, so the table of counts has a proven bound and is broadcast."""
    g = names.select("id", "loc", "n").distinct().withColumn("every", text.trigrams(F.col("n")))
    counts = g.select(F.explode("every").alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))
    spread = g.select("id", "loc", "n", F.explode("every").alias("gram")).join(F.broadcast(counts), "gram")
    g = spread.groupBy("id", "loc", "n").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("o")).withColumn("every", F.col("o.gram"))
    share = lambda n: (n - F.ceil(F.lit(similarity) * n - 1e-9) + 1).cast("int")
    first = lambda part: F.get(F.filter("every", lambda x: F.contains(part, x)), F.lit(0))
    tokens = F.filter(F.split("n", " "), lambda t: F.length(t) > 1)
    marked = F.transform(F.array_distinct(tokens), lambda t: F.struct(F.array_position("every", first(F.concat(F.lit(" "), t))).alias("at"), t.alias("t"), first(F.concat(F.lit(" "), t)).alias("gram")))
    rarest = F.array_sort(marked)
    rare = F.concat(
        F.slice("every", 1, share(F.size("every"))),
        F.when(F.size(rarest) > 0, F.slice(F.transform(rarest, lambda x: x["gram"]), 1, F.greatest(F.lit(1), share(F.size(rarest))))).otherwise(F.array().cast("array<string>")),
        F.array(first(F.col("n"))),
    )
    return g.select("id", "loc", F.array_compact(F.array_distinct(rare)).alias("rare"), "every")


def by_name(hits: DataFrame, places: DataFrame, high: float = 0.72, low: float = 0.40) -> DataFrame:
    """Best hit per place, +0.1 (to 1 at most) on an equal postcode, in the usual bands. Hits may have a ``connector_ord``: of
    each connector the best hit counts, the first connector that merges wins, else the best of all that are undecided.

    Without coordinates the distance is unknown and null."""
    if "connector_ord" not in hits.columns:
        hits = hits.withColumn("connector_ord", F.lit(0))
    j = hits.join(places.select("place_id", "postcode"), "place_id")
    same = F.coalesce(F.col("postcode") == F.col("postcode_r"), F.lit(False))
    scored = j.withColumn("score", F.when(same, F.least(F.lit(1.0), F.col("similarity") + 0.1)).otherwise(F.col("similarity")))
    own = F.min_by(F.struct("score", "rec_key"), F.struct((-F.col("score")).alias("s"), "rec_key"))
    each = scored.groupBy("place_id", "connector_ord").agg(own.alias("h")).select("place_id", "connector_ord", "h.*")
    merges = F.col("score") >= high
    rule = F.struct((~merges).alias("m"), F.when(merges, F.col("connector_ord")).alias("c"), (-F.col("score")).alias("s"), "connector_ord", "rec_key")
    best = each.groupBy("place_id").agg(F.min_by(F.struct("score", "rec_key"), rule).alias("h")).select("place_id", "h.*")
    band = F.when(F.col("score") >= high, "merge").when(F.col("score") >= low, "undecided").otherwise("distinct")
    return best.select("place_id", "rec_key", "score", F.lit(None).cast("double").alias("distance_m"), band.alias("band"))


def outcomes(todo: DataFrame, by_id: DataFrame, by_nm: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: verified by number, matched by name, undecided, not found (someone answered) and not asked."""
    ids = by_id.where("attached").select("place_id").distinct().withColumn("v", F.lit(True))
    out = (
        todo.select("place_id")
        .join(ids, "place_id", "left")
        .join(by_nm.select("place_id", "band"), "place_id", "left")
        .join(asked.select("place_id").distinct().withColumn("answered", F.lit(True)), "place_id", "left")
    )
    v, rest = F.col("v").isNotNull(), F.col("v").isNull()
    merge, maybe = F.col("band").eqNullSafe("merge"), F.col("band").eqNullSafe("undecided")
    return out.agg(
        F.count_if(v).alias("verified"), F.count_if(rest & merge).alias("matched"), F.count_if(rest & maybe).alias("undecided"),
        F.count_if(rest & ~merge & ~maybe & F.col("answered").isNotNull()).alias("not_found"), F.count_if(rest & ~merge & ~maybe & F.col("answered").isNull()).alias("not_asked"),
    )


def unique_identifier(ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(query, id)`` that exactly one record of ``ids(rec_key, id)`` carries, separators aside."""
    r = ids.select("rec_key", text.id_form(F.col("id")).alias("k")).distinct()
    unique = r.groupBy("k").agg(F.min("rec_key").alias("rec_key"), F.count("*").alias("n")).where("n = 1").drop("n")
    return wanted.select("query", text.id_form(F.col("id")).alias("k")).join(unique, "k").select("query", "rec_key")


def court_match(claimed: Column, held: Column) -> Column:
    """German courts agree when equal or one contained in the other, folded."""
    a, b = text.slug(claimed), text.slug(held)
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a))
