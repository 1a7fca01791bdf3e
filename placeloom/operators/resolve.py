"""Web resolution: search plans, hit attribution, host classes, corroboration and shared doorways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeloom.functions import extract, text
from placeloom.operators.skew import two_way

# fixed values: hosts of directories, everywhere and by country, and of social networks
DIRECTORIES = (
    "yelp. tripadvisor. kompass.com europages. booking.com airbnb. indeed.com glassdoor. amazon. ebay. thefork. opentable. ubereats.com wolt.com "
    "deliveroo. just-eat. lieferando. foursquare.com trustpilot.com crunchbase.com bloomberg.com dnb.com opencorporates.com wikipedia.org wikidata.org"
).split()
NATIONAL_DIRECTORIES = {
    "fr": (
        "pagesjaunes.fr societe.com verif.com infogreffe.fr annuaire-entreprises.data.gouv.fr bodacc.fr manageo.fr petitfute.com justacote.com "
        "cylex-france.fr 118712.fr hoodspot.fr dirigeants.bfmtv.com pappers.fr score3.fr actulegales.fr data.inpi.fr rubypayeur.com societeinfo.com "
        "repreneurs.com infonet.fr datalegal.fr annuaire-inverse-france.com business-directory.fr compteo.fr petitesaffiches.fr maitredata.com "
        "droits-salaries.com afjv.com experts-comptables.org leboncoin.fr doctolib.fr mappy.com lafourchette. education.gouv.fr ville-data.com "
        "college-lycee.com adresses-ecoles.fr enseignement-prive.info restaurantguru.com restopolitan.com restaurants-de-france.fr uniiti.com "
        "kazfeed.com linternaute.com journaldunet.com figaro.fr"
    ).split(),
    "de": (
        "gelbeseiten.de dasoertliche.de 11880.com wlw.de firmenwissen.de northdata.de unternehmensregister.de meinestadt.de goyellow.de cylex.de "
        "werkenntdenbesten.de jameda.de kununu.com stepstone.de"
    ).split(),
    "es": "paginasamarillas.es einforma.com axesor.es empresite.eleconomista.es infoempresa.com cylex.es 11870.com infojobs.net".split(),
    "gb": "yell.com companycheck.co.uk endole.co.uk checkatrade.com thomsonlocal.com cylex-uk.co.uk 192.com reed.co.uk totaljobs.com".split(),
    "us": "yellowpages.com bbb.org manta.com bizapedia.com chamberofcommerce.com mapquest.com angi.com thumbtack.com zillow.com ziprecruiter.com".split(),
    "it": "paginegialle.it ufficiocamerale.it reportaziende.it misterimprese.it".split(),
    "nl": "telefoonboek.nl detelefoongids.nl bedrijvenpagina.nl".split(),
    "no": "gulesider.no proff.no 1881.no".split(),
    "fi": "fonecta.fi finder.fi".split(),
    "cz": "firmy.cz zivefirmy.cz".split(),
    "pl": "panoramafirm.pl aleo.com pkt.pl".split(),
}
SOCIAL = "facebook.com instagram.com linkedin.com twitter.com x.com youtube.com tiktok.com pinterest. wa.me".split()
# fixed values: search locale by country, and the words that head a legal notice
LOCALES = dict(
    fr="fr-FR", de="de-DE", at="de-AT", ch="de-CH", es="es-ES", it="it-IT", nl="nl-NL", be="nl-BE", pt="pt-PT", pl="pl-PL", cz="cs-CZ", no="nb-NO",
    fi="fi-FI", se="sv-SE", dk="da-DK", gb="en-GB", ie="en-IE", us="en-US",
)
NOTICE_TERMS = dict(
    de="Impressum", at="Impressum", ch="Impressum", es="aviso legal", fr="mentions légales", it="note legali", nl="colofon", pt="aviso legal",
    pl="polityka prywatności", gb="legal notice", ie="legal notice", us="legal notice",
)


def host_class(url: Column, country: str | None = None) -> Column:
    """own, directory or social by the host; what cannot be parsed counts as a directory."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    holds = lambda hosts: F.exists(F.array(*map(F.lit, hosts)), lambda h: F.contains(host, h))
    listed = DIRECTORIES + NATIONAL_DIRECTORIES.get((country or "").lower(), [])
    return F.when(host.isNull(), "directory").when(holds(SOCIAL), "social").when(holds(listed), "directory").otherwise("own")


def _by_country(table: dict[str, str], country: Column) -> Column:
    out = F.lit(None).cast("string")
    for cc, value in table.items():
        out = F.when(F.lower(country) == cc, value).otherwise(out)
    return out


def search_locale(country: Column, wanted: Column | None = None) -> Column:
    found = _by_country(LOCALES, country)
    return found if wanted is None else F.coalesce(wanted, found)


def search_queries(map_name: Column, trading: Column, legal_name: Column, town: Column, legal_id: Column, country: Column) -> Column:
    """Up to three distinct queries: each name with the town, the quoted legal id, else the name with the notice word."""
    bare = F.trim(F.regexp_replace(legal_name, r"\s*\([^)]*\)", ""))
    names = F.filter(F.array_distinct(F.array_compact(F.array(map_name, trading, bare))), lambda n: n != "")
    plain = F.transform(names, lambda n: F.when(F.coalesce(town, F.lit("")) != "", F.concat_ws(" ", n, town)).otherwise(n))
    by_id = F.when(legal_id.isNotNull(), F.concat(F.lit('"'), legal_id, F.lit('"')))
    notice = F.when(legal_id.isNull(), F.concat(F.get(names, F.lit(0)), F.lit(" "), _by_country(NOTICE_TERMS, country)))
    return F.slice(F.array_distinct(F.concat(plain, F.array_compact(F.array(by_id, notice)))), 1, 3)


def _grams(c: Column, width: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (width - 1)), lambda i: F.substr(c, i, F.lit(width))))


def words_inside(hosts: DataFrame, words: DataFrame, width: int = 4, block: int = 20_000) -> DataFrame:
    """``(host, word)`` of all distinct ``hosts(host)`` and ``words(word)``, each of ``width`` letters at least, whose word lies in the host.

    A word is keyed by that of its grams which the fewest hosts have, a host by each of its own, so a host of L letters has L - 3 rows
    whatever the words are, and meets only words that share their rarest piece with it. Words with a gram that no host has drop out at once."""
    h = hosts.where(F.length("host") >= width).select("host").distinct().select("host", F.explode(_grams(F.col("host"), width)).alias("gram"))
    w = words.where(F.length("word") >= width).select("word").distinct().select("word", F.explode(_grams(F.col("word"), width)).alias("gram"))
    seen = h.groupBy("gram").agg(F.count("*").alias("n"))
    keyed = w.join(seen, "gram", "left").groupBy("word").agg(F.min(F.struct("n", "gram")).alias("k"), F.count("*").alias("all"), F.count("n").alias("known"))
    keyed = keyed.where(F.col("all") == F.col("known")).select("word", F.col("k.gram").alias("gram"))
    return two_way(h, keyed, ["gram"], block).where(F.contains("host", F.col("word"))).select("host", "word")


def attribute_hits(hits: DataFrame, places: DataFrame, block: int = 20_000) -> DataFrame:
    """``hits(url, title, snippet, tag)`` to ``places(place_id, name)``: many to many.

    If any hit is tagged with a place, only tagged hits count. Otherwise a hit belongs to every place one of whose
    name words of four letters stands in its title or snippet, or lies in its host. Words of texts meet by equi-join, hosts as in
    ``words_inside``; a word that many places and many hits share is dealt out to many tasks.
    """
    tagged = hits.where("tag is not null").select(F.col("tag").alias("place_id"), "url")
    any_tag = hits.agg(F.coalesce(F.bool_or(F.col("tag").isNotNull()), F.lit(False))).scalar()
    words = lambda c: F.filter(F.split(text.normalize_name(c), " "), lambda t: F.length(t) >= 4)
    p = places.select("place_id", F.explode(F.array_distinct(words(F.col("name")))).alias("word"))
    loose = hits.where(~any_tag)
    said = loose.select("url", F.explode(F.array_distinct(words(F.concat_ws(" ", "title", "snippet")))).alias("word"))
    hosted = loose.select("url", F.regexp_replace(extract.domain_of(F.col("url")), "[^a-z0-9]", "").alias("host"))
    inside = hosted.join(words_inside(hosted, p, block=block), "host").select("url", "word")
    loose_hits = two_way(said.unionByName(inside).distinct(), p, ["word"], block).select("place_id", "url")
    return tagged.unionByName(loose_hits).distinct()


def doorway_key(number: Column, street: Column, postcode: Column) -> Column:
    """``number|FOLDED STREET|postcode``; empty unless street and postcode are known."""
    s = F.upper(text.fold(F.trim(street)))
    return F.when((F.coalesce(s, F.lit("")) != "") & (F.coalesce(postcode, F.lit("")) != ""), F.concat_ws("|", F.coalesce(number, F.lit("")), s, postcode)).otherwise("")


def shared_doorways(places: DataFrame, key: Column) -> DataFrame:
    """Keys that more than one of all places has."""
    return places.select(key.alias("doorway")).where("doorway <> ''").groupBy("doorway").agg(F.count("*").alias("n")).where("n > 1")


def corroboration(page: Column, names: Column, registration: Column, street: Column, postcode: Column, shared: Column) -> Column:
    """Array of the reasons a page is the place's own: its registration number, its address behind an unshared door, or
    all telling words of one of its names. One reason is enough."""
    low = text.fold(F.lower(page))
    digits = F.regexp_replace(registration, r"\D", "")
    number = (F.length(digits) >= 6) & F.contains(F.regexp_replace(page, r"\D", ""), digits)
    raw = (F.length(registration) >= 4) & F.contains(page, registration)
    street_words = F.filter(F.split(text.normalize_name(street), " "), lambda w: F.length(w) > 3)
    door = (F.size(street_words) > 0) & F.forall(street_words, lambda w: F.contains(low, w)) & F.contains(page, postcode) & ~shared
    telling = lambda n: F.filter(F.split(text.normalize_name(n), " "), lambda w: F.length(w) >= 4)
    named = F.filter(names, lambda n: (F.size(telling(n)) > 0) & F.forall(telling(n), lambda w: F.contains(low, w)))
    return F.array_compact(
        F.array(
            F.when(number | raw, "registration number on the page"),
            F.when(door, "address on the page"),
            F.when(F.size(named) > 0, F.concat(F.lit("name on the page: "), F.get(named, F.lit(0)))),
        )
    )


def candidate_urls(declared: DataFrame, hits: DataFrame, most: int = 3) -> DataFrame:
    """Declared URL first, then hits in order, distinct, the first three per place."""
    every = declared.where("url is not null").select("place_id", "url", F.lit(-1).cast("long").alias("ord")).unionByName(hits.select("place_id", "url", F.col("ord").cast("long")))
    one = every.groupBy("place_id", "url").agg(F.min("ord").alias("ord"))
    return one.withColumn("rank", F.row_number().over(W.partitionBy("place_id").orderBy("ord", "url"))).where(F.col("rank") <= most)


def settle(candidates: DataFrame) -> DataFrame:
    """``(place_id, rank, url, reasons)`` -> the first corroborated candidate, else the first, unverified."""
    good = F.size("reasons") > 0
    first = F.min_by(F.struct("url", good.alias("ok"), "reasons"), F.struct((~good).alias("bad"), "rank"))
    out = candidates.groupBy("place_id").agg(first.alias("c"))
    return out.select("place_id", "c.url", F.when(F.col("c.ok"), "corroborated").otherwise("unverified").alias("confidence"), F.col("c.reasons").alias("evidence"))


def needs_resolving(places: DataFrame) -> DataFrame:
    return places.where("site_url is null or site_confidence = 'declared'")


def enrichable(places: DataFrame, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    out = places.where("site_confidence = 'corroborated'")
    if only:
        out = out.where(F.col("place_id").isin(only))
    out = out.orderBy(F.coalesce("total", F.lit(0)).desc(), "place_id")
    return out if limit is None else out.limit(limit)


def best_by_role(links: DataFrame) -> DataFrame:
    """``links(place_id, ord, url, role)`` -> per place and role the URL with the shallowest path, the first on ties."""
    depth = F.size(F.filter(F.split(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "/"), lambda s: s != ""))
    return links.groupBy("place_id", "role").agg(F.min_by("url", F.struct(depth, "ord")).alias("url"))
