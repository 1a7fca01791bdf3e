"""Register mappers: JSON payload columns and bulk rows to one record shape.

Every mapper takes a DataFrame with a string column ``payload`` and returns records of one schema; payloads that are
no JSON or lack an identifier give no row. JSON is parsed once into a variant and read by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeloom.functions import text
from placeloom.operators import diff, score

COLUMNS = (
    "connector id establishment_id names legal_name trading_names activity_code section activity_scheme size_band employees parent_band officers number kind "
    "street postcode city municipality country_name address_raw country lat lon status legal_form date_created date_closed is_head_office source_url as_of national"
).split()
ARRAYS = {"names", "trading_names", "officers"}


def _record(df: DataFrame, where: Column, **cols: Column) -> DataFrame:
    out = []
    for c in COLUMNS:
        v = cols.get(c)
        if v is None:
            kind = "array<string>" if c in ARRAYS else "map<string,string>" if c == "national" else "double" if c in ("lat", "lon") else "long" if c == "employees" else "boolean" if c == "is_head_office" else "string"
            v = F.array().cast(kind) if c in ARRAYS else F.lit(None).cast(kind)
        elif c in ARRAYS:
            v = F.filter(v, lambda x: x.isNotNull() & (F.trim(x) != ""))
        out.append(v.alias(c))
    return df.where(where).select(*out)


def _j(df: DataFrame) -> DataFrame:
    return df.withColumn("j", F.try_parse_json("payload")).where("j is not null")


def _s(path: str, v: Column | str = "j") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, "string")


def _b(path: str) -> Column:
    return F.try_variant_get("j", path, "boolean")


def _arr(path: str, v: Column | str = "j") -> Column:
    return F.coalesce(F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, "array<variant>"), F.array().cast("array<variant>"))


def _each(items: Column, path: str) -> Column:
    return F.transform(items, lambda x: F.try_variant_get(x, path, "string"))


def _national(**cols: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in cols.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def _joined(sep: str, *cols: Column) -> Column:
    return F.nullif(F.concat_ws(sep, *[F.nullif(F.trim(c), F.lit("")) for c in cols]), F.lit(""))


def _nace(code: Column) -> dict[str, Column]:
    return {"activity_code": code, "section": score.nace_section(code), "activity_scheme": F.lit("nace")}


def norway(df: DataFrame) -> DataFrame:
    """Historic names follow the current one; headcount only where the register says it has one; struck off or bankrupt is ceased."""
    d = _j(df)
    a = lambda k: F.coalesce(_s(f"$.beliggenhetsadresse.{k}"), _s(f"$.postadresse.{k}"))
    gone = _s("$.slettedato").isNotNull() | F.coalesce(_b("$.konkurs"), F.lit(False))
    return _record(
        d, _s("$.organisasjonsnummer").isNotNull() & _s("$.navn").isNotNull(), connector=F.lit("no-brreg"), id=_s("$.organisasjonsnummer"),
        names=F.concat(F.array(_s("$.navn")), _each(_arr("$.historiskeNavn"), "$.navn")), legal_name=_s("$.navn"), **_nace(_s("$.naeringskode1.kode")),
        employees=F.when(_b("$.harRegistrertAntallAnsatte"), F.try_variant_get("j", "$.antallAnsatte", "long")), street=a("adresse[0]"), postcode=a("postnummer"), city=a("poststed"),
        country=F.lit("no"), legal_form=F.coalesce(_s("$.organisasjonsform.beskrivelse"), _s("$.organisasjonsform.kode")), date_created=_s("$.registreringsdatoEnhetsregisteret"),
        date_closed=_s("$.slettedato"), status=F.when(gone, "ceased").otherwise("active"), national=_national(website=_s("$.hjemmeside")),
    )


def finland(df: DataFrame) -> DataFrame:
    """Trading names, legal name, then expired names; street address before postal; ended is ceased, registered 1 is active."""
    d = _j(df)
    every = F.filter(_arr("$.names"), lambda n: F.try_variant_get(n, "$.name", "string").isNotNull())
    current = F.filter(every, lambda n: F.try_variant_get(n, "$.endDate", "string").isNull())
    expired = F.filter(every, lambda n: F.try_variant_get(n, "$.endDate", "string").isNotNull())
    of = lambda kinds: _each(F.filter(current, lambda n: F.try_variant_get(n, "$.type", "string").isin(kinds)), "$.name")
    legal, trading = F.coalesce(F.get(of(["1"]), F.lit(0)), F.get(_each(current, "$.name"), F.lit(0))), of(["2", "3"])
    addresses = _arr("$.addresses")
    typed = lambda t: F.get(F.filter(addresses, lambda a: F.try_variant_get(a, "$.type", "string") == t), F.lit(0))
    d = d.withColumn("a", F.coalesce(typed("1"), typed("2"), F.get(addresses, F.lit(0))))
    offices = F.coalesce(F.try_variant_get("a", "$.postOffices", "array<variant>"), F.array().cast("array<variant>"))
    finnish = F.get(_each(F.filter(offices, lambda o: F.try_variant_get(o, "$.languageCode", "string") == "1"), "$.city"), F.lit(0))
    return _record(
        d, _s("$.businessId.value").isNotNull(), connector=F.lit("fi-prh"), id=_s("$.businessId.value"), names=F.concat(trading, F.array(legal), _each(expired, "$.name")), legal_name=legal,
        trading_names=trading, **_nace(_s("$.mainBusinessLine.type")), street=_s("$.street", "a"), number=_s("$.buildingNumber", "a"), postcode=_s("$.postCode", "a"),
        city=F.coalesce(finnish, F.get(_each(offices, "$.city"), F.lit(0))), municipality=_s("$.postOffices[0].municipalityCode", "a"), country_name=F.lit("Finland"), country=F.lit("fi"),
        date_created=F.coalesce(_s("$.registrationDate"), _s("$.businessId.registrationDate")), date_closed=_s("$.endDate"),
        status=F.when(_s("$.endDate").isNotNull(), "ceased").when(_s("$.tradeRegisterStatus") == "1", "active").otherwise("unknown"),
    )


def czechia(df: DataFrame) -> DataFrame:
    """The first activity code that has a section, else the first; dead beats live beats unknown."""
    d = _j(df)
    codes = F.filter(F.coalesce(F.try_variant_get("j", "$.czNace2008", "array<string>"), F.array().cast("array<string>")), lambda c: c.isNotNull())
    code = F.coalesce(F.get(F.filter(codes, lambda c: score.nace_section(c).isNotNull()), F.lit(0)), F.get(codes, F.lit(0)))
    state = lambda x: (_s("$.seznamRegistraci.stavZdrojeVr").eqNullSafe(x)) | (_s("$.seznamRegistraci.stavZdrojeRes").eqNullSafe(x))
    return _record(
        d, _s("$.ico").isNotNull(), connector=F.lit("cz-ares"), id=_s("$.ico"), names=F.array(_s("$.obchodniJmeno")), legal_name=_s("$.obchodniJmeno"), **_nace(code),
        street=_s("$.sidlo.nazevUlice"), number=_s("$.sidlo.cisloDomovni"), postcode=_s("$.sidlo.psc"), city=_s("$.sidlo.nazevObce"), municipality=_s("$.sidlo.kodObce"),
        country_name=F.coalesce(_s("$.sidlo.nazevStatu"), F.lit("Česká republika")), country=F.lit("cz"), legal_form=_s("$.pravniForma"), date_created=_s("$.datumVzniku"),
        date_closed=_s("$.datumZaniku"), status=F.when(state("ZANIKLY"), "ceased").when(state("AKTIVNI"), "active").otherwise("unknown"), national=_national(dic=_s("$.dic")),
    )


def poland(df: DataFrame) -> DataFrame:
    """Nested extract; the activity is division.group.subclass and its section a letter like everywhere else."""
    d = _j(df)
    one = "$.odpis.dane.dzial1"
    name, pkd = _s(f"{one}.danePodmiotu.nazwa"), f"{one}.przedmiotDzialalnosci.przedmiotPrzewazajacejDzialalnosci[0]"
    address = lambda k: _s(f"{one}.siedzibaIAdres.adres.{k}")
    return _record(
        d, _s("$.odpis.naglowekA.numerKRS").isNotNull() & name.isNotNull(), connector=F.lit("pl-krs"), id=_s("$.odpis.naglowekA.numerKRS"), names=F.array(name), legal_name=name,
        **_nace(_joined(".", _s(f"{pkd}.dzial"), _s(f"{pkd}.grupa"), _s(f"{pkd}.podklasa"))), street=address("ulica"), number=address("nrDomu"), postcode=address("kodPocztowy"),
        city=address("miejscowosc"), country_name=F.coalesce(address("kraj"), F.lit("POLSKA")), country=F.lit("pl"), legal_form=_s(f"{one}.danePodmiotu.formaPrawna"),
        status=F.when(_s("$.odpis.naglowekA.stanPozycji").isNotNull(), "active").otherwise("unknown"),
        national=_national(nip=_s(f"{one}.danePodmiotu.identyfikatory.nip"), regon=_s(f"{one}.danePodmiotu.identyfikatory.regon")),
    )


def us_filings(df: DataFrame) -> DataFrame:
    """Ten-digit key, former names after the name, business address before mailing."""
    d = _j(df)
    cik, sic = F.lpad(_s("$.cik"), 10, "0"), _s("$.sic")
    a = lambda k: F.coalesce(_s(f"$.addresses.business.{k}"), _s(f"$.addresses.mailing.{k}"))
    return _record(
        d, _s("$.cik").isNotNull(), connector=F.lit("us-edgar"), id=cik, names=F.concat(F.array(_s("$.name")), _each(_arr("$.formerNames"), "$.name")), legal_name=_s("$.name"),
        activity_code=sic, section=score.us_sic_division(sic), activity_scheme=F.lit("us-sic"), street=a("street1"), postcode=a("zipCode"), city=a("city"),
        country_name=F.coalesce(a("stateOrCountry"), F.lit("US")), country=F.lit("us"), legal_form=_s("$.entityType"), status=F.lit("unknown"),
        national=_national(cik=cik, sic_description=_s("$.sicDescription"), state=_s("$.stateOfIncorporation")),
    )


def lei(df: DataFrame) -> DataFrame:
    d = _j(df)
    others = _each(_arr("$.attributes.entity.otherNames"), "$.name")
    a = lambda k: F.coalesce(_s(f"$.attributes.entity.legalAddress.{k}"), _s(f"$.attributes.entity.headquartersAddress.{k}"))
    state = _s("$.attributes.entity.status")
    return _record(
        d, _s("$.attributes.lei").isNotNull(), connector=F.lit("gleif"), id=_s("$.attributes.lei"), names=F.concat(others, F.array(_s("$.attributes.entity.legalName.name"))),
        legal_name=_s("$.attributes.entity.legalName.name"), trading_names=others, activity_scheme=F.lit("none"), street=a("addressLines[0]"), postcode=a("postalCode"), city=a("city"),
        country_name=a("country"), country=F.lower(_s("$.attributes.entity.legalAddress.country")), legal_form=_s("$.attributes.entity.legalForm.id"),
        status=F.when(state == "ACTIVE", "active").when(state == "INACTIVE", "ceased").otherwise("unknown"), national=_national(registered_as=_s("$.attributes.entity.registeredAs")),
    )


def registered_as(records: DataFrame, number: str) -> DataFrame:
    """Records of a fuzzy answer that carry exactly this register number, dots and spaces aside."""
    held = F.upper(F.regexp_replace(F.element_at("national", F.lit("registered_as")), r"[\s.]", ""))
    return records.where(held == number.replace(" ", "").replace(".", "").upper())


def france(df: DataFrame) -> DataFrame:
    """One record per matching establishment of a legal unit; the head office if none matched; none gives no row. The head
    office's structured address is used for itself, other addresses are read from their line."""
    d = _j(df)
    matching = _arr("$.matching_etablissements")
    seat = F.try_variant_get("j", "$.siege", "variant")
    d = d.withColumn("e", F.explode(F.when(F.size(matching) > 0, matching).otherwise(F.array_compact(F.array(seat)))))
    d = d.withColumn("line", raw_address(_s("$.adresse", "e")))
    own = _s("$.siret", "e") == _s("$.siege.siret")
    pick = lambda path, parsed: F.when(own, _s(f"$.siege.{path}")).otherwise(parsed)
    trading = F.filter(F.coalesce(F.try_variant_get("e", "$.liste_enseignes", "array<string>"), F.array().cast("array<string>")), lambda n: n.isNotNull() & (F.trim(n) != ""))
    code = F.coalesce(_s("$.activite_principale", "e"), _s("$.activite_principale"))
    state = F.coalesce(_s("$.etat_administratif", "e"), _s("$.etat_administratif"))
    officers = F.transform(
        _arr("$.dirigeants"),
        lambda o: F.concat_ws(" — ", F.coalesce(F.try_variant_get(o, "$.denomination", "string"), F.concat_ws(" ", F.try_variant_get(o, "$.prenoms", "string"), F.try_variant_get(o, "$.nom", "string"))), F.try_variant_get(o, "$.qualite", "string")),
    )
    finances = F.try_variant_get("j", "$.finances", "map<string,variant>")
    year = F.array_max(F.filter(F.map_keys(finances), lambda y: y.rlike(r"^\d{4}$")))
    return _record(
        d, _s("$.siren").isNotNull(), connector=F.lit("fr-sirene"), id=_s("$.siren"), establishment_id=_s("$.siret", "e"),
        names=F.concat(trading, F.array(_s("$.nom_complet"), _s("$.nom_raison_sociale"), _s("$.sigle"))), legal_name=text.first_text(_s("$.nom_complet"), _s("$.nom_raison_sociale")),
        trading_names=trading, **_nace(code), size_band=F.coalesce(_s("$.tranche_effectif_salarie", "e"), _s("$.tranche_effectif_salarie")), parent_band=_s("$.tranche_effectif_salarie"),
        officers=officers, number=pick("numero_voie", F.col("line.number")), kind=pick("type_voie", F.col("line.kind")), street=pick("libelle_voie", F.col("line.street")),
        postcode=pick("code_postal", F.col("line.postcode")), city=F.coalesce(_s("$.libelle_commune", "e"), F.col("line.city")), municipality=_s("$.commune", "e"), country_name=F.lit("France"),
        address_raw=_s("$.adresse", "e"), country=F.lit("fr"), lat=_s("$.latitude", "e").try_cast("double"), lon=_s("$.longitude", "e").try_cast("double"),
        status=F.when(state == "A", "active").when(state.isin("C", "F"), "ceased").otherwise("unknown"), legal_form=_s("$.nature_juridique"), date_created=_s("$.date_creation"),
        date_closed=_s("$.date_fermeture", "e"), is_head_office=F.coalesce(F.try_variant_get("e", "$.est_siege", "boolean"), F.lit(False)),
        national=_national(revenue_year=year, revenue=F.try_variant_get(F.element_at(finances, year), "$.ca", "string")),
    )


# fixed values: street type words of French address lines
LINE_TYPES = "RUE|AVENUE|AV|BOULEVARD|BD|QUAI|PLACE|PL|IMPASSE|ALLEE|ALLÉE|CHEMIN|ROUTE|RTE|COURS|SQUARE|PASSAGE|VILLA|SENTIER|ESPLANADE|PARVIS|ROND[- ]POINT|ZONE|ZA|ZI|ZAC|LIEU[- ]DIT|CITE|CITÉ|FAUBOURG"


def raw_address(line: Column) -> Column:
    """``54 QUAI CHARLES PASQUA 92300 LEVALLOIS-PERRET`` -> number, kind, street, postcode, city."""
    pattern = r"^(?:(\d+[A-Z]?)\s+)?(.*?)\s+(\d{5})\s+(.+)$"
    g = lambda i: F.nullif(F.regexp_extract(F.trim(line), pattern, i), F.lit(""))
    kinds = rf"(?i)^({LINE_TYPES})\s+(.+)$"
    kind, rest = (F.nullif(F.regexp_extract(F.trim(g(2)), kinds, i), F.lit("")) for i in (1, 2))
    return F.struct(g(1).alias("number"), F.upper(kind).alias("kind"), F.coalesce(rest, F.trim(g(2))).alias("street"), g(3).alias("postcode"), g(4).alias("city"))


def german_address(line: Column, town: Column) -> Column:
    clean = F.regexp_replace(F.trim(line), r"\.$", "")
    g = lambda i: F.nullif(F.trim(F.regexp_extract(clean, r"^(.*?),\s*(\d{5})\s+(.+)$", i)), F.lit(""))
    return F.struct(g(1).alias("street"), g(2).alias("postcode"), F.coalesce(g(3), town).alias("city"))


def vat_address(raw: Column) -> Column:
    """Lines of a VAT answer: the first is the street, the rest postcode and city."""
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    tail = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " ")
    code, city = (F.nullif(F.regexp_extract(tail, r"\b([A-Z]{0,2}-?\d{4,6})\s+(.+)$", i), F.lit("")) for i in (1, 2))
    return F.struct(F.get(lines, F.lit(0)).alias("street"), code.alias("postcode"), F.coalesce(city, F.when(code.isNull(), F.nullif(tail, F.lit("")))).alias("city"))


def disclosed(c: Column) -> Column:
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("---"))


def vat_verdict(payload: Column) -> Column:
    """valid or invalid as the member state says; anything else, an outage too, is inconclusive."""
    v = F.try_parse_json(payload)
    return (
        F.when(F.try_variant_get(v, "$.isValid", "boolean").eqNullSafe(True), "valid")
        .when(F.try_variant_get(v, "$.userError", "string").eqNullSafe("INVALID"), "invalid")
        .otherwise("inconclusive")
    )


def vat_prefix(country: Column) -> Column:
    """Greece writes EL before its numbers, all others their country code."""
    cc = F.upper(country)
    return F.when(cc == "GR", "EL").otherwise(cc)


def vat_records(answers: DataFrame) -> DataFrame:
    """``answers(country, vat, payload)``: a record only of a valid number whose holder is named; a blank or ``---`` is not
    disclosed."""
    d = _j(answers)
    cc = vat_prefix(F.col("country"))
    number = F.concat(cc, F.regexp_replace(F.regexp_replace("vat", "(?i)^[A-Z]{2}", ""), r"[\s.-]", ""))
    name, raw = disclosed(_s("$.name")), disclosed(_s("$.address"))
    d = d.withColumn("a", vat_address(raw)).withColumn("number_", number).withColumn("cc_", cc)
    return _record(
        d, (vat_verdict(F.col("payload")) == "valid") & name.isNotNull(), connector=F.lit("eu-vies"), id=F.col("number_"), names=F.array(name), legal_name=name, activity_scheme=F.lit("none"),
        street=F.col("a.street"), postcode=F.col("a.postcode"), city=F.col("a.city"), address_raw=raw, country_name=F.col("cc_"), country=F.lower("cc_"), status=F.lit("active"),
        source_url=F.lit("https://ec.europa.eu/taxation_customs/vies/"), national=_national(vat=F.col("number_")),
    )


def uk_live(df: DataFrame) -> DataFrame:
    """Company profiles and search hits: the legal form under either name, previous names after the name, only "active" trades."""
    d = _j(df)
    number, state = F.upper(_s("$.company_number")), _s("$.company_status")
    code = F.nullif(F.regexp_extract(F.coalesce(_s("$.sic_codes[0]"), F.lit("")), r"^(\d{4,5})", 1), F.lit(""))
    admin = code.isin(list(ADMINISTRATIVE_SIC))
    a = lambda k: _s(f"$.registered_office_address.{k}")
    street = _joined(" ", a("premises"), a("address_line_1"), a("address_line_2"))
    return _record(
        d, number.isNotNull() & (number != ""), connector=F.lit("gb-companies-house"), id=number, names=F.concat(F.array(_s("$.company_name")), _each(_arr("$.previous_company_names"), "$.name")),
        legal_name=_s("$.company_name"), activity_code=code, section=F.when(~admin, score.nace_section(code)), activity_scheme=F.lit("nace"), number=a("premises"), street=a("address_line_1"),
        postcode=a("postal_code"), city=a("locality"), address_raw=_joined(", ", street, a("locality"), a("postal_code")), country_name=F.coalesce(a("country"), F.lit("United Kingdom")), country=F.lit("gb"),
        legal_form=F.coalesce(_s("$.type"), _s("$.company_type")), date_created=_s("$.date_of_creation"), date_closed=_s("$.date_of_cessation"),
        status=F.when(state == "active", "active").when(F.coalesce(state, F.lit("")) != "", "ceased").otherwise("unknown"),
        source_url=F.concat(F.lit("https://find-and-update.company-information.service.gov.uk/company/"), _s("$.company_number")),
        national=_national(company_status=state, administrative=F.element_at(F.create_map(*[F.lit(x) for kv in ADMINISTRATIVE_SIC.items() for x in kv]), code)),
    )


def one_per_establishment(records: DataFrame, order: Column) -> DataFrame:
    """One record per establishment, the first seen; a unit without one counts as itself."""
    return diff.first_seen(records, F.coalesce("establishment_id", F.concat(F.lit("siren:"), F.col("id"))), order)


def ticker_search(index: DataFrame, wanted: DataFrame, limit: int = 5) -> DataFrame:
    """``index(ord, id, name, ticker)`` of listed companies, ``wanted(query, name)``: companies whose name holds the whole wanted
    text (letters, digits and blanks, three at least), the first ``limit`` in index order, ten at most. Names meet on the first three
    characters of the wanted text, so no pair is compared that cannot match."""
    needle = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9 ]+", " "))
    w = wanted.select("query", needle.alias("needle")).where("length(needle) >= 3").withColumn("k", F.substr("needle", F.lit(1), F.lit(3)))
    low = F.lower("name")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))
    i = index.where("id is not null and name <> ''").select("ord", "id", "name", "ticker", low.alias("low"), F.explode(grams).alias("k"))
    hit = w.join(i, "k").where(F.contains("low", F.col("needle")))
    rank = F.row_number().over(W.partitionBy("query").orderBy("ord"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= min(10, limit)).select("query", "rank", "id", "name", "ticker")


def split_native(c: Column) -> Column:
    """``Court HRB 123`` -> court, kind, number."""
    g = lambda i: F.nullif(F.trim(F.regexp_extract(F.trim(c), r"^(.+?)\s+(HRA|HRB|GnR|VR|PR)\s+(\S+(?:\s+\S+)?)$", i)), F.lit(""))
    return F.struct(g(1).alias("court"), g(2).alias("kind"), g(3).alias("number"))


# fixed values: UK activity codes that say how a company is run, not what it does
ADMINISTRATIVE_SIC = {"99999": "dormant company", "98000": "residents property management"}


def uk_bulk(rows: DataFrame) -> DataFrame:
    """Rows of the UK export (dots in names as underscores) with ``localities`` and ``ids``."""
    c = lambda k: F.nullif(F.trim(F.col(f"`{k}`")), F.lit(""))
    code = F.nullif(F.regexp_extract(F.trim(F.col("`SICCode.SicText_1`")), r"^(\d{4,5})", 1), F.lit(""))
    admin = code.isin(list(ADMINISTRATIVE_SIC))
    town, state = c("RegAddress.PostTown"), F.lower(c("CompanyStatus"))
    d = rows.withColumn("j", F.lit(None).cast("string"))
    names = F.array(c("CompanyName"), *[c(f"PreviousName_{i}.CompanyName") for i in range(1, 6)])
    out = _record(
        d, c("CompanyNumber").isNotNull() & c("CompanyName").isNotNull(), connector=F.lit("gb-companies-house"), id=F.upper(c("CompanyNumber")), names=names, legal_name=c("CompanyName"),
        activity_code=code, section=F.when(~admin, score.nace_section(code)), activity_scheme=F.lit("nace"), street=c("RegAddress.AddressLine1"), postcode=c("RegAddress.PostCode"), city=town,
        country_name=F.coalesce(c("RegAddress.Country"), F.lit("United Kingdom")), country=F.lit("gb"), legal_form=c("CompanyCategory"),
        status=F.when(state.isNull(), "unknown").when(state == "active", "active").otherwise("ceased"), date_created=c("IncorporationDate"), date_closed=c("DissolutionDate"),
        national=_national(administrative=F.element_at(F.create_map(*[F.lit(x) for kv in ADMINISTRATIVE_SIC.items() for x in kv]), code)),
    )
    return out.withColumn("localities", F.array_compact(F.array("city"))).withColumn("ids", F.array("id"))


def german_bulk(df: DataFrame) -> DataFrame:
    """JSON lines of the German export; each row is dated by when it was retrieved."""
    d = _j(df)
    native, town = F.trim(_s("$.all_attributes.native_company_number")), F.trim(_s("$.all_attributes.registered_office"))
    d = d.withColumn("n", split_native(native)).withColumn("a", german_address(_s("$.registered_address"), town)).withColumn("town", town).withColumn("native", native)
    state = _s("$.current_status")
    officer = lambda o: F.concat_ws(" — ", F.concat_ws(" ", F.try_variant_get(o, "$.other_attributes.firstname", "string"), F.coalesce(F.try_variant_get(o, "$.other_attributes.lastname", "string"), F.try_variant_get(o, "$.name", "string"))), F.try_variant_get(o, "$.position", "string"))
    short = F.concat_ws(" ", "n.kind", "n.number")
    out = _record(
        d, (F.trim(_s("$.name")) != "") & native.isNotNull(), connector=F.lit("de-offeneregister"), id=F.col("native"), names=F.array(F.trim(_s("$.name"))), legal_name=F.trim(_s("$.name")),
        officers=F.transform(_arr("$.officers"), officer), street=F.col("a.street"), postcode=F.col("a.postcode"), city=F.col("a.city"), country_name=F.lit("Germany"), country=F.lit("de"),
        status=F.when(state == "currently registered", "active").when(state == "removed", "ceased").otherwise("unknown"), as_of=F.substr(_s("$.retrieved_at"), F.lit(1), F.lit(10)),
        national=_national(register_number=F.nullif(short, F.lit("")), court=F.coalesce("n.court", _s("$.all_attributes.registrar")), state=_s("$.all_attributes.federal_state"), town=F.col("town")),
    )
    out = out.withColumn("localities", F.array_compact(F.array(F.element_at("national", F.lit("town")))))
    return out.withColumn("ids", F.array_compact(F.array(F.col("id"), F.element_at("national", F.lit("register_number")))))


def estonian_localities(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: F.length(x) > 1))


def estonian_bulk(rows: DataFrame) -> DataFrame:
    c = lambda k: F.nullif(F.trim(F.col(k)), F.lit(""))
    places, state = estonian_localities(F.col("asukoha_ehak_tekstina")), F.upper(c("ettevotja_staatus"))
    created = F.array_join(F.reverse(F.split(c("ettevotja_esmakande_kpv"), r"\.")), "-")
    out = _record(
        rows.withColumn("loc", places), c("nimi").isNotNull() & c("ariregistri_kood").isNotNull(), connector=F.lit("ee-ariregister"), id=c("ariregistri_kood"), names=F.array(c("nimi")), legal_name=c("nimi"),
        address_raw=F.coalesce(c("ads_normaliseeritud_taisaadress"), c("ettevotja_aadress")), street=c("asukoht_ettevotja_aadressis"), postcode=c("indeks_ettevotja_aadressis"), city=F.get("loc", F.lit(0)),
        country_name=F.lit("Estonia"), country=F.lit("ee"), status=F.when(state == "R", "active").when(state.isin("L", "N"), "ceased").otherwise("unknown"), legal_form=c("ettevotja_oiguslik_vorm"),
        date_created=created, national=_national(vat=c("kmkr_nr"), localities=F.array_join("loc", "\n")),
    )
    out = out.withColumn("localities", F.filter(F.split(F.coalesce(F.element_at("national", F.lit("localities")), F.lit("")), "\n"), lambda x: x != ""))
    return out.withColumn("ids", F.array_compact(F.array(F.col("id"), F.element_at("national", F.lit("vat")))))


def verify_id_form(connector: str, value: Column, kind: Column | None = None) -> Column:
    """An identifier as its register writes it; null if the register has no such kind or the value no such shape. Without a kind
    the register's own is meant."""
    digits, squeezed = F.regexp_replace(value, r"\D", ""), F.upper(F.regexp_replace(value, r"\s+", ""))
    own = lambda *kinds: F.lit(True) if kind is None else F.lower(kind).isin([k.lower() for k in kinds])
    is_vat = F.lit(False) if kind is None else F.lower(kind) == "vat"
    n = F.length(digits)
    if connector == "fr-sirene":
        siren = F.when(own("siren") & (n == 9), digits).when(own("siret") & (n == 14), F.substr(digits, F.lit(1), F.lit(9)))
        return siren.when(is_vat & (n == 11), F.substr(digits, F.lit(3), F.lit(9)))
    if connector == "gb-companies-house":
        padded = F.when(squeezed.rlike(r"^\d+$"), F.lpad(squeezed, 8, "0")).otherwise(squeezed)
        return F.when(own("company-number") & squeezed.rlike(r"^(?:\d{6,8}|[A-Z]{2}\d{6})$"), padded)
    if connector == "de-offeneregister":
        return F.when(own("HRA", "HRB", "GnR", "VR", "PR"), F.regexp_replace(F.trim(value), r"\s+", " "))
    if connector == "no-brreg":
        return F.when(own("vat", "orgnr", "company-number") & (n >= 9), F.substr(digits, F.lit(1), F.lit(9)))
    if connector == "fi-prh":
        vat = F.when(n == 8, F.concat(F.substr(digits, F.lit(1), F.lit(7)), F.lit("-"), F.substr(digits, F.lit(8), F.lit(1))))
        return F.when(is_vat, vat).when(F.trim(value).rlike(r"^\d{7}-\d$"), F.trim(value))
    if connector == "cz-ares":
        return F.when(own("vat", "ico", "company-number") & n.between(1, 8), F.lpad(digits, 8, "0"))
    if connector == "pl-krs":
        return F.when(own("krs", "company-number") & n.between(1, 10), F.lpad(digits, 10, "0"))
    if connector == "us-edgar":
        cik = F.when(n <= 10, F.lpad(digits, 10, "0")).otherwise(digits)
        return F.when(own("cik") & (cik != "0000000000"), cik)
    if connector == "ee-ariregister":
        return F.when(is_vat & squeezed.rlike(r"^EE\d{9}$"), squeezed).when(~is_vat & squeezed.rlike(r"^\d{8}$"), squeezed)
    if connector == "gleif":
        lei = F.lit(True) if kind is None else F.lower(kind) == "lei"
        return F.when(lei, F.upper(value)).otherwise(F.nullif(F.upper(F.regexp_replace(value, r"[\s.]", "")), F.lit("")))
    if connector == "eu-vies":
        return F.when(F.lit(True) if kind is None else is_vat, F.nullif(F.regexp_replace(F.regexp_replace(value, "(?i)^[A-Z]{2}", ""), r"[\s.-]", ""), F.lit("")))
    raise ValueError(f"unknown connector {connector}")


# connectors in the order they are asked: (id, countries, can sweep, label)
CONNECTORS = [
    ("fr-sirene", "fr", True), ("gb-companies-house", "gb", True), ("de-offeneregister", "de", False), ("no-brreg", "no", True), ("fi-prh", "fi", True), ("cz-ares", "cz", False),
    ("pl-krs", "pl", False), ("us-edgar", "us", False), ("ee-ariregister", "ee", True), ("eu-vies", "eu", False), ("gleif", "*", False),
]


# fixed values: namespaces of activity codes by register
ACTIVITY_PREFIXES = {
    "fr-sirene": "naf", "gb-companies-house": "sic-uk", "de-offeneregister": "de-offeneregister", "no-brreg": "nace-no", "fi-prh": "tol", "cz-ares": "cz-nace",
    "pl-krs": "pkd", "us-edgar": "sic", "ee-ariregister": "ee-ariregister", "eu-vies": "vat", "gleif": "lei",
}


def to_places(records: DataFrame) -> DataFrame:
    """Register records as places of their own: named by the first name that is not blank, else by number; the activity code carries the
    namespace of its nomenclature, as codes of two of them do not compare."""
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ACTIVITY_PREFIXES.items() for x in kv]), F.col("connector")), F.lit("activity"))
    named = F.get(F.filter(F.transform("names", lambda n: F.trim(n)), lambda n: n != ""), F.lit(0))
    code = F.nullif(F.col("activity_code"), F.lit(""))
    return records.select(
        F.concat_ws(":", "connector", F.coalesce("establishment_id", "id")).alias("place_id"), F.coalesce(named, "id").alias("name"), F.array(F.lit("registry")).alias("sources"),
        F.concat(prefix, F.lit("="), code).alias("category"), "number", "street", "postcode", "city", "lat", "lon", F.lit("sweep").alias("evidence"),
    )


def connectors_for(spark, country: str, available: dict[str, str] | None = None) -> DataFrame:
    """``(connector, role, reason)``: the first that sweeps, all that look up, and why one is unavailable."""
    rows = ", ".join(f"({i}, '{c}', '{cc}', {str(s).lower()})" for i, (c, cc, s) in enumerate(CONNECTORS))
    d = spark.sql(f"SELECT * FROM VALUES {rows} AS t(ord, connector, country, sweeps)").where(F.col("country").isin(country.lower(), "*"))
    reason = F.lit(None).cast("string")
    for c, why in (available or {}).items():
        reason = F.when(F.col("connector") == c, why).otherwise(reason)
    d = d.withColumn("reason", reason)
    usable = F.col("reason").isNull() & F.col("sweeps")
    first = F.row_number().over(W.partitionBy(usable).orderBy("ord")) == 1
    return d.select("ord", "connector", F.when(F.col("reason").isNotNull(), "unavailable").when(usable & first, "sweep").otherwise("lookup").alias("role"), "reason").orderBy("ord")


def unknown_connectors(asked: DataFrame) -> DataFrame:
    """``asked(connector)`` that no register has."""
    return asked.where(~F.trim("connector").isin([c for c, _, _ in CONNECTORS])).select("connector").distinct()


def divisions_of_section(spark, catalogue_path: str, section: str) -> DataFrame:
    """Activity codes of a section, grouped into divisions, from a catalogue file ``code,label``; the catalogue has over
    seven hundred codes and is a parameter, not part of the package."""
    codes = spark.read.csv(catalogue_path, header=True, schema="code string, label string")
    own = codes.where(score.nace_section(F.col("code")) == section)
    return own.groupBy(F.substr("code", F.lit(1), F.lit(2)).alias("division")).agg(F.sort_array(F.collect_list("code")).alias("codes")).orderBy("division")
