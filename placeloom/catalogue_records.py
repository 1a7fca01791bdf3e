"""Registered queries of register mappers, bulk rows, boards, sitemaps, look-ups, counts and deliverables.

Payloads are built from keys of the driver tables by SQL that both engines read; the SQL beside each query states what
must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom import scratch_dir
from placeloom.catalogue import _base, _case, _duck, _places, _query, _scored, _table, PLACES, USERS
from placeloom.functions import extract, text
from placeloom.operators import confirm, content, diff, gate, match, resolve, score, summary
from placeloom.plans import render, sweep
from placeloom.sources import boards, bulk, places, poi, registers

K = "CAST(s_suppkey AS STRING)"
DIVISION = "lpad(CAST(s_suppkey % 100 AS STRING), 2, '0')"
NACE = "CASE " + " ".join(f"WHEN s_suppkey % 100 BETWEEN {a} AND {b} THEN '{x}'" for x, a, b, _ in score.dims.NACE_SECTIONS) + " END"


def _payload(spark: SparkSession, d: str, sql: str, table: str = "supplier") -> DataFrame:
    return _base(spark, d, f"SELECT {sql} AS payload FROM {{{table}}}", table)


def _flat(c: str):
    return F.array_join(c, "|").alias(c)


# register mappers -----------------------------------------------------------------------------------------------------


@_query(
    f"""SELECT '9' || lpad({K.replace("STRING", "VARCHAR")}, 8, '0') AS id, s_name || '|Old ' || s_name AS names, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN 'ceased' ELSE 'active' END AS status,
CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS employees, {NACE} AS section, CASE WHEN s_suppkey % 3 = 0 THEN 'OSLO' ELSE 'BERGEN' END AS city, 'Aksjeselskap' AS legal_form FROM supplier"""
)
def norwegian_mapping(spark: SparkSession, d: str) -> DataFrame:
    sql = f"""concat('{{{{"organisasjonsnummer":"9', lpad({K}, 8, '0'), '","navn":"', s_name, '","historiskeNavn":[{{{{"navn":"Old ', s_name, '"}}}}],"organisasjonsform":{{{{"kode":"AS","beskrivelse":"Aksjeselskap"}}}},"naeringskode1":{{{{"kode":"', {DIVISION}, '.100"}}}},
      "harRegistrertAntallAnsatte":', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"antallAnsatte":', {K}, ',"konkurs":', CASE WHEN s_suppkey % 5 = 0 THEN 'true' ELSE 'false' END, CASE WHEN s_suppkey % 7 = 0 THEN ',"slettedato":"2020-01-01"' ELSE '' END,
      CASE WHEN s_suppkey % 3 = 0 THEN ',"beliggenhetsadresse":{{{{"poststed":"OSLO"}}}}' ELSE '' END, ',"postadresse":{{{{"poststed":"BERGEN"}}}}}}}}')"""
    return registers.norway(_payload(spark, d, sql)).select("id", _flat("names"), "status", "employees", "section", "city", "legal_form")


@_query(
    f"""SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 100 IN (0, 4, 34, 40, 44, 48, 54, 57, 67, 76, 83, 89) THEN NULL ELSE {NACE} END AS section, CASE WHEN s_suppkey % 4 IN (0, 1) THEN 'ceased' WHEN s_suppkey % 4 = 2 THEN 'active' ELSE 'unknown' END AS status,
CASE WHEN s_suppkey % 2 = 0 THEN 'Česká republika' ELSE 'Slovensko' END AS country_name FROM supplier"""
)
def czech_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Dead in either register is ceased; the first code that has a section counts."""
    sql = f"""concat('{{{{"ico":"', {K}, '","obchodniJmeno":"', s_name, '","czNace2008":["00","', {DIVISION}, '1"],"seznamRegistraci":{{{{', CASE s_suppkey % 4 WHEN 0 THEN '"stavZdrojeVr":"AKTIVNI","stavZdrojeRes":"ZANIKLY"' WHEN 1 THEN '"stavZdrojeVr":"ZANIKLY"' WHEN 2 THEN '"stavZdrojeRes":"AKTIVNI"' ELSE '"stavZdrojeRes":"x"' END, '}}}}',
      CASE WHEN s_suppkey % 2 = 1 THEN ',"sidlo":{{{{"nazevStatu":"Slovensko"}}}}' ELSE '' END, '}}}}')"""
    return registers.czechia(_payload(spark, d, sql)).select("id", "section", "status", "country_name")


@_query(f"SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS id, {DIVISION.replace('STRING', 'VARCHAR')} || '.1.Z' AS activity_code, {NACE} AS section, CASE WHEN s_suppkey % 3 > 0 THEN 'active' ELSE 'unknown' END AS status, 'POLSKA' AS country_name, s_suppkey::VARCHAR AS nip FROM supplier WHERE s_suppkey % 9 > 0")
def polish_mapping(spark: SparkSession, d: str) -> DataFrame:
    sql = f"""concat('{{{{"odpis":{{{{"naglowekA":{{{{"numerKRS":"', lpad({K}, 10, '0'), '"', CASE WHEN s_suppkey % 3 > 0 THEN ',"stanPozycji":1' ELSE '' END, '}}}},"dane":{{{{"dzial1":{{{{"danePodmiotu":{{{{', CASE WHEN s_suppkey % 9 > 0 THEN concat('"nazwa":"', s_name, '",') ELSE '' END, '"identyfikatory":{{{{"nip":"', {K}, '"}}}}}}}},
      "przedmiotDzialalnosci":{{{{"przedmiotPrzewazajacejDzialalnosci":[{{{{"dzial":"', {DIVISION}, '","grupa":"1","podklasa":"Z"}}}}]}}}}}}}}}}}}}}}}}}}}')"""
    return registers.poland(_payload(spark, d, sql)).select("id", "activity_code", "section", "status", "country_name", F.element_at("national", F.lit("nip")).alias("nip"))


@_query("SELECT 'LEI' || s_suppkey::VARCHAR AS id, 'Trade|' || s_name AS names, CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'ceased' ELSE 'unknown' END AS status, 'de' AS country, 'HRB ' || s_suppkey::VARCHAR AS registered_as FROM supplier")
def lei_mapping(spark: SparkSession, d: str) -> DataFrame:
    sql = f"""concat('{{{{"attributes":{{{{"lei":"LEI', {K}, '","entity":{{{{"legalName":{{{{"name":"', s_name, '"}}}},"otherNames":[{{{{"name":"Trade"}}}}],"status":"', CASE s_suppkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'INACTIVE' ELSE 'NULL' END, '","registeredAs":"HRB ', {K}, '","legalAddress":{{{{"country":"DE"}}}}}}}}}}}}}}}}')"""
    return registers.lei(_payload(spark, d, sql)).select("id", _flat("names"), "status", "country", F.element_at("national", F.lit("registered_as")).alias("registered_as"))


FRENCH = f"""concat('{{{{"siren":"', {K}, '","nom_complet":"', s_name, '","activite_principale":"', {DIVISION}, '.10Z","tranche_effectif_salarie":"42","finances":{{{{"2021":{{{{"ca":5}}}},"2022":{{{{"ca":', {K}, '}}}},"note":{{{{}}}}}}}},"dirigeants":[{{{{"nom":"X","prenoms":"Y","qualite":"Z"}}}},{{{{"denomination":"HOLD"}}}}],
  "siege":{{{{"siret":"', {K}, '1","numero_voie":"54","type_voie":"QUAI","libelle_voie":"DU PORT","latitude":"48.8","est_siege":true,"etat_administratif":"', CASE WHEN s_suppkey % 3 = 0 THEN 'C' ELSE 'A' END, '"}}}}',
  CASE WHEN s_suppkey % 2 = 0 THEN concat(',"matching_etablissements":[{{{{"siret":"', {K}, '1","est_siege":true,"etat_administratif":"A","liste_enseignes":["Trade"," "]}}}},{{{{"siret":"', {K}, '2","adresse":"3 RUE DU MIDI 94300 VINCENNES","etat_administratif":"F","tranche_effectif_salarie":"01"}}}}]') ELSE '' END, '}}}}')"""


@_query(
    f"""WITH e AS (SELECT s_suppkey, s_name, unnest(CASE WHEN s_suppkey % 2 = 0 THEN [1, 2] ELSE [3] END) AS kind FROM supplier)
SELECT s_suppkey::VARCHAR AS id, s_suppkey::VARCHAR || CASE WHEN kind = 2 THEN '2' ELSE '1' END AS establishment_id, CASE WHEN kind = 1 THEN 'Trade|' ELSE '' END || s_name AS names, {NACE} AS section, CASE WHEN kind = 2 THEN '01' ELSE '42' END AS size_band, '42' AS parent_band,
  CASE WHEN kind = 2 THEN '3' ELSE '54' END AS number, CASE WHEN kind = 2 THEN 'RUE' ELSE 'QUAI' END AS kind, CASE WHEN kind = 2 THEN 'DU MIDI' ELSE 'DU PORT' END AS street, CASE WHEN kind = 2 THEN '94300' END AS postcode, CASE WHEN kind = 2 THEN 'VINCENNES' END AS city,
  CASE WHEN kind = 2 THEN 'ceased' WHEN kind = 1 THEN 'active' WHEN s_suppkey % 3 = 0 THEN 'ceased' ELSE 'active' END AS status, kind <> 2 AS is_head_office, 'Y X — Z|HOLD' AS officers, '2022' AS revenue_year, s_suppkey::VARCHAR AS revenue FROM e"""
)
def french_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Units to establishments: matching ones, else the head office; newest money; structured and parsed addresses."""
    r = registers.france(_payload(spark, d, FRENCH))
    national = [F.element_at("national", F.lit(k)).alias(k) for k in ("revenue_year", "revenue")]
    return r.select("id", "establishment_id", _flat("names"), "section", "size_band", "parent_band", "number", "kind", "street", "postcode", "city", "status", "is_head_office", _flat("officers"), *national)


@_query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey // 4)::VARCHAR END AS establishment_id, min(s_suppkey) AS ord FROM supplier GROUP BY CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey // 4)::VARCHAR ELSE 'siren:' || (s_suppkey // 8)::VARCHAR END, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey // 4)::VARCHAR END")
def establishment_dedupe(spark: SparkSession, d: str) -> DataFrame:
    r = _base(spark, d, "SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey DIV 4 AS STRING) END AS establishment_id, CAST(s_suppkey DIV 8 AS STRING) AS id FROM {supplier}", "supplier")
    return registers.one_per_establishment(r, F.col("ord")).select("establishment_id", "ord")


@_query(
    f"""SELECT 'SC' || lpad(s_suppkey::VARCHAR, 6, '0') AS id, s_name || '|Before' AS names, CASE s_suppkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'ceased' WHEN 2 THEN 'ceased' ELSE 'unknown' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'ltd' ELSE 'plc' END AS legal_form,
CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE {NACE} END AS section, CASE WHEN s_suppkey % 3 = 0 THEN 'dormant company' END AS administrative, '1 High St, LEEDS, LS1' AS address_raw, 'United Kingdom' AS country_name FROM supplier"""
)
def uk_live_mapping(spark: SparkSession, d: str) -> DataFrame:
    sql = f"""concat('{{{{"company_number":"sc', lpad({K}, 6, '0'), '","company_name":"', s_name, '","previous_company_names":[{{{{"name":"Before"}}}}],', CASE WHEN s_suppkey % 2 = 0 THEN '"type":"ltd"' ELSE '"company_type":"plc"' END, ',"sic_codes":["', CASE WHEN s_suppkey % 3 = 0 THEN '99999' ELSE concat({DIVISION}, '100') END, '"],
      "registered_office_address":{{{{"premises":"1","address_line_1":"High St","locality":"LEEDS","postal_code":"LS1"}}}}', CASE s_suppkey % 4 WHEN 0 THEN ',"company_status":"active"' WHEN 1 THEN ',"company_status":"dissolved"' WHEN 2 THEN ',"company_status":"liquidation"' ELSE '' END, '}}}}')"""
    r = registers.uk_live(_payload(spark, d, sql))
    return r.select("id", _flat("names"), "status", "legal_form", "section", F.element_at("national", F.lit("administrative")).alias("administrative"), "address_raw", "country_name")


@_query("SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'valid' WHEN 2 THEN 'invalid' ELSE 'inconclusive' END AS verdict FROM supplier")
def vat_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _vat_answers(spark, d).select("k", registers.vat_verdict(F.col("payload")).alias("verdict"))


def _vat_answers(spark: SparkSession, d: str) -> DataFrame:
    sql = """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 8 < 4 THEN 'gr' ELSE 'lu' END AS country, concat(CASE WHEN s_suppkey % 8 < 4 THEN 'el ' ELSE '' END, '12.', CAST(s_suppkey AS STRING)) AS vat,
      concat('{{"isValid":', CASE WHEN s_suppkey % 4 < 2 THEN 'true' ELSE 'false' END, ',"userError":"', CASE s_suppkey % 4 WHEN 2 THEN 'INVALID' WHEN 3 THEN 'MS_UNAVAILABLE' ELSE 'VALID' END, '","name":"', CASE WHEN s_suppkey % 4 = 1 THEN '---' ELSE s_name END, '","address":"RUE X 1\\\\nL-1219 LUX"}}') AS payload FROM {supplier}"""
    return _base(spark, d, sql, "supplier")


@_query("SELECT CASE WHEN s_suppkey % 8 < 4 THEN 'EL12' ELSE 'LU12' END || s_suppkey::VARCHAR AS id, s_name AS legal_name, CASE WHEN s_suppkey % 8 < 4 THEN 'el' ELSE 'lu' END AS country, 'RUE X 1' AS street, 'L-1219' AS postcode, 'LUX' AS city FROM supplier WHERE s_suppkey % 4 = 0")
def vat_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Only valid numbers with a named holder become records."""
    return registers.vat_records(_vat_answers(spark, d)).select("id", "legal_name", "country", "street", "postcode", "city")


@_query(
    """SELECT s_suppkey AS k, CASE WHEN s_suppkey > 0 THEN lpad(s_suppkey::VARCHAR, 8, '0') END AS cz_ares, CASE WHEN s_suppkey > 0 THEN lpad(s_suppkey::VARCHAR, 10, '0') END AS pl_krs, lpad((900000 + s_suppkey)::VARCHAR, 8, '0') AS gb_companies_house,
lpad((900000 + s_suppkey)::VARCHAR, 10, '0') AS us_edgar, CASE WHEN s_suppkey % 2 = 0 THEN substr((302474000 + s_suppkey)::VARCHAR, 1, 9) END AS fr_sirene FROM supplier WHERE s_suppkey > 0"""
)
def identifier_forms(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers as their registers write them."""
    s = _base(spark, d, "SELECT s_suppkey AS k, CAST(s_suppkey AS STRING) AS v, CAST(900000 + s_suppkey AS STRING) AS w, concat(CASE WHEN s_suppkey % 2 = 0 THEN 'FR12' ELSE 'FR' END, CAST(302474000 + s_suppkey AS STRING)) AS fr FROM {supplier} WHERE s_suppkey > 0", "supplier")
    form = lambda c, v, k: registers.verify_id_form(c, F.col(v), F.lit(k)).alias(c.replace("-", "_"))
    return s.select("k", form("cz-ares", "v", "ico"), form("pl-krs", "v", "krs"), form("gb-companies-house", "w", "company-number"), form("us-edgar", "w", "cik"), form("fr-sirene", "fr", "vat"))


@_query("SELECT r.r_regionkey AS query, row_number() OVER (PARTITION BY r.r_regionkey ORDER BY s.s_suppkey) AS rank, s.s_suppkey AS id FROM region r JOIN supplier s ON contains(s.s_name, 'Supplier#' || lpad('', 8, '0') || (r.r_regionkey + 1)::VARCHAR) OR contains(s.s_name, '00' || (r.r_regionkey + 1)::VARCHAR) QUALIFY rank <= 5".replace("contains(s.s_name, 'Supplier#' || lpad('', 8, '0') || (r.r_regionkey + 1)::VARCHAR) OR ", ""))
def ticker_hits(spark: SparkSession, d: str) -> DataFrame:
    """Listed companies by part of their name, the first five in index order."""
    index = _base(spark, d, "SELECT s_suppkey AS ord, s_suppkey AS id, s_name AS name, 'T' AS ticker FROM {supplier}", "supplier")
    wanted = _base(spark, d, "SELECT r_regionkey AS query, concat('00', CAST(r_regionkey + 1 AS STRING), ' !') AS name FROM {region} UNION ALL SELECT 99, 'a.' FROM {region}", "region")
    return registers.ticker_search(index, wanted).select("query", "rank", "id")


@_query("SELECT 'nowhere' AS connector")
def unknown_connectors(spark: SparkSession, d: str) -> DataFrame:
    asked = _base(spark, d, "SELECT CASE r_regionkey % 3 WHEN 0 THEN 'gleif' WHEN 1 THEN 'nowhere' ELSE ' eu-vies ' END AS connector FROM {region}", "region")
    return registers.unknown_connectors(asked)


@_query("SELECT * FROM (VALUES ('fr-sirene', 'sweep', NULL), ('gleif', 'lookup', NULL)) t(connector, role, reason)")
def connector_roles(spark: SparkSession, d: str) -> DataFrame:
    return registers.connectors_for(spark, "FR").select("connector", "role", "reason")


@_query(
    f"""SELECT s_suppkey::VARCHAR AS id, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '|OLD' ELSE '' END AS names, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE {NACE} END AS section, CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'ceased' ELSE 'unknown' END AS status, 'LEEDS' AS localities FROM supplier WHERE s_name IS NOT NULL AND s_suppkey % 8 > 0"""
)
def uk_bulk_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = _base(
        spark, d, f"""SELECT CASE WHEN s_suppkey % 8 > 0 THEN {K} ELSE ' ' END AS `CompanyNumber`, concat(s_name, ' ') AS `CompanyName`, concat(CASE WHEN s_suppkey % 5 = 0 THEN '99999' ELSE concat({DIVISION}, '100') END, ' - label') AS `SICCode.SicText_1`, 'LEEDS' AS `RegAddress.PostTown`, '1 High St' AS `RegAddress.AddressLine1`, '' AS `RegAddress.PostCode`, '' AS `RegAddress.Country`,
        'Private' AS `CompanyCategory`, CASE s_suppkey % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Liquidation' ELSE '' END AS `CompanyStatus`, '' AS `IncorporationDate`, '' AS `DissolutionDate`, CASE WHEN s_suppkey % 2 = 0 THEN 'OLD' ELSE '' END AS `PreviousName_1.CompanyName`, '' AS `PreviousName_2.CompanyName`, '' AS `PreviousName_3.CompanyName`, '' AS `PreviousName_4.CompanyName`, '' AS `PreviousName_5.CompanyName` FROM {{supplier}}""", "supplier"
    )
    return registers.uk_bulk(rows).select("id", _flat("names"), "section", "status", _flat("localities"))


@_query("SELECT 'Köln HRB ' || s_suppkey::VARCHAR AS id, 'Köln HRB ' || s_suppkey::VARCHAR || '|HRB ' || s_suppkey::VARCHAR AS ids, 'Weg 1' AS street, '50667' AS postcode, 'Köln' AS city, 'A B — GF' AS officers, '2018-11-09' AS as_of, CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'ceased' ELSE 'unknown' END AS status, 'Köln' AS court FROM supplier WHERE s_suppkey % 6 > 0")
def german_bulk_mapping(spark: SparkSession, d: str) -> DataFrame:
    sql = f"""concat('{{{{"name":"', s_name, '","registered_address":"Weg 1, 50667 Köln.","current_status":"', CASE s_suppkey % 3 WHEN 0 THEN 'currently registered' WHEN 1 THEN 'removed' ELSE '' END, '","retrieved_at":"2018-11-09T18:03:03Z","officers":[{{{{"name":"A B","position":"GF"}}}}],"all_attributes":{{{{"registered_office":"Köln"',
      CASE WHEN s_suppkey % 6 > 0 THEN concat(',"native_company_number":"Köln HRB ', {K}, '"') ELSE '' END, '}}}}}}}}')"""
    r = registers.german_bulk(_payload(spark, d, sql))
    return r.select("id", _flat("ids"), "street", "postcode", "city", _flat("officers"), "as_of", "status", F.element_at("national", F.lit("court")).alias("court"))


@_query("SELECT s_suppkey::VARCHAR AS id, 'Tallinn|Harju maakond' AS localities, CASE s_suppkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'ceased' WHEN 2 THEN 'ceased' ELSE 'unknown' END AS status, '2003-02-01' AS date_created, s_suppkey::VARCHAR || CASE WHEN s_suppkey % 2 = 0 THEN '|EE1' ELSE '' END AS ids FROM supplier")
def estonian_bulk_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = _base(
        spark, d, f"""SELECT s_name AS nimi, {K} AS ariregistri_kood, 'Tallinn, x, Harju maakond' AS asukoha_ehak_tekstina, '' AS ads_normaliseeritud_taisaadress, 'A 1' AS ettevotja_aadress, '' AS asukoht_ettevotja_aadressis, '' AS indeks_ettevotja_aadressis, CASE WHEN s_suppkey % 2 = 0 THEN 'EE1' ELSE '' END AS kmkr_nr,
        CASE s_suppkey % 4 WHEN 0 THEN 'r' WHEN 1 THEN 'L' WHEN 2 THEN 'N' ELSE '' END AS ettevotja_staatus, '' AS ettevotja_oiguslik_vorm, '01.02.2003' AS ettevotja_esmakande_kpv FROM {{supplier}}""", "supplier"
    )
    return registers.estonian_bulk(rows).select("id", _flat("localities"), "status", "date_created", _flat("ids"))


LINES = ["54 QUAI CHARLES PASQUA 92300 LEVALLOIS-PERRET", "12B RUE DU MIDI 94300 VINCENNES", "LES HALLES 75001 PARIS 1", "no code here"]


@_query(
    f"""SELECT c_custkey, {_case("c_custkey", ["54", "12B", "", ""])} AS number, {_case("c_custkey", ["QUAI", "RUE", "", ""])} AS kind, {_case("c_custkey", ["CHARLES PASQUA", "DU MIDI", "LES HALLES", ""])} AS street, {_case("c_custkey", ["92300", "94300", "75001", ""])} AS postcode, {_case("c_custkey", ["LEVALLOIS-PERRET", "VINCENNES", "PARIS 1", ""])} AS city FROM customer"""
)
def address_lines(spark: SparkSession, d: str) -> DataFrame:
    c = _base(spark, d, f"SELECT c_custkey, {_case('c_custkey', LINES)} AS line FROM {{customer}}", "customer").withColumn("a", registers.raw_address(F.col("line")))
    return c.select("c_custkey", *[F.coalesce(f"a.{k}", F.lit("")).alias(k) for k in ("number", "kind", "street", "postcode", "city")])


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'Amtsgericht Köln' END AS court, CASE c_custkey % 3 WHEN 0 THEN 'HRB' WHEN 1 THEN 'GnR' END AS kind, CASE c_custkey % 3 WHEN 0 THEN c_custkey::VARCHAR || ' B' WHEN 1 THEN c_custkey::VARCHAR END AS number FROM customer")
def native_numbers(spark: SparkSession, d: str) -> DataFrame:
    c = _base(spark, d, "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('Amtsgericht Köln HRB ', CAST(c_custkey AS STRING), ' B') WHEN 1 THEN concat('Amtsgericht Köln GnR ', CAST(c_custkey AS STRING)) ELSE 'HRB' END AS n FROM {customer}", "customer")
    return c.select("c_custkey", registers.split_native(F.col("n")).alias("s")).select("c_custkey", "s.court", "s.kind", "s.number")


@_query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN (c_custkey)::BIGINT WHEN 1 THEN c_custkey * 1000 WHEN 2 THEN c_custkey * 1000 + 500 END AS metres, CASE WHEN c_custkey % 2 = 0 THEN 48.5 END::DOUBLE AS south, least(500, greatest(1, c_custkey))::BIGINT AS clamped FROM customer WHERE c_custkey > 0")
def given_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Distances, boxes and whole numbers as people write them."""
    c = _base(spark, d, "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 1 THEN concat(CAST(c_custkey AS STRING), ' km') WHEN 2 THEN concat(CAST(c_custkey AS STRING), ',5km') WHEN 3 THEN '-3' ELSE 'far' END AS dist, CASE WHEN c_custkey % 2 = 0 THEN '48.5, 2.1, 49, 2.6' ELSE '49,2,48,3' END AS box, concat(CAST(c_custkey AS STRING), 'x') AS n FROM {customer} WHERE c_custkey > 0", "customer")
    return c.select("c_custkey", text.parse_distance_m(F.col("dist")).alias("metres"), F.get(text.parse_bbox(F.col("box")), F.lit(0)).alias("south"), text.clamp_int(F.col("n"), 1, 500, 7).alias("clamped"))


@_query("SELECT c_custkey, 'osm_n' || c_custkey::VARCHAR || '_x' AS file_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'a, b' END AS label, CASE WHEN c_nationkey % 2 = 0 THEN 3600000000 + c_custkey END AS area FROM customer")
def short_forms(spark: SparkSession, d: str) -> DataFrame:
    c = _base(spark, d, "SELECT c_custkey, concat('osm:n', CAST(c_custkey AS STRING), '/x') AS id, CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, ', Paris, France') ELSE 'a, b' END AS label, CASE WHEN c_nationkey % 2 = 0 THEN 'relation' ELSE 'way' END AS t FROM {customer}", "customer")
    return c.select("c_custkey", text.file_safe(F.col("id")).alias("file_id"), text.short_label(F.col("label")).alias("label"), poi.area_id(F.col("t"), F.col("c_custkey")).alias("area"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN floor(o_totalprice + 0.5) >= 1000 THEN format('{:,}', floor(o_totalprice + 0.5)::BIGINT) ELSE floor(o_totalprice + 0.5)::BIGINT::VARCHAR END WHEN o_orderkey % 4 = 1 THEN '€' || format('{:,}', floor(o_totalprice + 0.5)::BIGINT) WHEN o_orderkey % 4 = 2 THEN 'NOK ' || format('{:,}', floor(o_totalprice + 0.5)::BIGINT) ELSE '-$' || format('{:,}', floor(o_totalprice + 0.5)::BIGINT) END AS said FROM orders")
def money_lines(spark: SparkSession, d: str) -> DataFrame:
    o = _base(spark, d, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN -o_totalprice ELSE o_totalprice END AS n, CASE o_orderkey % 4 WHEN 1 THEN 'EUR' WHEN 2 THEN 'nok' WHEN 3 THEN 'USD' END AS cur FROM {orders}", "orders")
    return o.select("o_orderkey", text.money(F.col("n"), F.col("cur")).alias("said"))


# boards, sitemaps, targets ---------------------------------------------------------------------------------------------

BOARD = """SELECT s_suppkey AS k, CASE s_suppkey % 8 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'recruitee' WHEN 4 THEN 'workable' WHEN 5 THEN 'teamtailor' WHEN 6 THEN 'smartrecruiters' ELSE 'personio' END AS provider, concat('t', CAST(s_suppkey AS STRING)) AS token,
  CASE s_suppkey % 8 WHEN 0 THEN '{{"jobs":[{{"title":"Dev","absolute_url":"u","location":{{"name":"Paris"}},"updated_at":"2024"}}]}}' WHEN 1 THEN '[{{"text":"Dev","applyUrl":"u","categories":{{"location":"Paris"}},"createdAt":1700000000000}}]'
  WHEN 2 THEN '{{"jobs":[{{"title":"Dev","jobUrl":"u","location":"Paris","publishedAt":"2024"}}]}}' WHEN 3 THEN '{{"offers":[{{"title":"Dev","careers_url":"u","city":"Paris","published_at":"2024"}}]}}' WHEN 4 THEN '{{"jobs":[{{"title":"Dev","url":"u","city":"Paris","country":"FR","published_on":"2024"}}]}}'
  WHEN 5 THEN '{{"jobs":[{{"title":"Dev","url":"u","location":"Paris"}},{{"url":"u","location":"Paris"}}]}}' WHEN 6 THEN '{{"content":[{{"id":"7","name":"Dev","company":{{"identifier":"C"}},"location":{{"city":"Paris"}},"releasedDate":"2024"}}]}}'
  ELSE '<position><id>3</id><jobDescriptions><name>no</name></jobDescriptions><name><![CDATA[Dev]]></name><office>Paris</office><createdAt>2024</createdAt></position>' END AS payload FROM {supplier}"""


@_query(
    """SELECT token, title, CASE s_suppkey % 8 WHEN 6 THEN 'https://jobs.smartrecruiters.com/C/7' WHEN 7 THEN 'https://t' || s_suppkey::VARCHAR || '.jobs.personio.de/job/3' ELSE 'u' END AS url, CASE WHEN s_suppkey % 8 = 4 THEN 'Paris, FR' ELSE 'Paris' END AS location, CASE s_suppkey % 8 WHEN 1 THEN '2023-11-14T22:13:20.000Z' WHEN 5 THEN NULL ELSE '2024' END AS posted_at
FROM (SELECT s_suppkey, 't' || s_suppkey::VARCHAR AS token, unnest(CASE WHEN s_suppkey % 8 = 5 THEN ['Dev', '(untitled)'] ELSE ['Dev'] END) AS title FROM supplier)"""
)
def board_postings(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of eight providers to one posting shape."""
    return boards.postings(_base(spark, d, BOARD, "supplier")).select("token", "title", "url", "location", "posted_at")


@_query("SELECT user_id AS place_id, min(event_id) AS ord FROM events GROUP BY user_id, lower(event_type), floor(value)::BIGINT % 3")
def job_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One posting per place, title and location; the same opening in other letters is the same."""
    e = _base(spark, d, "SELECT user_id AS place_id, event_id AS ord, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS title, nullif(CAST(CAST(floor(value) AS BIGINT) % 3 AS STRING), '0') AS location FROM {events}", "events")
    return boards.one_of_each(e).select("place_id", "ord")


@_query("SELECT user_id AS place_id, CASE WHEN event_id % 2 = 0 THEN 'lever' ELSE 'ashby' END AS provider, event_type AS token, min(event_id) AS ord FROM events GROUP BY 1, 2, 3")
def board_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Boards of all pages of a place, each once."""
    e = _base(spark, d, "SELECT user_id AS place_id, event_id AS ord, CASE WHEN event_id % 2 = 0 THEN 'lever' ELSE 'ashby' END AS provider, event_type AS token FROM {events}", "events")
    return boards.boards_of_place(e).select("place_id", "provider", "token", "ord")


@_query("SELECT page_id % 11 AS site, 2 * count(*) AS urls, max('2024-0' || (page_id % 9 + 1)::VARCHAR || '-01') AS last_content_at FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id % 11 ORDER BY page_id) AS rn FROM pages) WHERE rn <= 3 AND page_id % 5 > 0 GROUP BY 1")
def sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """Pages and newest date of the first three files of a site; index files hold no pages."""
    f = _base(spark, d, """SELECT page_id % 11 AS site, page_id AS ord, CASE WHEN page_id % 5 = 0 THEN '<sitemapindex><sitemap><loc>s</loc></sitemap></sitemapindex>' ELSE concat('<urlset><url><loc>a</loc><lastmod>2024-0', CAST(page_id % 9 + 1 AS STRING), '-01</lastmod></url><url><loc>b</loc></url></urlset>') END AS body FROM {pages}""", "pages")
    return boards.sitemap_summary(boards.sitemap_entries(f)).select("site", "urls", "last_content_at")


@_query(
    """SELECT n_name AS query, n_nationkey % 5 < 2 OR n_nationkey % 5 = 4 AS ok, CASE n_nationkey % 5 WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'no result' END AS reason, CASE n_nationkey % 5 WHEN 0 THEN n_name || ' 1' WHEN 1 THEN n_name || ' 2' WHEN 4 THEN n_name || ' 1' END AS label,
CASE WHEN n_nationkey % 5 = 0 THEN 48.0 WHEN n_nationkey % 5 = 1 THEN 48.0 WHEN n_nationkey % 5 = 4 THEN 47.99 END::DOUBLE AS south, CASE WHEN n_nationkey % 5 IN (0, 4) THEN 'C' || n_nationkey::VARCHAR END AS commune, CASE WHEN n_nationkey % 5 IN (0, 4) THEN '75' || n_nationkey::VARCHAR WHEN n_nationkey % 5 = 1 THEN NULL END AS postcode FROM nation"""
)
def geocoded(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers: unambiguous, picked, ambiguous, none, and one without a box; French ones with their commune."""
    g = _base(
        spark, d, """SELECT n_name AS query, ord, concat(n_name, ' ', CAST(ord AS STRING)) AS label, 48.0D + (CASE WHEN ord = 2 THEN 1 ELSE 0 END) AS lat, 2.0D AS lon, CASE WHEN ord = 1 THEN 0.5D WHEN n_nationkey % 5 IN (1, 2) THEN 0.49D ELSE 0.1D END AS importance,
        CASE WHEN n_nationkey % 5 < 4 THEN array('48.0', '48.1', '2.0', '2.1') ELSE array('x') END AS bbox, CASE WHEN n_nationkey % 5 IN (0, 4) THEN 'FR' ELSE 'de' END AS country, 'relation' AS osm_type, 7L AS osm_id, CAST(NULL AS STRING) AS postcode FROM {nation} LATERAL VIEW explode(array(1, 2)) t AS ord WHERE n_nationkey % 5 <> 3""", "nation"
    )
    q = _base(spark, d, "SELECT concat(n_name, ' ') AS query, CASE WHEN n_nationkey % 5 = 1 THEN 2 END AS pick FROM {nation}", "nation")
    c = _base(spark, d, "SELECT n_name AS query, concat('C', CAST(n_nationkey AS STRING)) AS citycode, concat('75', CAST(n_nationkey AS STRING)) AS postcode FROM {nation}", "nation")
    return places.geocode(q, g, c).select("query", "ok", "reason", "label", "south", "commune", "postcode")


@_query(
    """SELECT s_suppkey AS source, CASE WHEN s_suppkey % 7 = 0 THEN 'unreadable' WHEN s_suppkey % 4 > 0 AND s_suppkey % 3 = 0 THEN 'stale' WHEN s_suppkey % 5 = 0 THEN 'other tool' ELSE 'fresh' END AS state FROM supplier"""
)
def snapshot_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Cached exports against what upstream has now; some are not there any more."""
    c = _base(spark, d, f"SELECT s_suppkey AS source, concat('2024-0', CAST(s_suppkey % 3 + 1 AS STRING), '-15') AS modified, CASE WHEN s_suppkey % 5 = 0 THEN '0' ELSE '1' END AS tool, CASE WHEN s_suppkey % 7 = 0 THEN {bulk.LAYOUT - 1} ELSE {bulk.LAYOUT} END AS layout FROM {{supplier}}", "supplier")
    u = _base(spark, d, "SELECT s_suppkey AS source, '2024-02-01' AS modified FROM {supplier} WHERE s_suppkey % 4 > 0", "supplier")
    return bulk.freshness(c, u, "1")


@_query("SELECT c_custkey FROM customer WHERE c_custkey % 6 > 0 AND c_custkey % 7 IN (2, 3)")
def client_filter(spark: SparkSession, d: str) -> DataFrame:
    """What a point search is filtered by afterwards: status and headcount bands."""
    c = _base(spark, d, "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'ceased' ELSE 'active' END AS status, CASE c_custkey % 7 WHEN 2 THEN '11' WHEN 3 THEN '12' WHEN 4 THEN '00' END AS band FROM {customer}", "customer")
    return c.where(bulk.client_filter(F.col("status"), F.col("band"), bands=["11", "12"], around_point=True)).select("c_custkey")


SAID = ["Dispatcher_Client::request_read_and_idx::timeout", "HTTP 504", "HTTP 429", "fetch failed", "ETIMEDOUT", "rate limit", "Query timed out in 90 seconds", "out of memory", "timeout", "The server is probably too busy"]


@_query("SELECT event_id AS k, CASE WHEN event_id % 10 IN (6, 7) THEN 'too-big' WHEN event_id % 10 = 8 THEN 'other' ELSE 'busy' END AS class FROM events")
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    """What instances said inside longer messages."""
    e = _base(spark, d, f"SELECT event_id AS k, concat('attempt ', CAST(event_id AS STRING), ': ', {_case('event_id', SAID)}, ' (', event_type, ')') AS m FROM {{events}}", "events")
    return e.select("k", poi.failure_class(F.col("m")).alias("class"))


@_query(
    """SELECT 'n' || s_suppkey::VARCHAR AS poi_id, CASE WHEN s_suppkey % 2 = 0 THEN 'shop=bakery' ELSE 'tourism=hotel' END AS category FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 20 < 10 AND s_suppkey % 7 IN (0, 6)"""
)
def poi_scan(spark: SparkSession, d: str) -> DataFrame:
    """Businesses inside a box across the date line: whole keys, listed values, neither; coordinates of nodes and of centres."""
    e = _base(
        spark, d, """SELECT 'node' AS type, s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN lat END AS lat, CASE WHEN s_suppkey % 2 = 0 THEN lon END AS lon, CASE WHEN s_suppkey % 2 = 1 THEN named_struct('lat', lat, 'lon', lon) END AS center,
        map(CASE WHEN s_suppkey % 3 = 0 THEN 'tourism' WHEN s_suppkey % 2 = 0 THEN 'shop' ELSE 'tourism' END, CASE WHEN s_suppkey % 3 = 0 THEN 'viewpoint' WHEN s_suppkey % 2 = 0 THEN 'bakery' ELSE 'hotel' END) AS tags
        FROM (SELECT s_suppkey, CAST(s_suppkey % 20 AS DOUBLE) AS lat, CASE s_suppkey % 7 WHEN 0 THEN 179.5D WHEN 6 THEN -179.5D ELSE 10.0D * (s_suppkey % 7) END AS lon FROM {supplier})""", "supplier"
    )
    p = poi.to_pois(poi.within(e.where(poi.business_filter(F.col("tags"))), 0.0, 9.5, 179.0, -179.0))
    return p.select("poi_id", poi.category(F.col("tags")).alias("category"))


# pages -----------------------------------------------------------------------------------------------------------------

LINKED = """concat('<a href="/a#x">1</a><a class="b" href="', CAST(page_id AS STRING), '.html">2</a><a href="https://other.example/">3</a><a href="mailto:x@y.fr">4</a><a href="../up">5</a><a href="//acme.example/p">6</a><a href="/a">7</a>')"""


@_query(
    """SELECT page_id, link FROM (SELECT page_id, unnest(['https://acme.example/a', 'https://acme.example/d/' || page_id::VARCHAR || '.html', 'https://acme.example/up', 'https://acme.example/p']) AS link FROM pages)"""
)
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Relative, parent and scheme-less links of a page, its own origin only, each once."""
    p = _base(spark, d, f"SELECT page_id, {LINKED} AS h FROM {{pages}}", "pages")
    return p.select("page_id", F.explode(extract.same_origin_links(F.col("h"), F.lit("https://acme.example/d/index.html"))).alias("link"))


@_query(
    """SELECT page_id, 'R' || page_id::VARCHAR || ' & <b> é € A ☃ &unknown; x' || chr(10) || 'next' AS body_text, 'Accept all cookies' || chr(10) || 'Welcome ' || page_id::VARCHAR AS raw, 'Welcome ' || page_id::VARCHAR AS plain FROM pages"""
)
def decoded_text(spark: SparkSession, d: str) -> DataFrame:
    """Entities by name and number, scripts and comments out, lines at block ends; consent lines dropped."""
    p = _base(spark, d, "SELECT page_id, concat('<!-- no --><p>R', CAST(page_id AS STRING), ' &amp; &lt;b&gt; &eacute; &euro; &#65; &#x2603; &unknown; <b>x</b></p><script>no</script><div>next</div>') AS h, concat('Accept all cookies\\nWelcome ', CAST(page_id AS STRING)) AS raw FROM {pages}", "pages")
    return p.select("page_id", extract.html_to_text(F.col("h")).alias("body_text"), "raw", extract.without_consent_lines(F.col("raw")).alias("plain"))


@_query("SELECT page_id, 'main ' || page_id::VARCHAR || ' inner more' AS main_text FROM pages")
def main_text(spark: SparkSession, d: str) -> DataFrame:
    """The main block of a page, blocks nested in it included."""
    p = _base(spark, d, "SELECT page_id, concat('<body><nav>menu menu menu</nav><main>main ', CAST(page_id AS STRING), ' <main>inner</main> more</main><footer>foot</footer></body>') AS h FROM {pages}", "pages")
    p = content.with_main(p, "h", content.LARGEST, "m")
    return p.select("page_id", F.regexp_replace(extract.html_to_text(F.col("m")), r"\s+", " ").alias("main_text"))


@_query("SELECT page_id, 'schema:Restaurant|schema:Person|schema:Org' AS types FROM pages")
def json_ld(spark: SparkSession, d: str) -> DataFrame:
    """Types of single objects, graphs and lists; broken blocks are skipped."""
    h = """concat('<script type="application/ld+json">{{"@type":"Restaurant","n":', CAST(page_id AS STRING), '}}</script><script type="application/ld+json">{{"@graph":[{{"@type":"Person"}}]}}</script><script type="application/ld+json">[{{"@type":"Org"}}]</script><script type="application/ld+json">broken{{</script>')"""
    p = _base(spark, d, f"SELECT page_id, {h} AS h FROM {{pages}}", "pages")
    return p.select("page_id", F.array_join(extract.technology(F.col("h"))["tech_stack"], "|").alias("types"))


CMS_MARKS = ['wp-content/x', 'cdn.shopify.com', 'static.wixstatic.com', 'squarespace.com', 'assets.website-files.com', 'sites/all/modules', 'generator" content="Joomla', 'generator" content="PrestaShop', 'Magento_x', 'hs-scripts.com', 'framerusercontent.com', 'web/static/src', '/_next/static/', '/_nuxt/']
CMS_NAMES = ["WordPress", "Shopify", "Wix", "Squarespace", "Webflow", "Drupal", "Joomla", "PrestaShop", "Magento", "HubSpot CMS", "Framer", "Odoo", "Next.js", "Nuxt"]


@_query(f"SELECT page_id, {_case('page_id', CMS_NAMES)} AS cms FROM pages")
def content_systems(spark: SparkSession, d: str) -> DataFrame:
    """Every content system by its mark."""
    p = _base(spark, d, f"SELECT page_id, {_case('page_id', CMS_MARKS)} AS h FROM {{pages}}", "pages")
    return p.select("page_id", extract.technology(F.col("h"))["cms"].alias("cms"))


BOARD_URLS = ["boards.greenhouse.io/embed/job_board?for=acme", "jobs.eu.lever.co/acme", "jobs.ashbyhq.com/acme", "https://acme.recruitee.com", "https://acme.teamtailor.com", "apply.workable.com/acme", "welcometothejungle.com/fr/companies/acme", "https://acme.jobs.personio.de", "careers.smartrecruiters.com/acme", "https://acme.softgarden.io", "join.com/companies/acme", "jobs.lever.co/embed"]
BOARD_NAMES = ["greenhouse", "lever", "ashby", "recruitee", "teamtailor", "workable", "welcometothejungle", "personio", "smartrecruiters", "softgarden", "join"]


@_query(f"SELECT page_id, {_case('page_id % 12', BOARD_NAMES + [''])} AS provider, 'acme' AS token FROM pages WHERE page_id % 12 < 11")
def board_links(spark: SparkSession, d: str) -> DataFrame:
    """Every provider by the links it leaves; path words that are no account do not count."""
    p = _base(spark, d, f"SELECT page_id, concat('<a href=\"', {_case('page_id % 12', BOARD_URLS)}, '\">') AS h FROM {{pages}}", "pages")
    return p.select("page_id", F.explode(extract.job_boards(F.col("h"))).alias("b")).select("page_id", "b.provider", "b.token")


VATS = dict(at="ATU12345678", be="BE0123456789", bg="BG123456789", cy="CY12345678X", cz="CZ12345678", de="DE123456789", dk="DK12345678", ee="EE123456789", gr="EL123456789", es="ESX1234567X", fi="FI12345678", hr="HR12345678901", hu="HU12345678", ie="IE1A23456A", it="IT12345678901", lu="LU12345678", lv="LV12345678901", mt="MT12345678", nl="NL123456789B01", pl="PL1234567890", pt="PT123456789", se="SE123456789012", si="SI12345678", sk="SK1234567890")
VAT_TEXT = [f"VAT {v[:4]} {v[4:7]}.{v[7:]} (ok)" for v in VATS.values()]


@_query(f"SELECT page_id, {_case('page_id', list(VATS))} AS country, {_case('page_id', list(VATS.values()))} AS value FROM pages")
def vat_numbers(spark: SparkSession, d: str) -> DataFrame:
    """VAT numbers of 24 countries, written with separators."""
    p = _base(spark, d, f"SELECT page_id, {_case('page_id', VAT_TEXT)} AS t FROM {{pages}}", "pages")
    found = p.select("page_id", F.explode(extract.vat_numbers(F.col("t"))).alias("v")).select("page_id", "v.country", "v.value")
    return found.where(F.col("country") == F.element_at(F.array(*map(F.lit, VATS)), (F.col("page_id") % len(VATS) + 1).cast("int")))


NOTICES = ["Registered in England no. 01234567", "Company Reg. No: SC123456", "C.I.F. B12345678", "SIRET 302 474 648 00017", "HRA 12 Amtsgericht Bad Homburg", "nothing"]


@_query(
    f"""SELECT page_id, {_case("page_id", ["company-number", "company-number", "nif", "siret", "hrb", ""])} AS kind, {_case("page_id", ["01234567", "SC123456", "B12345678", "30247464800017", "HRA 12", ""])} AS value, CASE WHEN page_id % 6 = 4 THEN 'Bad Homburg' ELSE '' END AS context FROM pages WHERE page_id % 6 < 5"""
)
def national_ids(spark: SparkSession, d: str) -> DataFrame:
    """Register numbers by country, with the court of German ones."""
    p = _base(spark, d, f"SELECT page_id, {_case('page_id', NOTICES)} AS t, CASE WHEN page_id % 6 < 2 THEN 'gb' END AS cc FROM {{pages}}", "pages")
    return p.select("page_id", F.explode(extract.legal_ids(F.col("t"), F.col("cc"))).alias("l")).select("page_id", "l.kind", "l.value", F.coalesce("l.context", F.lit("")).alias("context"))


@_query(r"""SELECT doc_id, lower(m) AS term, trim(regexp_replace(substr(text, greatest(1, pos - 90), pos + len(m) + 90 - greatest(1, pos - 90)), '\s+', ' ', 'g')) AS note
FROM (SELECT doc_id, text, regexp_extract(text, '(?i)(^|[^\p{L}])(thing\p{L}{0,3})(?:[^\p{L}]|$)', 2) AS m, len(regexp_extract(text, '(?is)^(.*?(?:^|[^\p{L}]))thing\p{L}{0,3}(?:[^\p{L}]|$)', 1)) + 1 AS pos FROM documents) WHERE m <> ''""")
def term_context(spark: SparkSession, d: str) -> DataFrame:
    """The first mention of a term with up to 90 characters before and after it."""
    m = F.get(extract.term_mentions(F.col("text"), ["thing"]), F.lit(0))
    return _table(spark, d, "documents").select("doc_id", m.alias("m")).where("m is not null").select("doc_id", F.lower("m.value").alias("term"), "m.note")


@_query("SELECT page_id, 'mailto: a' || page_id::VARCHAR || '@x.fr' || chr(10) || 'tel: +33123456789' || chr(10) || 'social: https://www.linkedin.com/company/c' AS block FROM pages")
def evidence_block(spark: SparkSession, d: str) -> DataFrame:
    p = _base(spark, d, """SELECT page_id, concat('<a href="mailto:A', CAST(page_id AS STRING), '@x.fr"><a href="tel:+33 1 23 45 67 89"><a href="https://www.linkedin.com/company/c">') AS h FROM {pages}""", "pages")
    return p.select("page_id", extract.markup_evidence(F.col("h")).alias("block"))


@_query(
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Map Lyon|Trade Lyon|"123"' WHEN 1 THEN 'Legal|Legal mentions légales' ELSE 'Map Lyon|Trade Lyon|Legal Lyon' END AS queries, CASE WHEN s_suppkey % 2 = 0 THEN 'fr-FR' ELSE 'de-AT' END AS locale FROM supplier"""
)
def search_plans(spark: SparkSession, d: str) -> DataFrame:
    s = _base(spark, d, "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 1 THEN 'Map' END AS m, CASE WHEN s_suppkey % 3 <> 1 THEN 'Trade' END AS t, CASE WHEN s_suppkey % 3 = 0 THEN 'Trade (x)' ELSE 'Legal (Old)' END AS l, CASE WHEN s_suppkey % 3 <> 1 THEN 'Lyon' END AS town, CASE WHEN s_suppkey % 3 = 0 THEN '123' END AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'FR' ELSE 'at' END AS cc FROM {supplier}", "supplier")
    q = resolve.search_queries(F.col("m"), F.col("t"), F.col("l"), F.col("town"), F.col("id"), F.lit("fr"))
    return s.select("s_suppkey", F.array_join(q, "|").alias("queries"), resolve.search_locale(F.col("cc")).alias("locale"))


@_query("SELECT n_nationkey, n_nationkey % 3 = 0 AS expected, CASE n_nationkey % 3 WHEN 0 THEN 'fr: sites must publish a registration number' WHEN 1 THEN 'us: no federal register and no published company number; identity rests on address and name' ELSE 'this country: no registration number is expected on sites' END AS note FROM nation")
def id_coverage(spark: SparkSession, d: str) -> DataFrame:
    n = _base(spark, d, "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'us' END AS cc FROM {nation}", "nation")
    return n.select("n_nationkey", extract.legal_id_coverage(F.col("cc")).alias("c")).select("n_nationkey", "c.expected", "c.note")


@_query("SELECT page_id, host FROM (SELECT page_id, unnest([page_id % 7]) AS host FROM pages)")
def long_host_hits(spark: SparkSession, d: str) -> DataFrame:
    """A name of more than thirty letters is found in a host."""
    word = lambda c: f"concat(repeat(translate(CAST({c} AS STRING), '0123456', 'abcdefg'), 3), 'internationaleverwaltungsgesellschaft')"
    hits = _base(spark, d, f"SELECT concat('https://www.', {word('page_id % 7')}, '.example/', CAST(page_id AS STRING)) AS url, '' AS title, '' AS snippet, CAST(NULL AS BIGINT) AS tag FROM {{pages}}", "pages")
    names = _base(spark, d, f"SELECT DISTINCT page_id % 7 AS place_id, {word('page_id % 7')} AS name FROM {{pages}}", "pages")
    return resolve.attribute_hits(hits, names).select(F.regexp_extract("url", r"/(\d+)$", 1).cast("long").alias("page_id"), F.col("place_id").alias("host"))


# confirmation, gate, spatial -------------------------------------------------------------------------------------------


@_query(
    """SELECT count(*) FILTER (r = 0) AS verified, count(*) FILTER (r = 1) AS matched, count(*) FILTER (r = 2) AS undecided, count(*) FILTER (r = 3 AND c_nationkey % 2 = 0) AS not_found, count(*) FILTER (r = 3 AND c_nationkey % 2 = 1) AS not_asked FROM (SELECT c_custkey % 4 AS r, c_nationkey FROM customer)"""
)
def confirm_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The account of a confirm pass."""
    c = _base(spark, d, "SELECT c_custkey AS place_id, c_custkey % 4 AS r, c_nationkey FROM {customer}", "customer")
    ids = c.where("r = 0").select("place_id", F.lit(True).alias("attached"))
    names = c.where("r in (1, 2)").select("place_id", F.when(F.col("r") == 1, "merge").otherwise("undecided").alias("band"))
    return confirm.outcomes(c, ids, names, c.where("c_nationkey % 2 = 0"))


@_query("SELECT c_custkey AS place_id, CASE c_custkey % 3 WHEN 0 THEN 'a2' WHEN 1 THEN 'b1' ELSE 'a1' END AS rec_key, CASE c_custkey % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'merge' ELSE 'undecided' END AS band FROM customer")
def connector_order(spark: SparkSession, d: str) -> DataFrame:
    """The first connector that merges wins over a better hit of a later one; without a merge the best hit stays undecided."""
    hits = _base(
        spark, d, """SELECT c_custkey AS place_id, h.connector_ord, h.rec_key, CASE WHEN c_custkey % 3 = 2 THEN h.similarity - 0.5D WHEN c_custkey % 3 = 1 AND h.connector_ord = 0 THEN h.similarity - 0.4D ELSE h.similarity END AS similarity, CAST(NULL AS STRING) AS postcode_r
        FROM {customer} LATERAL VIEW explode(array(named_struct('connector_ord', 0, 'rec_key', 'a1', 'similarity', CASE WHEN c_custkey % 3 = 2 THEN 1.15D ELSE 0.7D END), named_struct('connector_ord', 0, 'rec_key', 'a2', 'similarity', 0.8D), named_struct('connector_ord', 1, 'rec_key', 'b1', 'similarity', 0.99D))) t AS h""", "customer"
    )
    places_ = _base(spark, d, "SELECT c_custkey AS place_id, CAST(NULL AS STRING) AS postcode FROM {customer}", "customer")
    return confirm.by_name(hits, places_).select("place_id", "rec_key", "band")


@_query("SELECT s_suppkey, s_suppkey % 4 IN (0, 1) AS same FROM supplier")
def court_names(spark: SparkSession, d: str) -> DataFrame:
    s = _base(spark, d, "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Charlottenburg' WHEN 1 THEN 'KÖLN' WHEN 2 THEN 'Bonn' ELSE '' END AS a, CASE s_suppkey % 4 WHEN 0 THEN 'Berlin (Charlottenburg)' ELSE 'Köln' END AS b FROM {supplier}", "supplier")
    return s.select("s_suppkey", confirm.court_match(F.col("a"), F.col("b")).alias("same"))


@_query("SELECT c_custkey AS place_id FROM customer WHERE c_custkey % 4 IN (1, 2)")
def to_confirm(spark: SparkSession, d: str) -> DataFrame:
    c = _base(spark, d, "SELECT c_custkey AS place_id, c_custkey AS ord, CASE c_custkey % 4 WHEN 0 THEN 'r' END AS rec_key, CASE c_custkey % 4 WHEN 3 THEN ' ' ELSE c_name END AS name, c_custkey % 2 AS page_count FROM {customer}", "customer")
    return confirm.needs_confirming(c).select("place_id")


@_query("SELECT c_custkey AS place_id, 'registry-evidence-unbacked' AS rule FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'dossier-orphan' FROM customer WHERE c_custkey % 5 = 0")
def gate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Register evidence that no verified number backs, and dossiers of no place."""
    c = _base(spark, d, "SELECT c_custkey AS place_id, CASE WHEN c_custkey % 3 > 0 THEN 'X' END AS legal_id, CASE WHEN c_custkey % 2 = 0 THEN 'unverified' ELSE 'verified' END AS status FROM {customer}", "customer")
    unbacked = gate.registry_evidence(c.select("place_id", "legal_id"), c.select("place_id", F.lit("X").alias("value"), "status")).select("place_id", "rule")
    dossiers = _base(spark, d, "SELECT concat(CASE WHEN c_custkey % 5 = 0 THEN 'lost_' ELSE 'osm_' END, CAST(c_custkey AS STRING)) AS file_id FROM {customer}", "customer")
    own = _base(spark, d, "SELECT concat('osm:', CAST(c_custkey AS STRING)) AS place_id FROM {customer}", "customer")
    lost = gate.orphan_dossiers(dossiers, own).select(F.regexp_extract("place_id", r"(\d+)$", 1).cast("long").alias("place_id"), "rule")
    return unbacked.unionByName(lost)


@_query(f"SELECT 'coverage-enrichment' AS rule, count(*) FILTER (page_count > 0)::VARCHAR || '/' || count(*) FILTER (site_confidence = 'corroborated')::VARCHAR AS subject FROM ({_duck(PLACES)}) HAVING count(*) FILTER (site_confidence = 'corroborated') > count(*) FILTER (page_count > 0) UNION ALL SELECT 'no-dossiers', 'dossiers' UNION ALL SELECT 'run-truncated', 'cap'")
def gate_run_warnings(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d).select("place_id", F.lit("u").alias("site_url"), "site_confidence", F.lit(True).alias("reachable"), (F.col("page_count") > 0).alias("enriched"))
    found = gate.warnings(p, spark.sql("SELECT 'cap' AS reason"), spark.sql("SELECT 'x' AS file_id WHERE false"))
    return found.where("rule in ('coverage-enrichment', 'no-dossiers', 'run-truncated')").select("rule", "subject")


@_query(
    """WITH p AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 179.9995 ELSE -179.9995 END AS lon, s_suppkey % 80 AS lat FROM supplier) SELECT a.k AS poi_ord, b.k AS rec_ord FROM p a JOIN p b ON a.lat = b.lat WHERE a.k <= 200 AND b.k <= 200
 AND (a.lon = b.lon OR 2 * 6371008.8 * asin(sqrt(pow(cos(radians(a.lat)), 2) * pow(sin(radians(0.001) / 2), 2))) <= 150)""".replace("WHERE a.k <= 200 AND b.k <= 200\n AND", "WHERE")
)
def across_the_date_line(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours on both sides of 180 degrees are found."""
    p = _base(spark, d, "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 179.9995D ELSE -179.9995D END AS lon, CAST(s_suppkey % 80 AS DOUBLE) AS lat FROM {supplier}", "supplier")
    a = p.select(F.col("k").alias("poi_ord"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    b = p.select(F.col("k").alias("rec_ord"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return match.spatial_candidates(a, b).select("poi_ord", "rec_ord")


@_query("SELECT r_regionkey AS query, 2 AS ord FROM region WHERE r_regionkey % 2 = 0")
def geocode_rivals(spark: SparkSession, d: str) -> DataFrame:
    c = _base(spark, d, "SELECT r_regionkey AS query, ord, CASE WHEN ord = 1 THEN 0.5D WHEN r_regionkey % 2 = 0 THEN 0.45D ELSE 0.2D END AS importance, 48.0D + ord AS lat, 2.0D AS lon FROM {region} LATERAL VIEW explode(array(1, 2)) t AS ord", "region")
    return sweep.rivals(c).select("query", "ord")


# counts and deliverables -----------------------------------------------------------------------------------------------


@_query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Manufacturing (nace C)' WHEN 1 THEN 'dormant company' WHEN 2 THEN 'shop' ELSE 'unclassified' END AS label FROM part")
def activity_labels(spark: SparkSession, d: str) -> DataFrame:
    p = _base(spark, d, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'nace' ELSE 'none' END AS scheme, CASE p_partkey % 4 WHEN 0 THEN 'C' END AS letter, CASE p_partkey % 4 WHEN 1 THEN 'dormant company' END AS admin, CASE p_partkey % 4 WHEN 2 THEN 'shop=bakery' END AS cat FROM {part}", "part")
    return p.select("p_partkey", summary.activity_label(F.col("scheme"), F.col("letter"), F.col("admin"), F.col("cat")).alias("label"))


@_query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'C|J' ELSE '' END AS valid, CASE WHEN p_partkey % 2 = 0 THEN 'X' ELSE 'C|J|X' END AS unknown, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN 20 ELSE 10 END::BIGINT AS floor FROM part")
def section_checks(spark: SparkSession, d: str) -> DataFrame:
    """Letters of a vocabulary, and the best known headcount."""
    p = _base(spark, d, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'nace' ELSE 'none' END AS scheme, CASE p_partkey % 3 WHEN 0 THEN p_partkey END AS n, CASE p_partkey % 3 WHEN 1 THEN '12' END AS parent FROM {part}", "part")
    k = score.known_sections(F.col("scheme"), F.array(F.lit("c"), F.lit("J"), F.lit("x")))
    return p.select("p_partkey", F.array_join(k["valid"], "|").alias("valid"), F.array_join(k["unknown"], "|").alias("unknown"), score.employee_floor(F.col("n"), F.col("parent"), F.lit("11")).alias("floor"))


@_query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'verified' ELSE 'unverified' END AS status, sum(CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END)::BIGINT AS n FROM customer GROUP BY 1")
def legal_id_counts(spark: SparkSession, d: str) -> DataFrame:
    c = _base(spark, d, "SELECT CASE c_custkey % 3 WHEN 0 THEN array(named_struct('status', 'verified')) WHEN 1 THEN array(named_struct('status', 'unverified'), named_struct('status', 'unverified')) ELSE array(named_struct('status', 'unverified')) END AS legal_ids FROM {customer}", "customer")
    return summary.legal_id_counts(c)


@_query("SELECT 'b' AS lexicon, 'r' AS filter, count(*) FILTER (c_custkey % 4 > 0) AS term_hits, count(*) FILTER (c_custkey % 3 > 0) AS role_hits FROM customer")
def run_brief(spark: SparkSession, d: str) -> DataFrame:
    c = _base(spark, d, "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN array() ELSE array('b') END AS term_lexicon, array('r') AS role_filter, c_custkey % 4 AS term_matches, c_custkey % 3 AS matched_roles FROM {customer}", "customer")
    b = summary.brief(c.withColumn("term_lexicon", F.col("term_lexicon").cast("array<string>")), F.col("c_custkey"))
    return b.select(F.array_join("term_lexicon", "|").alias("lexicon"), F.array_join("role_filter", "|").alias("filter"), "term_hits", "role_hits")


@_query("SELECT l_returnflag AS lane, sum(l_quantity)::BIGINT AS requested, sum(l_linenumber)::BIGINT AS returned, bool_or(l_linenumber > 6) AS truncated FROM lineitem GROUP BY 1")
def lane_totals(spark: SparkSession, d: str) -> DataFrame:
    l = _base(spark, d, "SELECT l_returnflag AS lane, l_quantity AS requested, l_linenumber AS returned, l_linenumber > 6 AS truncated FROM {lineitem}", "lineitem")
    t = summary.lane_totals(l)
    return t.select("lane", F.col("requested").cast("long").alias("requested"), F.col("returned").cast("long").alias("returned"), "truncated")


@_query("SELECT sum(c_custkey % 3)::BIGINT AS officers, sum(c_custkey % 2)::BIGINT AS people, count(*) FILTER (c_custkey % 5 = 0) AS personal_emails FROM customer")
def privacy_tally(spark: SparkSession, d: str) -> DataFrame:
    c = _base(spark, d, "SELECT c_custkey % 3 AS n_officers, c_custkey % 2 AS n_people, CASE WHEN c_custkey % 5 = 0 THEN array('jean.martin@x.fr', 'info@x.fr') ELSE array('contact@x.fr') END AS emails FROM {customer}", "customer")
    return summary.privacy_counts(c)


@_query("SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN (c_custkey % 10)::VARCHAR || ' (' || floor(100.0 * (c_custkey % 10) / c_nationkey + 0.5)::BIGINT::VARCHAR || '%)' ELSE (c_custkey % 10)::VARCHAR END AS said FROM customer")
def shares(spark: SparkSession, d: str) -> DataFrame:
    c = _base(spark, d, "SELECT c_custkey, c_custkey % 10 AS n, c_nationkey AS total FROM {customer}", "customer")
    return c.select("c_custkey", summary.share(F.col("n"), F.col("total")).alias("said"))


@_query(
    """WITH p AS (SELECT s_suppkey AS k, 48.0 + (s_suppkey % 50) * 0.01 AS lat, 2.0 + (s_suppkey % 40) * 0.01 AS lon FROM supplier), e AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e, cos(radians((min(lat) + max(lat)) / 2)) AS k FROM p)
SELECT p.k, round((lon - w) * e.k * least(800 / greatest((e.e - w) * e.k, 1e-9), 600 / greatest(n - s, 1e-9)), 3) AS x, round((n - lat) * least(800 / greatest((e.e - w) * e.k, 1e-9), 600 / greatest(n - s, 1e-9)), 3) AS y FROM p, e"""
)
def map_points(spark: SparkSession, d: str) -> DataFrame:
    """Extent of all places and their points on a canvas."""
    p = _base(spark, d, "SELECT s_suppkey AS k, CAST(48.0D + (s_suppkey % 50) * 0.01D AS DOUBLE) AS lat, CAST(2.0D + (s_suppkey % 40) * 0.01D AS DOUBLE) AS lon, 1 AS total FROM {supplier}", "supplier")
    xy = summary.project(F.col("lat"), F.col("lon"), F.col("south"), F.col("north"), F.col("west"), F.col("east"))
    one = F.broadcast(summary.extent(p))  # one row
    return p.drop("total").join(one, F.lit(True)).select("k", F.round(xy["x"], 3).alias("x"), F.round(xy["y"], 3).alias("y"))


@_query(f"SELECT facet, n FROM (SELECT count(*) AS total, count(*) FILTER (is_hiring) AS h, count(*) FILTER (site_confidence = 'corroborated') AS s, count(*) FILTER (ne > 0 OR np > 0) AS c FROM ({_duck(PLACES)})), (VALUES ('hiring'), ('site'), ('contact'), ('brief')) f(facet), (SELECT count(*) FILTER (matched_roles > 0) AS b FROM ({_duck(PLACES)})) x, LATERAL (SELECT CASE facet WHEN 'hiring' THEN h WHEN 'site' THEN s WHEN 'contact' THEN c ELSE b END AS n) y WHERE n > 0 AND n < total")
def page_facets(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d).withColumn("term_matches", F.lit(0)).withColumn("connector", F.lit(None).cast("string")).withColumn("fit", F.lit("x")).withColumn("as_of", F.lit(None).cast("string"))
    return summary.facets(p)


@_query("SELECT s_suppkey, lower(concat_ws(' ', s_name, s_nationkey::VARCHAR)) AS hay FROM supplier")
def haystacks(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "supplier").select("s_suppkey", summary.haystack("s_name", "s_nationkey").alias("hay"))


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100)::DOUBLE END DESC NULLS LAST, o_orderkey) AS place FROM orders QUALIFY place <= 200")
def table_sort(spark: SparkSession, d: str) -> DataFrame:
    """The head of a table sorted by a column of numbers, "?" and blanks: what is no number comes last."""
    o = _base(spark, d, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat(CAST(o_orderkey % 100 AS STRING), ' roles') WHEN 1 THEN '?' ELSE ' ' END AS cell FROM {orders}", "orders")
    order = [score.table_order(F.col("cell"), numeric=True, descending=True), F.col("o_orderkey")]
    return diff.batches(o, order, 1, 200).select("o_orderkey", (F.col("batch") + 1).alias("place"))


@_query("SELECT c_custkey AS place_id FROM customer WHERE c_custkey % 100 >= 40 AND c_custkey % 4 IN (2, 3)")
def kept_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the flat file from a score and a verdict on."""
    c = _base(spark, d, "SELECT c_custkey AS place_id, c_custkey % 100 AS total, CASE c_custkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'weak' WHEN 2 THEN 'possible' ELSE 'strong' END AS fit FROM {customer}", "customer")
    return score.keep_rows(c, 40, "possible").select("place_id")


@_query("SELECT 2 * count(*) FILTER (c_custkey % 3 = 0) + count(*) FILTER (c_custkey % 2 = 0) AS removed, 0 AS left FROM customer")
def people_removed(spark: SparkSession, d: str) -> DataFrame:
    """People leave before anything is written, and are counted."""
    c = _base(spark, d, "SELECT CASE WHEN c_custkey % 3 = 0 THEN array('a', 'b') ELSE array() END AS officers, CASE WHEN c_custkey % 2 = 0 THEN array('p') ELSE array() END AS people FROM {customer}", "customer")
    clean, removed = render.without_people(c)
    left = clean.agg(F.coalesce(F.sum(F.size("officers") + F.size("people")), F.lit(0)).cast("int").alias("left"))
    return removed.join(F.broadcast(left), F.lit(True))  # one row each


@_query(
    """SELECT s_suppkey AS id, '# ' || s_name || chr(10) || '- id: ' || s_suppkey::VARCHAR || chr(10) || '- address: 1 High St, LEEDS' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '- legal name: L' || chr(10) ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN '- website: https://x.fr' || chr(10) ELSE '- website: none found' || chr(10) END || '- e-mails: a@x.fr; b@x.fr' || chr(10) || '- score: ' || s_nationkey::VARCHAR || chr(10) || '- revenue: €1,234 (2022)' AS sheet FROM supplier"""
)
def fact_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Known facts of a place, one line each."""
    s = _base(spark, d, "SELECT s_suppkey AS id, s_name AS name, '1 High St' AS street, ' ' AS postcode, 'LEEDS' AS city, CASE WHEN s_suppkey % 2 = 0 THEN 'L' END AS legal_name, CASE WHEN s_suppkey % 3 = 0 THEN 'https://x.fr' END AS website, array('a@x.fr', 'b@x.fr') AS emails, s_nationkey AS score, 1234.4D AS revenue, 'EUR' AS revenue_currency, 2022 AS revenue_year FROM {supplier}", "supplier")
    return render.fact_sheet(s)


@_query("SELECT r_regionkey AS k, 'Norwegian company data: Enhetsregisteret, Brønnøysundregistrene, NLOD 2.0' AS licence FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, '© OpenStreetMap contributors, ODbL' FROM region WHERE r_regionkey % 2 = 1")
def lane_licences(spark: SparkSession, d: str) -> DataFrame:
    lanes = _base(spark, d, "SELECT r_regionkey AS k, CASE WHEN r_regionkey % 2 = 0 THEN 'registry' ELSE 'osm' END AS lane, CASE WHEN r_regionkey % 2 = 0 THEN 'no-brreg' END AS connector FROM {region}", "region")
    said = render.licences(lanes)
    key = F.when(F.col("licence").startswith("©"), "osm").otherwise("registry")
    return lanes.join(said.withColumn("lane_", key), F.col("lane") == F.col("lane_")).select("k", "licence")


@_query(
    """SELECT CASE s_suppkey % 4 WHEN 0 THEN 'fr-sirene' WHEN 1 THEN 'us-edgar' WHEN 2 THEN 'cz-ares' ELSE 'new' END || ':' || CASE WHEN s_suppkey % 2 = 0 THEN 'e' || s_suppkey::VARCHAR ELSE s_suppkey::VARCHAR END AS place_id, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey::VARCHAR ELSE s_name END AS name,
CASE WHEN s_suppkey % 3 > 0 THEN CASE s_suppkey % 4 WHEN 0 THEN 'naf=' WHEN 1 THEN 'sic=' WHEN 2 THEN 'cz-nace=' ELSE 'activity=' END || (s_suppkey % 100)::VARCHAR END AS category, 'sweep' AS evidence FROM supplier"""
)
def place_projection(spark: SparkSession, d: str) -> DataFrame:
    """Register records as places: blank names, missing codes, a register without a nomenclature of its own."""
    r = _base(
        spark, d, """SELECT CASE s_suppkey % 4 WHEN 0 THEN 'fr-sirene' WHEN 1 THEN 'us-edgar' WHEN 2 THEN 'cz-ares' ELSE 'new' END AS connector, CAST(s_suppkey AS STRING) AS id, CASE WHEN s_suppkey % 2 = 0 THEN concat('e', CAST(s_suppkey AS STRING)) END AS establishment_id,
        CASE WHEN s_suppkey % 5 = 0 THEN array(' ') ELSE array('', concat(s_name, ' '), 'other') END AS names, CASE s_suppkey % 3 WHEN 0 THEN '' ELSE CAST(s_suppkey % 100 AS STRING) END AS activity_code, '1' AS number, 'x' AS street, 'y' AS postcode, 'z' AS city, 48.0D AS lat, 2.0D AS lon FROM {supplier}""", "supplier"
    )
    return registers.to_places(r).select("place_id", "name", "category", "evidence")


@_query("SELECT 'osm:n' || c_custkey::VARCHAR AS place_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS name, 'shop' AS category, '7' AS number, CASE WHEN c_custkey % 3 = 0 THEN 'http://x.fr' END AS site_url, CASE WHEN c_custkey % 3 = 0 THEN 'declared' END AS site_confidence FROM customer")
def poi_places(spark: SparkSession, d: str) -> DataFrame:
    e = _base(spark, d, "SELECT 'node' AS type, c_custkey AS id, 48.8D AS lat, 2.4D AS lon, CAST(NULL AS STRUCT<lat: DOUBLE, lon: DOUBLE>) AS center, map_filter(map('name', CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'shop', 'yes', 'addr:housenumber', '7', 'website', CASE WHEN c_custkey % 3 = 0 THEN 'http://x.fr' END), (k, v) -> v IS NOT NULL) AS tags FROM {customer}", "customer")
    return poi.to_places(poi.to_pois(e)).select("place_id", "name", "category", "number", "site_url", "site_confidence")


@_query(
    """WITH s AS (SELECT user_id AS place_id, 'https://s.fr' || repeat('/a', (event_id % 3 + 1)::INT) || '/' || event_id::VARCHAR AS url, event_type AS role, event_id AS ord, event_id % 3 AS depth FROM events)
SELECT place_id, role, url FROM (SELECT *, row_number() OVER (PARTITION BY place_id, role ORDER BY depth, ord) AS rn FROM s) WHERE rn = 1"""
)
def best_pages(spark: SparkSession, d: str) -> DataFrame:
    """The shallowest page of each role, the first on ties, over all links."""
    e = _base(spark, d, "SELECT user_id AS place_id, concat('https://s.fr', repeat('/a', CAST(event_id % 3 + 1 AS INT)), '/', CAST(event_id AS STRING)) AS url, event_type AS role, event_id AS ord FROM {events}", "events")
    return resolve.best_by_role(e).select("place_id", "role", "url")


@_query(
    """SELECT tech AS key, count(*) AS n FROM (SELECT unnest(list_concat(CASE WHEN page_id % 2 = 0 THEN ['schema:Org', 'Next.js'] ELSE [] END, CASE page_id % 6 WHEN 0 THEN ['WordPress'] WHEN 1 THEN ['Wix'] ELSE [] END)) AS tech FROM pages) GROUP BY 1"""
)
def technology_tally(spark: SparkSession, d: str) -> DataFrame:
    stack = F.when(F.col("place_id") % 2 == 0, F.array(F.lit("schema:Org"), F.lit("Next.js"))).otherwise(F.array().cast("array<string>"))
    return summary.top_technologies(_places(spark, d).withColumn("tech_stack", stack), F.col("place_id")).select("key", "n")


@_query(
    """SELECT o_custkey AS key, string_agg(DISTINCT lower('T' || (o_orderkey % 5)::VARCHAR), '|' ORDER BY lower('T' || (o_orderkey % 5)::VARCHAR)) FILTER (o_orderkey % 5 >= 2) AS detail FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 5 >= 2) > 0"""
)
def new_roles(spark: SparkSession, d: str) -> DataFrame:
    """Several titles a run: what the later run lists and the earlier did not."""
    o = _base(spark, d, "SELECT o_custkey AS key, o_orderkey % 5 AS r, concat('T', CAST(o_orderkey % 5 AS STRING)) AS title FROM {orders}", "orders")
    rest = lambda g: g.select(F.col("key"), F.lit(0).alias("ord"), F.lit("active").alias("status"), F.lit(True).alias("is_hiring"), "titles", F.lit(None).cast("string").alias("site_url"), F.lit(None).cast("string").alias("site_confidence"), F.lit(None).cast("boolean").alias("reachable"))
    g = o.groupBy("key").agg(F.collect_set(F.when(F.col("r") < 2, F.lower("title"))).alias("old"), F.collect_set("title").alias("new"))
    before, after = rest(g.withColumn("titles", F.col("old"))), rest(g.withColumn("titles", F.col("new")))
    return diff.diff_runs(before, after).where("delta_kind = 'newRoles'").select("key", "detail")


def _lines(spark: SparkSession, said: str, keep) -> DataFrame:
    rows = [(i, line) for i, line in enumerate(x for x in said.split("\n") if keep(x))]
    return spark.createDataFrame(rows, "ord long, line string")


@_query("SELECT s_suppkey AS id, s_name AS name, [s_nationkey::VARCHAR, 'x'] AS listed, s_acctbal AS balance FROM supplier")
def json_export(spark: SparkSession, d: str) -> DataFrame:
    """Places written as JSON lines and read back."""
    where = f"{scratch_dir(spark, 'json')}/places"
    render.write_json(_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.col("s_nationkey").cast("string"), F.lit("x")).alias("listed"), F.col("s_acctbal").cast("double").alias("balance")), where)
    return spark.read.schema("id long, name string, listed array<string>, balance double").json(where)


@_query("SELECT s_suppkey AS id, 'r2' AS newest, '2024' AS built, (SELECT count(*) FROM supplier)::VARCHAR AS places FROM supplier")
def run_folder(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of one folder: the newest is found, its manifest was merged, its table is read back."""
    root = scratch_dir(spark, "runs")
    for name in ("r1", "r2"):
        run = render.Run(spark, root, name)
        run.write("places", _table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))
        run.manifest(built="2024")
        run.manifest(places=spark.read.parquet(f"{run.path}/places").count())
    newest = render.Run.newest(spark, root)
    told = render.Run(spark, root, newest.rsplit("/", 1)[-1]).manifest()
    return spark.read.parquet(f"{newest}/places").select("id", F.lit(newest.rsplit("/", 1)[-1]).alias("newest"), F.lit(told["built"]).alias("built"), F.lit(str(told["places"])).alias("places"))


@_query("SELECT 'This folder holds personal data: ' || sum(c_custkey % 3)::BIGINT::VARCHAR || ' officers, ' || sum(c_custkey % 2)::BIGINT::VARCHAR || ' people, ' || count(*) FILTER (c_custkey % 5 = 0)::VARCHAR || ' personal-looking e-mail addresses.' AS line, 0 AS ord FROM customer")
def privacy_note(spark: SparkSession, d: str) -> DataFrame:
    c = _base(spark, d, "SELECT c_custkey % 3 AS n_officers, c_custkey % 2 AS n_people, CASE WHEN c_custkey % 5 = 0 THEN array('jean.martin@x.fr') ELSE array('contact@x.fr') END AS emails FROM {customer}", "customer")
    return _lines(spark, render.privacy_note(c), bool)


@_query(
    """SELECT c_custkey AS k, array_to_string(list_filter([CASE c_custkey % 3 WHEN 0 THEN 'OSM `shop`, `office` tags only' WHEN 1 THEN 'OSM `shop` tags only' END, CASE WHEN c_custkey % 2 = 0 THEN 'register activity codes 62.01Z' END, CASE WHEN c_custkey % 5 = 0 THEN 'register sections C, J' END,
CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 7)::VARCHAR || ' explicit register identifier(s)' END, CASE WHEN c_custkey % 4 > 0 THEN 'capped at ' || (c_custkey % 4)::VARCHAR || ' results' END, CASE WHEN c_custkey % 6 = 0 THEN 'ceased companies included' END], lambda x: x IS NOT NULL), '; ') AS said FROM customer"""
)
def filter_words(spark: SparkSession, d: str) -> DataFrame:
    """The filters of each run in words; null, empty and default ones say nothing."""
    runs = _base(
        spark, d, """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN array('shop', 'office') WHEN 1 THEN array('shop') END AS osm_groups, CASE WHEN c_custkey % 2 = 0 THEN array('62.01Z') ELSE CAST(array() AS ARRAY<STRING>) END AS activity_codes, CASE WHEN c_custkey % 5 = 0 THEN array('C', 'J') END AS sections,
        CAST(array() AS ARRAY<STRING>) AS size_bands, array_repeat('1', CAST(c_custkey % 7 AS INT)) AS registry_ids, CAST(c_custkey % 4 AS INT) AS max_results, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false END AS include_ceased FROM {customer}""", "customer"
    )
    return render.filters_in_words(runs).select("k", F.array_join("said", "; ").alias("said"))


@_query(
    """WITH d AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'appeared' WHEN 1 THEN 'gotWebsite' ELSE 'wentDark' END AS kind, o_orderkey AS key FROM orders),
t AS (SELECT kind, count(*) AS n FROM d GROUP BY kind), l AS (SELECT CASE kind WHEN 'appeared' THEN 0 WHEN 'gotWebsite' THEN 1 ELSE 2 END AS k, kind, n FROM t)
SELECT 3 * k AS ord, '## ' || kind AS line FROM l UNION ALL SELECT 3 * k + 1, '| ' || (SELECT min(key) FROM d WHERE d.kind = l.kind)::VARCHAR || ' | x |' FROM l UNION ALL SELECT 3 * k + 2, '... and ' || (n - 50)::VARCHAR || ' more' FROM l"""
)
def delta_lines(spark: SparkSession, d: str) -> DataFrame:
    """Headings of a delta report, the first row of each section and how many more there are."""
    delta = _base(spark, d, "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'appeared' WHEN 1 THEN 'gotWebsite' ELSE 'wentDark' END AS delta_kind, o_orderkey AS key, 'x' AS detail FROM {orders}", "orders")
    lines, fresh = [], False
    for line in render.delta_report(delta).split("\n"):
        if line.startswith("## ") or line.startswith("... and") or (fresh and line.startswith("| ") and "| detail |" not in line):
            lines.append(line)
            fresh = line.startswith("## ")
    return _lines(spark, "\n".join(lines), bool)


@_query(
    f"""WITH p AS ({_duck(PLACES)}), c AS (SELECT count(*) AS n, count(*) FILTER (ne > 0 OR np > 0) AS anyone, count(*) FILTER (ne > 0 AND np > 0) AS both_, count(*) FILTER (is_hiring) AS h, count(*) FILTER (NOT is_hiring) AS nh, count(*) FILTER (is_hiring IS NULL) AS u, sum(open_roles) FILTER (is_hiring)::BIGINT AS roles, count(*) FILTER (place_id % 4 = 0) AS fit FROM p)
SELECT 0 AS ord, '- **Contacts.** ' || anyone || ' of ' || n || ' have an e-mail address or a phone number, ' || both_ || ' both' AS line FROM c UNION ALL SELECT 1, '## Judged (' || fit || ' of ' || n || ')' FROM c UNION ALL SELECT 2, fit || ' strong' FROM c
UNION ALL SELECT 3, (n - fit) || ' companies have a measured score and no verdict yet.' FROM c"""
)
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that the report states about the inventory and the verdicts."""
    p = _places(spark, d).withColumn("fit", F.when(F.col("place_id") % 4 == 0, "strong")).withColumn("why", F.lit(None).cast("string")).withColumn("angle", F.lit(None).cast("string"))
    p = p.withColumn("total", F.lit(1)).withColumn("name", F.lit("x"))
    parts = render.inventory(p) + render.judged(p)
    return _lines(spark, "\n".join(parts), lambda x: x.startswith(("- **Contacts", "## Judged")) or x.endswith(" strong") or "no verdict yet" in x)


@_query("SELECT 'Town &lt;1&gt;' AS title, least(2000, count(*)) AS rows, count(*) FILTER (s_suppkey % 2 = 0 AND s_suppkey % 3 = 0) > 0 AS hiring FROM supplier")
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """The page escapes its title and carries every place up to its limit."""
    import re

    s = _base(spark, d, "SELECT s_suppkey AS place_id, s_name AS name, 1 AS total, CAST(NULL AS STRING) AS fit, CAST(NULL AS STRING) AS site_confidence, 48.0D + s_suppkey * 0.001D AS lat, 2.0D AS lon, CASE WHEN s_suppkey % 6 = 0 THEN true END AS is_hiring, CAST(array() AS ARRAY<STRING>) AS emails, CAST(array() AS ARRAY<STRING>) AS phones, 0 AS term_matches, 0 AS matched_roles, CAST(NULL AS STRING) AS connector, CAST(NULL AS STRING) AS as_of FROM {supplier}", "supplier")
    page = render.html_page(s, "Town <1>")
    return spark.createDataFrame([(re.search("<title>(.*?)</title>", page)[1], page.count("<tr data-text"), "hiring:" in page)], "title string, rows long, hiring boolean")


@_query(
    """SELECT s_suppkey AS k, lpad((900000000 + s_suppkey)::VARCHAR, 9, '0') AS no_brreg, '0112' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') || '-9' AS fi_prh, 'EE' || (100000000 + s_suppkey)::VARCHAR AS ee_ariregister, 'HRB ' || s_suppkey::VARCHAR || ' B' AS de_offeneregister,
'HRB' || s_suppkey::VARCHAR || 'B' AS gleif, (100000000 + s_suppkey)::VARCHAR AS eu_vies FROM supplier"""
)
def more_identifier_forms(spark: SparkSession, d: str) -> DataFrame:
    """The other registers' identifiers, out of VAT numbers and spellings."""
    s = _base(spark, d, "SELECT s_suppkey AS k, concat('NO ', CAST(900000000 + s_suppkey AS STRING), ' MVA') AS no, concat('FI0112', lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0'), '9') AS fi, concat('ee ', CAST(100000000 + s_suppkey AS STRING)) AS ee, concat(' HRB  ', CAST(s_suppkey AS STRING), ' B') AS de, concat('hrb. ', CAST(s_suppkey AS STRING), ' b') AS gl, concat('EL ', CAST(100000000 + s_suppkey AS STRING)) AS el FROM {supplier}", "supplier")
    form = lambda c, v, k: registers.verify_id_form(c, F.col(v), F.lit(k)).alias(c.replace("-", "_"))
    return s.select("k", form("no-brreg", "no", "vat"), form("fi-prh", "fi", "vat"), form("ee-ariregister", "ee", "vat"), form("de-offeneregister", "de", "HRB"), form("gleif", "gl", "hrb"), form("eu-vies", "el", "vat"))
