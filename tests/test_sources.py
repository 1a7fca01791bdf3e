import bz2
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from placeloom import files
from placeloom.sources import boards, bulk, poi, registers

L = F.lit


def payload(spark, *objects):
    return spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o),) for o in objects], "payload string")


def test_france(spark):
    unit = {
        "siren": "302474648", "nom_complet": "NATURALIA FRANCE", "activite_principale": "47.29Z", "tranche_effectif_salarie": "42", "finances": {"2021": {"ca": 5}, "2022": {"ca": 7}},
        "siege": {"siret": "1", "adresse": "x", "numero_voie": "54", "type_voie": "QUAI", "libelle_voie": "CHARLES PASQUA", "latitude": "48.8", "longitude": "2.2", "est_siege": True, "etat_administratif": "A"},
        "matching_etablissements": [{"siret": "1", "est_siege": True, "etat_administratif": "A", "liste_enseignes": ["Naturalia", " "]}, {"siret": "2", "adresse": "3 RUE DU MIDI 94300 VINCENNES", "etat_administratif": "F"}],
        "dirigeants": [{"nom": "X", "prenoms": "Y", "qualite": "Z"}],
    }
    got = {r.establishment_id: r for r in registers.france(payload(spark, unit, {"siren": "9"}, "bad", {"siren": "8", "siege": {"siret": "8", "etat_administratif": "C"}})).collect()}
    assert set(got) == {"1", "2", "8"}
    assert got["1"].names == ["Naturalia", "NATURALIA FRANCE"] and got["1"].section == "G" and got["1"].street == "CHARLES PASQUA" and got["1"].size_band == "42"
    assert (got["2"].number, got["2"].kind, got["2"].street, got["2"].postcode, got["2"].status) == ("3", "RUE", "DU MIDI", "94300", "ceased")
    assert got["1"].national["revenue"] == "7" and got["8"].status == "ceased"


def test_small_mappers(spark):
    no = registers.norway(payload(spark, {"organisasjonsnummer": "1", "navn": "A", "konkurs": True, "antallAnsatte": 4, "harRegistrertAntallAnsatte": False, "naeringskode1": {"kode": "62.010"}})).first()
    assert (no.status, no.employees, no.section) == ("ceased", None, "J")
    cz = registers.czechia(payload(spark, {"ico": "1", "obchodniJmeno": "B", "czNace2008": ["00", "6201"], "seznamRegistraci": {"stavZdrojeVr": "AKTIVNI", "stavZdrojeRes": "ZANIKLY"}})).first()
    assert (cz.activity_code, cz.section, cz.status) == ("6201", "J", "ceased")
    pl = registers.poland(payload(spark, {"odpis": {"naglowekA": {"numerKRS": "7", "stanPozycji": 1}, "dane": {"dzial1": {"danePodmiotu": {"nazwa": "C"}, "przedmiotDzialalnosci": {"przedmiotPrzewazajacejDzialalnosci": [{"dzial": "62", "grupa": "01", "podklasa": "Z"}]}}}}})).first()
    assert (pl.activity_code, pl.section, pl.status) == ("62.01.Z", "J", "active")
    g = registers.lei(payload(spark, {"attributes": {"lei": "L", "entity": {"legalName": {"name": "D"}, "otherNames": [{"name": "E"}], "status": "INACTIVE", "registeredAs": "HRB 12", "legalAddress": {"country": "DE"}}}}))
    assert g.first().names == ["E", "D"] and g.first().status == "ceased" and registered(g)


def registered(g):
    return registers.registered_as(g, "hrb12").count() == 1 and registers.registered_as(g, "HRB 13").count() == 0


def test_addresses(value):
    a = value(registers.raw_address(L("54 QUAI CHARLES PASQUA 92300 LEVALLOIS-PERRET")))
    assert tuple(a) == ("54", "QUAI", "CHARLES PASQUA", "92300", "LEVALLOIS-PERRET")
    assert tuple(value(registers.split_native(L("Amtsgericht Köln HRB 123 B")))) == ("Amtsgericht Köln", "HRB", "123 B")
    assert tuple(value(registers.german_address(L("Weg 1, 50667 Köln."), L("K")))) == ("Weg 1", "50667", "Köln")
    assert tuple(value(registers.vat_address(L("RUE X 1\n75001 PARIS")))) == ("RUE X 1", "75001", "PARIS")
    assert value(registers.disclosed(L("---"))) is None
    assert [value(registers.vat_verdict(L(x))) for x in ('{"isValid":true}', '{"isValid":false,"userError":"INVALID"}', '{"isValid":false,"userError":"MS_UNAVAILABLE"}')] == ["valid", "invalid", "inconclusive"]
    form = lambda c, v, k=None: value(registers.verify_id_form(c, L(v), None if k is None else L(k)))
    assert [form("gb-companies-house", v) for v in ("123 4567", "sc123456", "SC12345678", "1234")] == ["01234567", "SC123456", None, None]
    assert form("gb-companies-house", "GB123456789", "vat") is None and form("us-edgar", "CIK 320193") == "0000320193" and form("us-edgar", "0") is None
    assert [form("fr-sirene", *x) for x in (("302 474 648", "siren"), ("30247464800017", "siret"), ("FR12302474648", "vat"), ("12", "siren"))] == ["302474648"] * 3 + [None]
    assert form("no-brreg", "NO 923 609 016 MVA", "vat") == "923609016" and form("fi-prh", "FI01120389", "vat") == form("fi-prh", " 0112038-9 ", "ytunnus") == "0112038-9"
    assert form("cz-ares", "CZ177041", "vat") == "00177041" and form("pl-krs", "41581", "krs") == "0000041581" and form("pl-krs", "41581", "vat") is None
    assert form("ee-ariregister", "ee 123456789", "vat") == "EE123456789" and form("ee-ariregister", "12345678", "code") == "12345678" and form("ee-ariregister", "1234", "code") is None
    assert form("de-offeneregister", " HRB   9 B", "hrb") == "HRB 9 B" and form("gleif", "hrb 1.2", "hrb") == "HRB12" and form("gleif", "abc", "lei") == "ABC" and form("eu-vies", "EL 12-3", "vat") == "123"


def test_bulk_csv_zip_and_lookup(spark, tmp_path):
    csv = '﻿CompanyNumber, CompanyName,SICCode.SicText_1,RegAddress.PostTown,RegAddress.AddressLine1,RegAddress.PostCode,RegAddress.Country,CompanyCategory,CompanyStatus,IncorporationDate,DissolutionDate,' + ",".join(f"PreviousName_{i}.CompanyName" for i in range(1, 6))
    csv += '\n1,"ACME, ""Best""\nLtd",99999 - Dormant,LEEDS,1 High St,LS1,,Private,Active,,,OLD,,,,\n,No number,,,,,,,,,,,,,,\n2,B,62010 - IT,York,,,,,Dissolved,,,,,,,\n'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", csv)
    rows = bulk.read_csv(spark, files.unzip_member(spark, str(tmp_path / "a.zip"), str(tmp_path)))
    r = registers.uk_bulk(rows)
    got = {x.id: x for x in r.collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].names == ['ACME, "Best"\nLtd', "OLD"] and got["1"].section is None and got["1"].national["administrative"] == "dormant company"
    assert got["2"].section == "J" and got["2"].status == "ceased"
    snap = bulk.Snapshot(spark, str(tmp_path / "snap"))
    assert snap.ingest(r, total=3, vintage="2024-05-01")["skipped"] == 1
    assert [x.id for x in snap.by_locality("Leeds").collect()] == ["1"] and snap.by_locality("Leed").count() == 0
    assert [x.as_of for x in snap.by_id("2").collect()] == ["2024-05-01"]
    with pytest.raises(ValueError):
        snap.ingest(r.limit(0))


def test_bulk_bzip2_lines(spark, tmp_path):
    lines = [{"name": "Foo GmbH", "registered_address": "Weg 1, 50667 Köln.", "current_status": "currently registered", "retrieved_at": "2018-11-09T18:03:03Z",
              "all_attributes": {"native_company_number": "Köln HRB 9", "registered_office": "Köln"}, "officers": [{"name": "A B", "position": "GF"}]}, {"name": "no number"}]
    (tmp_path / "d.jsonl.bz2").write_bytes(bz2.compress(("\n".join(map(json.dumps, lines)) + "\nbroken{\n").encode()))
    r = registers.german_bulk(bulk.read_json_lines(spark, str(tmp_path / "d.jsonl.bz2"))).collect()
    assert len(r) == 1 and r[0].ids == ["Köln HRB 9", "HRB 9"] and r[0].as_of == "2018-11-09" and r[0].localities == ["Köln"] and r[0].officers == ["A B — GF"]


def test_estonia(spark):
    row = dict(nimi="OÜ", ariregistri_kood="1", asukoha_ehak_tekstina="Tallinn, Harju, x", ads_normaliseeritud_taisaadress="", ettevotja_aadress="A 1", asukoht_ettevotja_aadressis="", indeks_ettevotja_aadressis="10", kmkr_nr="EE1", ettevotja_staatus="L", ettevotja_oiguslik_vorm="", ettevotja_esmakande_kpv="01.02.2003")
    r = registers.estonian_bulk(spark.createDataFrame([row])).first()
    assert (r.localities, r.city, r.status, r.date_created, r.ids, r.address_raw) == (["Tallinn", "Harju"], "Tallinn", "ceased", "2003-02-01", ["1", "EE1"], "A 1")


def test_boards(spark):
    d = spark.createDataFrame(
        [("lever", "acme", '[{"text":"Dev","hostedUrl":"u","categories":{"location":"Paris"},"createdAt":1700000000000},{"text":" "}]'),
         ("personio", "p", "<position><id>3</id><jobDescriptions><name>no</name></jobDescriptions><name><![CDATA[A &amp; B]]></name></position>"),
         ("workable", "w", '{"jobs":[{"title":"T","city":"Lyon","country":"FR"}]}'), ("greenhouse", "g", "bad"), ("join", "j", "{}")],
        "provider string, token string, payload string",
    )
    got = {(r.provider, r.title): r for r in boards.postings(d).collect()}
    assert set(got) == {("lever", "Dev"), ("lever", "(untitled)"), ("personio", "A & B"), ("workable", "T")}
    assert got["lever", "Dev"].posted_at == "2023-11-14T22:13:20.000Z" and got["workable", "T"].location == "Lyon, FR"
    s = spark.createDataFrame([("s", 1, "<urlset><url><loc>a</loc><lastmod>2024-01-02</lastmod></url><url><loc>b</loc></url></urlset>")], "site string, ord int, body string")
    assert tuple(boards.sitemap_summary(boards.sitemap_entries(s)).first()) == ("s", 2, "2024-01-02")


def test_poi_classes(value):
    assert [value(poi.failure_class(L(x))) for x in ("Dispatcher_Client::request_read_and_idx::timeout", "HTTP 504", "HTTP 429", "fetch failed", "ETIMEDOUT", "rate limit", "Query timed out in 90 seconds", "out of memory", "timeout", "x")] == ["busy"] * 6 + ["too-big"] * 2 + ["other"] * 2
    assert value(poi.area_id(L("relation"), L(108346))) == 3600108346


def test_connectors(spark):
    got = {r.connector: r.role for r in registers.connectors_for(spark, "fr").collect()}
    assert got == {"fr-sirene": "sweep", "gleif": "lookup"}
    down = {r.connector: r.reason for r in registers.connectors_for(spark, "gb", {"gb-companies-house": "no key"}).collect()}
    assert down["gb-companies-house"] == "no key"


def test_freshness(spark):
    c = spark.createDataFrame([("a", "2024-01-01", "1", bulk.LAYOUT), ("b", "2024-01-01", "1", bulk.LAYOUT), ("c", "2024-01-01", "1", 1)], "source string, modified string, tool string, layout int")
    u = spark.createDataFrame([("a", "2024-02-01"), ("b", "2024-01-01")], "source string, modified string")
    assert {r.source: r.state for r in bulk.freshness(c, u, "1").collect()} == {"a": "stale", "b": "fresh", "c": "unreadable"}


def test_robots(spark):
    from placeloom.sources import pages

    body = "User-agent: *\nDisallow: /\n\nUser-agent: placeloom\nUser-agent: other\nDisallow: /private # no\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:\n"
    rules = pages.robots_rules(spark.createDataFrame([("s", body), ("t", "")], "site string, body string"))
    paths = ["/private/x", "/private/open", "/a.pdf", "/a.pdf?x", "/"]
    urls = spark.createDataFrame([(s, p) for s in "st" for p in paths], "site string, path string")
    got = {(r.site, r.path): r.allowed for r in pages.allowed(urls, rules, "Placeloom/1.0").collect()}
    assert [got["s", p] for p in paths] == [False, True, False, True, True] and all(got["t", p] for p in paths)
    assert not any(r.allowed for r in pages.allowed(urls.where("site = 's'"), rules, "x").collect())


def test_activity_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_text("code,label\n62.01Z,a\n62.02A,b\n63.11Z,c\n01.11Z,d\n")
    got = registers.divisions_of_section(spark, str(tmp_path / "c.csv"), "J").collect()
    assert [(r.division, r.codes) for r in got] == [("62", ["62.01Z", "62.02A"]), ("63", ["63.11Z"])]


def test_lanes_are_replayed(spark, tmp_path):
    from placeloom.sources import places

    one = spark.range(1).selectExpr("'Lyon' AS label")
    places.record_lanes(f"{tmp_path}/r", one, spark.range(3), spark.range(2))
    lanes = places.load_lanes(spark, f"{tmp_path}/r")
    assert [lanes[k].count() for k in places.LANES] == [1, 3, 2]
    with pytest.raises(Exception, match="(?i)exist"):
        places.record_lanes(f"{tmp_path}/r", one, one, one)
    places.record_lanes(f"{tmp_path}/e", one.limit(0), one, one)
    with pytest.raises(ValueError):
        places.load_lanes(spark, f"{tmp_path}/e")


def test_snapshot_keys(spark, tmp_path):
    """A key without letters finds nothing; a new ingest replaces the old one at once."""
    rows = [("1", ["東京"], ["x" * 130 + "a"]), ("2", ["Ōsaka", "osaka"], ["x" * 130 + "b"])]
    r = spark.createDataFrame(rows, "id string, localities array<string>, ids array<string>").selectExpr("*", "'c' AS connector", "cast(null AS string) AS establishment_id", "cast(null AS string) AS as_of")
    snap = bulk.Snapshot(spark, f"{tmp_path}/s")
    with pytest.raises(FileNotFoundError):
        snap.current()
    snap.ingest(r, modified="2024-03-01")
    first = snap.current()
    assert snap.by_locality("大阪").count() == 0 and snap.by_locality("OSAKA").count() == 1
    assert [x.id for x in snap.by_id("X" * 130 + "B").collect()] == ["2"] and snap.by_id("東京").count() == 0
    assert {x.as_of for x in snap.by_id("x" * 130 + "a").collect()} == {"2024-03-01"}
    snap.ingest(r.where("id = '2'"))
    assert snap.current() != first and snap.by_id("x" * 130 + "a").count() == 0


def _no_exchange_over(plan, folder):
    """Scans under the folder have no exchange above them up to their join."""
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "FileScan" in line and folder in line:
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            for above in reversed(lines[:i]):
                own = len(above) - len(above.lstrip(" :+-*()0123456789"))
                if own < depth:
                    if "Exchange" in above:
                        return False
                    if "Join" in above:
                        break
                    depth = own
    return True


def test_batch_look_ups_leave_the_snapshot_where_it_is(spark, tmp_path):
    """Hot towns are cut into slots; neither look-up has an exchange over snapshot tables, from another session either."""
    r = spark.range(3000).selectExpr("cast(id AS string) AS id", "array(CASE WHEN id % 3 = 0 THEN 'Paris' ELSE concat('T', id % 40) END, 'all') AS localities", "array(concat('N', id), concat('G', id % 700)) AS ids", "'c' AS connector", "cast(null AS string) AS establishment_id", "cast(null AS string) AS as_of")
    snap = bulk.Snapshot(spark, f"{tmp_path}/s", block=200)
    snap.ingest(r)
    parts = {f.name.split("_")[-1][:5] for f in (tmp_path / "s").glob("*/records/part-*.parquet")}
    assert len(parts) > 8
    wanted = spark.createDataFrame([("PARIS",), ("t7",), ("none",), ("all",)], "locality string")
    ids = spark.range(0, 9000, 7).selectExpr("concat('n', id) AS wanted_id").unionByName(spark.createDataFrame([("g5",), ("G699",)], "wanted_id string"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for session in (spark, spark.newSession()):
            session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            again = bulk.Snapshot(session, f"{tmp_path}/s", block=200)
            if session is not spark:
                for t in ("records", "ids", "mapped"):
                    session.sql(f"DROP TABLE {again._name(again.current(), t)}")
                wanted, ids = (session.createDataFrame(x.collect(), x.schema) for x in (wanted, ids))
            town, number = again.localities(wanted), again.identifiers(ids)
            assert {x["locality"]: x["count"] for x in town.groupBy("locality").count().collect()} == {"PARIS": 1000, "all": 3000, "t7": 50}
            assert number.count() == len(range(0, 3000, 7)) + 5 + 4
            for out, tables in ((town, ["records"]), (number, ["ids", "mapped"])):
                plan = out._jdf.queryExecution().executedPlan().toString()
                assert all(f"{t}" in plan and _no_exchange_over(plan, f"/{t}]") for t in tables), plan
                assert plan.count("Bucketed: true") >= len(tables)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert snap.by_locality("paris").count() == 1000 and sorted(x.id for x in snap.by_id("G5").collect()) == ["1405", "2105", "2805", "5", "705"]
    one = snap.by_locality("t7")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in one and "EqualTo(slot,t7)" in one
