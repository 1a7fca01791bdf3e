import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placeloom import catalogue
from placeloom.functions import extract, geo, text

L = F.lit


def null():
    return F.lit(None).cast("string")


@pytest.mark.parametrize(
    "raw, want",
    [("SARL L’Étoile du Nord (Paris)", "l etoile du nord paris"), ("Crèche Møller", "creche m ller"), ("Groupe SA", ""), ("Łódź GmbH", "odz"), ("", "")],
)
def test_normalize_name(value, raw, want):
    """Letters without a decomposition (ø, ł) are no letters of the normal form."""
    assert value(text.normalize_name(L(raw))) == want


@pytest.mark.parametrize(
    "a, b, low, high",
    [
        ("Boulangerie Rêve", "BOULANGERIE REVE SARL", 1, 1), ("Naturalia", "Groupe X (NATURALIA, Autre)", 1, 1), ("Boulangerie", "Boulangerie Martin", 0, 0.87),
        ("Naturalia", "Naturalia Vincennes", 0.88, 0.88), ("", "x", 0, 0), ("abc", "xyz", 0, 0),
    ],
)
def test_name_similarity(value, a, b, low, high):
    s = value(text.name_similarity(L(a), L(b)))
    assert low <= s <= high
    assert s == value(text.name_similarity(L(b), L(a)))


def test_streets_and_addresses(value):
    assert value(text.street_line(L("12"), L("RUE"), L("Rue de la Paix"))) == "12 Rue de la Paix"
    assert value(text.street_line(L("12"), null(), null())) == ""
    assert value(text.same_street(L("Rue de la Paix"), L("PAIX"), L("RUE")))
    assert not value(text.same_street(null(), L("PAIX"), L("RUE")))


@pytest.mark.parametrize("raw, want", [("800", 800), ("2km", 2000), ("1,5 km", 1500), ("0", None), ("x", None)])
def test_parse_distance(value, raw, want):
    assert value(text.parse_distance_m(L(raw))) == want


def test_parse_bbox_and_clamp(value):
    assert value(text.parse_bbox(L("48.81,2.22,48.90,2.47"))) == [48.81, 48.9, 2.22, 2.47]
    assert value(text.parse_bbox(L("48.9,2.22,48.8,2.47"))) is None
    assert value(text.parse_bbox(L("a,b,c,d"))) is None
    assert [value(text.clamp_int(L(x), 1, 10, 3)) for x in ("12abc", "x", "-5")] == [10, 3, 1]


def test_csv_and_markup(value):
    assert value(text.csv_row([L('a"b'), L("c,d"), null(), L("x")])) == '"a""b","c,d",,x'
    assert value(text.html_escape(L("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert value(text.markdown_cell(L("a|b\n c"))) == "a\\|b c"


def test_geo(value):
    assert value(geo.haversine_m(L(48.8475), L(2.4397), L(48.8484), L(2.4387))) == pytest.approx(123.97, abs=0.01)
    q = value(geo.bbox_quadrants(L(0.0), L(2.0), L(0.0), L(2.0)))
    assert [tuple(x) for x in q] == [(0, 1, 0, 1), (0, 1, 1, 2), (1, 2, 0, 1), (1, 2, 1, 2)]


def test_emails_phones_socials(value):
    got = value(extract.emails(L("write to Info@acme.fr. or a@b.png, test@x.fr"), L('<a href="mailto:Sales%2Bx@acme.fr?subject=1">')))
    assert [(e.value, e.note) for e in got] == [("sales+x@acme.fr", "mailto link"), ("info@acme.fr", "in the page text")]
    assert value(extract.phones(L('<a href="tel:+33 1 43 28.00-00"><a href="tel:12 34">'))) == ["+33143280000"]
    assert value(extract.socials(L("https://www.facebook.com/acme https://facebook.com/sharer?u=x https://x.com/"))) == ["https://www.facebook.com/acme"]


def test_terms(value):
    got = value(extract.term_mentions(L("Wir suchen Freiberuflern und freiberuflern, Freiberuflerinnenquote."), ["Freiberufler"]))
    assert [m.value for m in got] == ["Freiberuflern"] and "Wir suchen" in got[0].note
    assert value(extract.term_mentions(L("x"), [])) == []


def test_legal_ids(value):
    got = value(extract.legal_ids(L("RCS Paris 302 474 648 TVA FR 40 302474648, HRB 12345 Amtsgericht Köln, ATU12345678, xATU87654321, EL123456789"), null()))
    assert [(x.kind, x.value, x.country) for x in got] == [
        ("siren", "302474648", "fr"), ("hrb", "HRB 12345", "de"), ("vat", "ATU12345678", "at"), ("vat", "EL123456789", "gr"), ("vat", "FR40302474648", "fr"),
    ]
    assert got[1].context == "Köln"
    gb = value(extract.legal_ids(L("Company number: SC123456"), L("gb")))
    assert [(x.kind, x.value) for x in gb] == [("company-number", "SC123456")]


def test_pages(value):
    html = '<html lang="fr"><title>T &amp; U</title><link hreflang="de"><style>x</style><p>Hello<br>you</p><p>A&nbsp;b</p>'
    assert value(extract.languages(L(html))) == ["fr", "de"]
    assert value(extract.page_title(L(html))) == "T & U"
    assert value(extract.html_to_text(L(html))) == "Hello\nyou\nA b"
    assert value(extract.canonical_url(L("HTTPS://WWW.Acme.fr:443/a/b/?utm_source=x&b=2&a=1#f"))) == "https://acme.fr/a/b?a=1&b=2"
    assert value(extract.same_origin_links(L('<a href="/a#x"><a href="https://y.fr/b"><a href="mailto:z"><a href="b">'), L("https://x.fr/c/"))) == ["https://x.fr/a", "https://x.fr/c/b"]
    boards = value(extract.job_boards(L("https://jobs.lever.co/acme https://www.recruitee.com https://acme.recruitee.com")))
    assert [(b.provider, b.token) for b in boards] == [("lever", "acme"), ("recruitee", "acme")]


def test_page_titles_equal_their_sql(spark, tmp_path):
    pages = ["<title>a = &quot;b&quot; &amp;lt; &lt;i&gt;&nbsp;</title>", "<TITLE lang=x> a\tb\n </TITLE><title>c</title>", "<p>none", None, "<title>a\x0bb</title>"]
    pd.DataFrame({"page_id": range(len(pages)), "html": pages}).to_parquet(f"{tmp_path}/pages.parquet")
    oracle.same(catalogue.queries()["page_titles"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), catalogue.oracle_sql()["page_titles"])


def test_page_title_reads_every_reference(value):
    assert value(extract.page_title(L("<title>a &quot;b&quot; &eacute; &#39;</title>"))) == "a \"b\" é '"


def test_technology(value):
    t = value(extract.technology(L('<script type="application/ld+json">{"@graph":[{"@type":"Shop"}]}</script><script type="application/ld+json">bad</script> wp-content /_next/static/ gtag(\'config\' panier')))
    assert (t.cms, t.analytics, t.tech_stack, t.has_ecommerce) == ("WordPress", ["Google Analytics"], ["Next.js", "schema:Shop"], True)
