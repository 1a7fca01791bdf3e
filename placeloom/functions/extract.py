"""Extraction from page text, HTML and URLs as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.functions import dims

# fixed values: e-mail shapes that are files or placeholders
ASSET_SUFFIX = r"(?i)\.(png|jpe?g|gif|svg|webp|css|js|woff2?)$"
PLACEHOLDER = r"(?i)^(?:example|test|no-?reply|your|email|nom|prenom)@"
# fixed values: query parameters that only track
TRACKING = r"(?i)^(?:utm_|fbclid$|gclid$|mc_|ref$|ref_src$|ref_url$|spm$|_hsenc$|_hsmi$|igshid$)"


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often and wherever ``use`` mentions it, lambdas included."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def page_role(url: Column) -> Column:
    """What a page is for, from the path of its URL; an unparsable URL is taken as a path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), url)
    out = F.when((path == "/") | (path == ""), "home")
    for role, words in dims.PAGE_ROLES:
        out = out.when(path.rlike(rf"(?i)(?:^|/)(?:{words})(?:/|$|\.)"), role)
    return out.otherwise("other")


def plausible_email(c: Column) -> Column:
    return c.rlike(r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}$") & ~c.rlike(ASSET_SUFFIX) & ~c.rlike(PLACEHOLDER)


def emails(text: Column, html: Column) -> Column:
    """Array of ``(value, note)``: mailto links first, then addresses in the text; the first of each value."""
    linked = F.transform(matches(html, r"""(?i)mailto:([^"'?>\s]+@[^"'?>\s]+)""", 1), lambda m: F.lower(F.coalesce(F.try_url_decode(m), m)))
    written = F.transform(matches(text, r"[\w.+-]+@[\w-]+\.[\w.-]{2,}"), lambda m: F.regexp_replace(F.lower(m), "[.,;:]$", ""))
    linked = F.array_distinct(F.filter(linked, plausible_email))
    written = F.array_except(F.filter(written, plausible_email), linked)
    tag = lambda note: lambda v: F.struct(v.alias("value"), F.lit(note).alias("note"))
    return F.concat(F.transform(linked, tag("mailto link")), F.transform(written, tag("in the page text")))


def phones(html: Column) -> Column:
    """Numbers of ``tel:`` links without separators, eight digits at least."""
    bare = F.transform(matches(html, r"(?i)tel:([+0-9().\s-]{6,})", 1), lambda m: F.regexp_replace(m, r"[\s.()-]", ""))
    return F.array_distinct(F.filter(bare, lambda m: F.length(F.regexp_replace(m, r"\D", "")) >= 8))


def socials(html: Column) -> Column:
    found = F.transform(matches(html, "(?i)" + dims.SOCIAL_LINK), lambda m: F.regexp_replace(m, "[)\"'<>]+$", ""))
    path = lambda m: F.regexp_replace(F.coalesce(F.try_parse_url(m, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.array_distinct(F.filter(found, lambda m: ~m.rlike("(?i)" + dims.NOT_A_PROFILE) & (F.length(path(m)) >= 2)))


def languages(html: Column) -> Column:
    """``<html lang>`` first, then hreflang links, two letters each."""
    own = F.slice(matches(html, r"""(?i)<html[^>]*\slang=["']([a-z]{2})""", 1), 1, 1)
    return F.array_distinct(F.transform(F.concat(own, matches(html, r"""(?i)hreflang=["']([a-z]{2})""", 1)), F.lower))


def term_pattern(terms: list[str]) -> str:
    """Longest term first, whole words with up to three more letters, any case."""
    longest = "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t) for t in sorted(terms, key=len, reverse=True))
    return rf"(?iu)(?<!\p{{L}})(?:{longest})\p{{L}}{{0,3}}(?!\p{{L}})"


def term_mentions(text: Column, terms: list[str]) -> Column:
    """Array of ``(value, note)``: the first mention of each spelling (case aside) with up to 90 characters around it."""
    if not terms:
        return F.array().cast("array<struct<value:string,note:string>>")
    pattern = term_pattern(terms)
    found, gaps = matches(text, pattern), F.split(text, pattern, -1)
    placed = F.aggregate(
        F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,m:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["pos"] + F.length(x["g"]) + F.length(x["m"])).alias("pos"),
            F.when(F.exists(acc["out"], lambda o: F.lower(o["m"]) == F.lower(x["m"])), acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.struct((acc["pos"] + F.length(x["g"])).alias("at"), x["m"].alias("m")))))
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )

    def around(o: Column) -> Column:
        begin = F.greatest(F.lit(0), o["at"] - 90)
        return F.trim(F.regexp_replace(F.substr(text, begin + 1, o["at"] + F.length(o["m"]) + 90 - begin), r"\s+", " "))

    return F.transform(placed, lambda o: F.struct(o["m"].alias("value"), around(o).alias("note")))


def fingerprints(html: Column, table: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(html.rlike("(?i)" + p), F.lit(name)) for name, p in table]))


def technology(html: Column) -> Column:
    """``(cms, analytics, tech_stack, has_ecommerce)``: the first content system, the rest join the stack with JSON-LD types."""
    cms = fingerprints(html, dims.CMS)
    types = F.transform(json_ld_types(html), lambda t: F.concat(F.lit("schema:"), t))
    rest = F.slice(cms, 2, F.greatest(F.size(cms), F.lit(1)))
    return F.struct(
        F.get(cms, F.lit(0)).alias("cms"), fingerprints(html, dims.ANALYTICS).alias("analytics"), F.array_distinct(F.concat(rest, types)).alias("tech_stack"),
        html.rlike("(?i)" + dims.ECOMMERCE).alias("has_ecommerce"),
    )


def json_ld_nodes(html: Column) -> Column:
    """JSON-LD objects of a page as variants: arrays and @graph flattened, bad JSON skipped."""
    blocks = matches(html, r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
    parsed = F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    listed = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    flat = F.flatten(F.transform(parsed, listed))
    graph = lambda v: F.try_variant_get(v, "$['@graph']", "array<variant>")
    return F.flatten(F.transform(flat, lambda v: F.coalesce(graph(v), F.array(v))))


def json_ld_types(html: Column) -> Column:
    return F.filter(F.transform(json_ld_nodes(html), lambda v: F.try_variant_get(v, "$['@type']", "string")), lambda t: t.isNotNull() & ~t.startswith("["))


def _tagged(tag: str, value: str, name: str):
    """A transform function that pairs each element with a constant."""
    return lambda v: F.struct(F.lit(value).alias(tag), v.alias(name))


def job_boards(html: Column) -> Column:
    """Array of ``(provider, token)`` that a page links to, first of each."""
    account = lambda t: (t != "") & ~F.lower(t).isin(dims.NOT_AN_ACCOUNT)
    per = [F.transform(F.filter(matches(html, "(?i)" + p, 1), account), _tagged("provider", name, "token")) for name, p in dims.BOARDS]
    return F.array_distinct(F.concat(*per))


def vat_numbers(text: Column) -> Column:
    """Array of ``(country, value)``: VAT numbers, separators inside allowed, not right after a letter, first of each.

    Separators between the symbols are allowed in the pattern itself, so no index map into the original text is
    needed; Greece is reported as ``gr``, the code its register uses."""
    per = []
    for country, shape in dims.VAT:
        units = re.findall(r"\((?:\?:)?|\)|\||(?:\[[^\]]+\]|\\d|[A-Z0-9])(?:\{[\d,]+\})?", shape)
        spaced = "".join(_spaced(u) for u in units)
        found = F.transform(matches(text, rf"(?i)(?<![A-Za-z]){spaced}"), lambda m: F.upper(F.regexp_replace(m, r"[ \t\n\r.-]", "")))
        per.append(F.transform(F.array_distinct(found), _tagged("country", "gr" if country == "el" else country, "value")))
    return F.concat(*per)


def _spaced(unit: str) -> str:
    if unit in ("(?:", "(", ")", "|"):
        return unit
    m = re.fullmatch(r"(\[[^\]]+\]|\\d|[A-Z0-9])(?:\{([\d,]+)\})?", unit)
    body = rf"(?:[ \t\n\r.-]*{m[1]})"
    return body + (f"{{{m[2]}}}" if m[2] else "")


# fixed values: shapes of national register numbers and of the court beside them
HR_NUMBER = r"(?i)\bHR([AB])\s*[:\s]?\s*(\d{1,7})\b"
HR_COURT = r"\b(?:Amtsgerichts?|Registergerichts?)\s*:?\s*(?!HR[AB]\b)(?!Amtsgericht|Registergericht)([A-ZÄÖÜ][\wÄÖÜäöüß.]*(?:[- ][A-ZÄÖÜ][\wÄÖÜäöüß.]*)?)"
SIRET = r"(?i)\bSIRET\D{0,12}(\d[\d\s.]{12,17}\d)\b"
SIREN = r"(?i)\b(?:SIREN|RCS[^\d]{0,30})\D{0,6}(\d[\d\s.]{7,12}\d)\b"
UK_NUMBER = r"(?i)\b(?:compan(?:y|ies)\s+(?:reg(?:istration|istered)?\.?\s*)?(?:no\.?|number)|registered\s+in\s+England[^.]{0,40}?no\.?)[\s:.–—-]{0,10}((?:[A-Z]{2})?\d{6,8})\b"
SPANISH_NIF = r"(?i)\b(?:C\.?I\.?F\.?|N\.?I\.?F\.?)\s*[:.]?\s*([A-Z]\d{7}[A-Z0-9]|\d{8}[A-Z])\b"


def handelsregister(text: Column) -> Column:
    """``(value, court)`` of a German register number; the court is looked for near the number."""
    kind, number = F.regexp_extract(text, HR_NUMBER, 1), F.regexp_extract(text, HR_NUMBER, 2)
    at = F.length(F.get(F.split(text, HR_NUMBER, 2), F.lit(0)))
    begin = F.greatest(F.lit(0), at - 120)
    near = F.substr(text, begin + 1, at + 160 - begin)
    court = F.regexp_extract(near, HR_COURT, 1)
    return F.when(number != "", F.struct(F.concat(F.lit("HR"), F.upper(kind), F.lit(" "), number).alias("value"), F.nullif(F.trim(court), F.lit("")).alias("court")))


def siren_siret(text: Column) -> Column:
    siret = F.regexp_replace(F.regexp_extract(text, SIRET, 1), r"\D", "")
    siren = F.regexp_replace(F.regexp_extract(text, SIREN, 1), r"\D", "")
    make = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    return F.when(siret != "", make("siret", siret)).when(siren != "", make("siren", siren))


def uk_company_number(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, UK_NUMBER, 1)), F.lit(""))


def spanish_nif(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, SPANISH_NIF, 1)), F.lit(""))


def legal_ids(text: Column, country: Column) -> Column:
    """Ordered array of ``(kind, value, country, context)``: national forms of the country (French, German and Spanish
    when it is unknown), then VAT numbers; first of each kind and value."""
    cc = F.lower(F.coalesce(country, F.lit("")))
    here = lambda c: (cc == c) | (cc == "")
    one = lambda kind, v, c, context=None: F.struct(
        kind.alias("kind") if isinstance(kind, Column) else F.lit(kind).alias("kind"), v.alias("value"), F.lit(c).alias("country"),
        (F.lit(None).cast("string") if context is None else context).alias("context"),
    )
    fr, de, gb, es = siren_siret(text), handelsregister(text), uk_company_number(text), spanish_nif(text)
    national = F.array_compact(
        F.array(
            F.when(here("fr") & fr.isNotNull(), one(fr["kind"], fr["value"], "fr")),
            F.when(here("de") & de.isNotNull(), one("hrb", de["value"], "de", de["court"])),
            F.when((cc == "gb") & gb.isNotNull(), one("company-number", gb, "gb")),
            F.when(here("es") & es.isNotNull(), one("nif", es, "es")),
        )
    )
    vat = F.transform(vat_numbers(text), lambda v: F.struct(F.lit("vat").alias("kind"), v["value"].alias("value"), v["country"].alias("country"), F.lit(None).cast("string").alias("context")))
    return F.concat(national, vat)


# fixed values: countries whose law asks for a legal notice on a company's site
NOTICE_COUNTRIES = "at be ch de es fr gb ie it nl pl pt".split()


def legal_id_coverage(country: Column) -> Column:
    """``(expected, note)``: whether sites of a country must show a registration number, and what to say if not."""
    cc = F.lower(country)
    known = F.coalesce(cc.isin(NOTICE_COUNTRIES), F.lit(False))
    note = (
        F.when(known, F.concat(cc, F.lit(": sites must publish a registration number")))
        .when(cc == "us", "us: no federal register and no published company number; identity rests on address and name")
        .otherwise(F.concat(F.coalesce(cc, F.lit("this country")), F.lit(": no registration number is expected on sites")))
    )
    return F.struct(known.alias("expected"), note.alias("note"))


def html_to_text(html: Column) -> Column:
    """Visible text: comments, scripts, styles and templates out, block ends as line ends, tags out, entities decoded."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|template|svg|title)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|section|article|header|footer|ul|ol|table|nav|main)\s*>", "\n")
    out = decode_entities(F.regexp_replace(out, r"(?s)<[^>]*>", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f\r\x{A0}]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{2,}", "\n"), r"^\s+|\s+$", "")


# fixed values: what a reader does not see, and where lines begin and end
UNSEEN = r"(?is)<!--.*?-->|<(script|style|noscript|head|nav|footer|svg|template).*?</\1>"
LINE_TAGS = r"(?i)</(?:p|div|section|article|li|tr|td|th|ul|ol|h[1-6]|pre|blockquote|br)>|<(?:p|div|section|article|li|tr|td|th|ul|ol|pre|blockquote|table)\b[^>]*>|<(?:br|hr)\s*/?>"
BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def readable_text(html: Column) -> Column:
    """What a reader sees of a piece of markup, for storing and citing: navigation and footers out as well, one line for each block, list item and
    table cell, headings marked by as many # as their level, entities decoded, no empty lines."""
    out = F.regexp_replace(html, UNSEEN, " ")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{level}(?:\s[^>]*)?>", f"\n{'#' * level} ")
    out = F.regexp_replace(F.regexp_replace(out, LINE_TAGS, "\n"), r"(?s)<[^>]+>", " ")
    lines = F.transform(F.split(F.regexp_replace(decode_entities(out), r"[ \t]+", " "), "\n"), lambda line: F.regexp_replace(line, f"^{BLANK}|{BLANK}$", ""))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


# the named entities of HTML 4, and the apostrophe; no-break spaces are plain ones
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " ", "apos": "'"}


def decode_entities(c: Column) -> Column:
    """Named and numeric entities, each once; an unknown name stays, a number that is no character is a blank."""
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    pattern = r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"

    def plain(ref: Column) -> Column:
        code = F.when(ref.rlike("^#[xX]"), F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2))).try_cast("int")
        ok = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        wide = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        number = F.when(ok, wide).otherwise(" ")
        return F.when(ref.startswith("#"), number).otherwise(F.coalesce(F.element_at(names, ref), F.concat(F.lit("&"), ref, F.lit(";"))))

    def joined(parts: Column) -> Column:  # a reference and the text after it, pair by pair
        pairs = F.zip_with(parts["refs"], F.slice(parts["gaps"], 2, F.greatest(F.size(parts["refs"]), F.lit(1))), lambda ref, gap: F.concat(plain(ref), gap))
        return F.concat(F.get(parts["gaps"], F.lit(0)), F.array_join(pairs, ""))

    split = lambda t: F.struct(F.split(t, pattern, -1).alias("gaps"), matches(t, pattern, 1).alias("refs"))
    return bound(c, lambda t: F.when(F.contains(t, F.lit("&")), bound(split(t), joined)).otherwise(t))


# fixed values: what the lines of a consent banner say
CONSENT = [
    r"(?i)\bcookies?\b", r"(?i)accept all\b", r"(?i)reject all\b", r"(?i)manage (?:preferences|choices|cookies|settings)", r"(?i)privacy (?:policy|preferences|choices)",
    r"(?i)tracking technolog", r"(?i)advertising partners", r"(?i)legitimate interest",
]


def without_consent_lines(text: Column) -> Column:
    """Lines of a consent banner out: two of its phrases, or one in a line of under 120 characters."""

    def banner(line: Column) -> Column:
        hits = sum((line.rlike(p).cast("int") for p in CONSENT), F.lit(0))
        return hits >= F.when(F.length(F.trim(line)) < 120, 1).otherwise(2)

    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~banner(line)), "\n")


def decode_markup(c: Column) -> Column:
    """``&lt;`` and ``&amp;``, in this order; any other reference stays as it is written."""
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def page_title(html: Column, decode: Callable[[Column], Column] = decode_entities) -> Column:
    """Text of the title on one line, its references read by ``decode``; null if there is none."""
    return F.nullif(F.trim(F.regexp_replace(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"[\t\n\f\r ]+", " ")), F.lit(""))


def meta_description(html: Column) -> Column:
    return F.nullif(decode_entities(F.regexp_extract(html, r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""", 1)), F.lit(""))


def canonical_link(html: Column) -> Column:
    """The address a page gives itself: of its canonical link, else of its og:url, the attributes in any order."""
    address = lambda tag: F.nullif(F.trim(F.regexp_extract(F.regexp_extract(html, tag, 0), r"""(?is)\b(?:href|content)=["']([^"']+)["']""", 1)), F.lit(""))
    return decode_entities(F.coalesce(address(r"""(?i)<link\b[^>]*\brel=["']?canonical["']?[^>]*>"""), address(r"""(?i)<meta\b[^>]*\bproperty=["']?og:url["']?[^>]*>""")))


def _encoded(c: Column) -> Column:
    """Percent-encoding of one query part: a blank is %20, and ! ' ( ) * ~ stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.``, no default port, trailing slash, fragment or tracking parameter; parameters are
    sorted by name, those of one name stay in order. What is no URL loses its fragment and one trailing slash."""
    url = F.trim(url)
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), domain_of(url)
    port = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    raw = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: p != "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    pairs = F.transform(raw, lambda p, i: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), plain(value(p)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    made = F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path, tail)
    return F.regexp_replace(F.coalesce(made, F.regexp_replace(url, "#.*$", "")), "/$", "")


def domain_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def markup_evidence(html: Column) -> Column:
    """The links a page's text does not show, as a block to keep with it: mail, phone and social addresses."""
    mail = F.transform(emails(F.lit(""), html), lambda e: F.concat(F.lit("mailto: "), e["value"]))
    tel = F.transform(phones(html), lambda p: F.concat(F.lit("tel: "), p))
    soc = F.transform(socials(html), lambda s: F.concat(F.lit("social: "), s))
    return F.array_join(F.concat(mail, tel, soc), "\n")


def same_origin_links(html: Column, base: Column) -> Column:
    """Absolute links of the same origin, fragments dropped, first of each: RFC 3986 resolution has no Spark built-in,
    so this one runs as an Arrow UDF."""


    @F.pandas_udf("array<string>")
    def links(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([_resolve_links(h, b) for h, b in zip(pages, bases, strict=True)])

    return links(html, base)


def _resolve_links(html: str | None, base: str | None) -> list[str]:
    from urllib.parse import urldefrag, urljoin, urlsplit

    try:
        b = urlsplit(base or "")
        origin = (b.scheme.lower(), (b.hostname or "").lower(), b.port)
    except ValueError:
        return []
    if not b.scheme or not b.netloc:
        return []
    out: dict[str, None] = {}
    for href in re.findall(r"""(?i)<a\b[^>]*\shref=["']([^"']+)["']""", html or ""):
        href = href.strip()
        if not href or href.startswith("#") or re.match(r"(?i)(?:mailto|tel|javascript|data):", href):
            continue
        try:
            url = urldefrag(urljoin(base, href)).url
            u = urlsplit(url)
            if (u.scheme.lower(), (u.hostname or "").lower(), u.port) == origin:
                out.setdefault(url)
        except ValueError:
            continue
    return list(out)
