"""Name normalisation and similarity as Catalyst expressions; no Python runs on executors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.functions import dims


def _fold_table() -> tuple[str, str]:
    """Letters below U+0250 and in Latin Extended Additional whose canonical decomposition is a base letter and marks."""
    src, dst = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if base != chr(code) and len(base) == 1:
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _fold_table()


def fold(c: Column) -> Column:
    """Strip diacritics: composed Latin letters by table, combining marks U+0300-036F removed; ø, ß and ł stay."""
    return F.translate(F.regexp_replace(c, "[̀-ͯ]", ""), _FROM, _TO)


def normalize_name(c: Column) -> Column:
    """Fold, lower, non-alphanumerics to spaces, legal forms out, spaces collapsed."""
    plain = F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\b(?:{dims.LEGAL_FORMS})\b", " "), r"\s+", " "))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) > 1))


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def contained(ta: Column, tb: Column) -> Column:
    """The smaller token set lies in the larger and has two tokens or one long token that is no trade word."""
    small = F.when(F.size(ta) <= F.size(tb), ta).otherwise(tb)
    large = F.when(F.size(ta) <= F.size(tb), tb).otherwise(ta)
    only = F.get(small, F.lit(0))
    telling = (F.size(small) >= 2) | ((F.length(only) >= 6) & ~only.isin(dims.TRADE_WORDS))
    return (F.size(ta) > 0) & (F.size(tb) > 0) & (F.size(F.array_except(small, large)) == 0) & telling


def name_variants(c: Column) -> Column:
    """The name, the name outside parentheses, and each part inside them."""
    outside = F.trim(F.regexp_replace(c, r"\([^)]*\)", " "))
    inside = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda p: F.transform(F.split(p, "[,;]"), lambda x: F.trim(x))))
    return F.filter(F.array_distinct(F.concat(F.array(c), F.array(outside), inside)), lambda v: v.isNotNull() & (v != ""))


def name_forms(c: Column) -> Column:
    """Per distinct normalised variant: the text, its tokens and its trigrams. Built once per row, not per pair."""
    norm = F.filter(F.array_distinct(F.transform(name_variants(c), normalize_name)), lambda v: v != "")
    return F.transform(norm, lambda v: F.struct(v.alias("n"), token_set(v).alias("t"), trigrams(v).alias("g")))


def forms_similarity(fa: Column, fb: Column) -> Column:
    """Best of equality 1, containment 0.88, token Jaccard and trigram Jaccard over all pairs of forms; 0 if none."""

    def pair(a: Column, b: Column) -> Column:
        rest = F.greatest(F.when(contained(a["t"], b["t"]), F.lit(0.88)).otherwise(F.lit(0.0)), jaccard(a["t"], b["t"]), jaccard(a["g"], b["g"]))
        return F.when(a["n"] == b["n"], F.lit(1.0)).otherwise(rest)

    best = F.array_max(F.flatten(F.transform(fa, lambda a: F.transform(fb, lambda b: pair(a, b)))))
    return F.coalesce(best, F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    return forms_similarity(name_forms(a), name_forms(b))


def street_key(street: Column, kind: Column | None = None) -> Column:
    """Street name without its type word, articles and punctuation. The articles go after the type word, so a street
    whose type stands in ``kind`` and one that begins with it compare equal."""
    whole = street if kind is None else F.when(kind.isNull() | (kind == ""), street).otherwise(F.concat_ws(" ", kind, street))
    low = F.regexp_replace(F.lower(fold(whole)), rf"^(?:{dims.STREET_TYPES})\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, dims.STREET_ARTICLES, " "), "[^a-z0-9]+", " "))


def same_street(a: Column, b: Column, b_kind: Column | None = None) -> Column:
    ka, kb = street_key(a), street_key(b, b_kind)
    return F.coalesce((F.length(ka) > 2) & (ka == kb) & (a != "") & (b != ""), F.lit(False))


def street_line(number: Column, kind: Column, name: Column) -> Column:
    """Number, type and name in one line; the type once, a number alone not at all."""
    k, n = F.nullif(F.trim(kind), F.lit("")), F.nullif(F.trim(name), F.lit(""))
    num = F.nullif(number, F.lit(""))
    doubled = F.lower(n).startswith(F.lower(k)) & ~F.substr(n, F.length(k) + 1, F.lit(1)).rlike("^[A-Za-z0-9_]")
    full = F.concat_ws(" ", num, F.when(F.coalesce(doubled, F.lit(False)), F.lit(None)).otherwise(k), n)
    return F.when(n.isNotNull(), full).when(k.isNotNull(), F.concat_ws(" ", num, k)).otherwise("")


def slug(c: Column) -> Column:
    """Folded key: everything but letters, digits, dot, underscore and dash becomes one dash; ends are trimmed. The whole
    text counts, however long; a text without such characters has the empty key, which finds nothing."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def first_text(*columns: Column) -> Column:
    """First value that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def short_label(c: Column) -> Column:
    head = F.trim(F.get(F.split(c, ","), F.lit(0)))
    return F.when(F.length(head) > 1, head).otherwise(c)


def search_form(c: Column) -> Column:
    """Folded, lower, without separators that phone numbers and addresses are written with."""
    return F.regexp_replace(F.lower(fold(c)), r"[\s.()-]", "")


def id_form(c: Column) -> Column:
    """A legal identifier without any separator."""
    return F.regexp_replace(F.lower(c), "[\\s.()‐-―:/, -]", "")


def file_safe(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_")


def csv_field(c: Column) -> Column:
    """RFC 4180 field: quoted when it holds a comma, quote or line end; null is empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_row(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in columns])


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def html_escape(c: Column) -> Column:
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;"))
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


# fixed values: signs of currencies that English text has one for; others are written with their code
CURRENCY_SIGNS = {
    "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CAD": "CA$", "AUD": "A$", "NZD": "NZ$", "HKD": "HK$", "MXN": "MX$", "BRL": "R$", "CNY": "CN¥", "INR": "₹", "KRW": "₩",
    "ILS": "₪", "TWD": "NT$", "VND": "₫", "PHP": "₱", "XAF": "FCFA",
}


def money(n: Column, currency: Column) -> Column:
    """Whole amounts with thousands marks and the sign or code of the currency they were filed in; without one the bare number."""
    amount = F.format_number(F.floor(F.abs(n) + 0.5).cast("long"), 0)
    minus = F.when(n <= -0.5, "-").otherwise("")
    signs = F.create_map(*[F.lit(x) for kv in CURRENCY_SIGNS.items() for x in kv])
    code = F.upper(currency)
    head = F.coalesce(F.element_at(signs, code), F.concat(code, F.lit("\u00a0")))
    return F.when(F.coalesce(currency, F.lit("")) == "", F.concat(minus, amount)).otherwise(F.concat(minus, head, amount))


def parse_distance_m(c: Column) -> Column:
    """``800``, ``2km``, ``1,5 km`` -> whole metres; null if malformed or not above zero."""
    number = F.regexp_extract(c, r"(?i)^\s*([0-9]+(?:[.,][0-9]+)?)\s*(m|km)?\s*$", 1)
    unit = F.lower(F.regexp_extract(c, r"(?i)^\s*([0-9]+(?:[.,][0-9]+)?)\s*(m|km)?\s*$", 2))
    value = F.replace(F.nullif(number, F.lit("")), F.lit(","), F.lit(".")).cast("double")
    return F.when(value > 0, F.floor(F.when(unit == "km", value * 1000).otherwise(value) + 0.5).cast("long"))


def parse_bbox(c: Column) -> Column:
    """``south,west,north,east`` -> [south, north, west, east]; null unless four numbers in order."""
    v = F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double"))
    ok = (F.size(v) == 4) & (F.get(v, F.lit(0)) < F.get(v, F.lit(2))) & (F.get(v, F.lit(1)) < F.get(v, F.lit(3)))
    return F.when(ok, F.array(F.get(v, F.lit(0)), F.get(v, F.lit(2)), F.get(v, F.lit(1)), F.get(v, F.lit(3))))


def clamp_int(c: Column, low: int, high: int, fallback: int) -> Column:
    n = F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d{1,15})", 1)
    return F.when(n == "", F.lit(fallback)).otherwise(F.least(F.lit(high).cast("long"), F.greatest(F.lit(low).cast("long"), n.try_cast("long")))).cast("long")
