"""Deliverables: flat CSV, JSON, Markdown report, HTML page, delta and privacy notes, run folders."""

from __future__ import annotations

import html
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom import files
from placeloom.functions import text
from placeloom.operators import score, summary
from placeloom.operators.diff import KINDS

# fixed values: the header of the flat file
CSV_HEADER = (
    "id name score fit fit_why angle category registry activity_code activity_scheme section company_activity_code company_section headcount_band "
    "company_headcount_band revenue revenue_currency revenue_year registry_id establishment_id registry_url registry_evidence registry_as_of is_head_office "
    "registered_since street postcode city insee_code lat lon website website_confidence emails contact_source phones socials officers is_hiring open_roles "
    "matched_roles role_filter oldest_open_role_days term_matches term_match_source ats cms last_content_at pages_read sources match_confidence"
).split()
LISTS = {"emails", "contact_source", "phones", "socials", "officers", "role_filter", "term_matches", "term_match_source", "ats"}


def tri_state(c: Column) -> Column:
    return F.when(c.eqNullSafe(True), "yes").when(c.eqNullSafe(False), "no").otherwise("")


def csv_frame(places: DataFrame, no_people: bool = False) -> DataFrame:
    """All columns of the header as text; lists joined by " | ", sources by "+", unknown is blank."""
    out = []
    for c in CSV_HEADER:
        if c not in places.columns or (no_people and c == "officers"):
            v = F.lit("")
        elif c in LISTS:
            v = F.array_join(F.col(c), " | ")
        elif c == "sources":
            v = F.array_join(F.col(c), "+")
        elif c in ("is_hiring", "is_head_office"):
            v = tri_state(F.col(c))
        elif c == "score":
            v = F.coalesce(F.col(c), F.lit(0)).cast("string")
        else:
            v = F.col(c).cast("string")
        out.append(F.coalesce(v, F.lit("")).alias(c))
    return places.select(*out)


def csv_lines(places: DataFrame, no_people: bool = False) -> DataFrame:
    return csv_frame(places, no_people).select(text.csv_row([F.col(c) for c in CSV_HEADER]).alias("line"))


def write_csv(places: DataFrame, path: str, no_people: bool = False) -> None:
    csv_frame(places, no_people).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json(places: DataFrame, path: str) -> None:
    places.write.mode("overwrite").json(path)


def without_people(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Officers and people emptied before anything is written, and how many went."""
    removed = places.agg(F.coalesce(F.sum(F.size("officers") + F.size("people")), F.lit(0)).cast("long").alias("removed"))
    empty = F.array().cast("array<string>")
    return places.withColumn("officers", empty).withColumn("people", empty), removed


def markdown_table(df: DataFrame, limit: int) -> str:
    """A bounded table; says how many more rows there are."""
    rows = df.limit(limit + 1).collect()
    more = df.count() - limit if len(rows) > limit else 0
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:limit]]
    return "\n".join(lines + ([f"\n... and {more} more"] if more > 0 else []))


def report(places: DataFrame, lanes: DataFrame, notes: DataFrame, title: str) -> str:
    """Banner, coverage, inventory, hiring, ranking and notes as Markdown."""
    totals = summary.lane_totals(lanes)
    cut = [r["lane"] for r in totals.where("truncated").collect()]
    n = places.count()
    parts = [f"# {title}", *([f"> **Truncated:** {', '.join(cut)}. Counts below are lower bounds."] if cut else [])]
    parts += ["## Coverage", summary.coverage_sentence(lanes).first()["coverage"], markdown_table(totals, 20)]
    hiring = summary.hiring_counts(places).first()
    parts += ["## Hiring", f"{hiring['hiring']} of {n} hire, {hiring['not_hiring']} do not, {hiring['unknown']} unknown; {hiring['open_roles']} open roles."]
    parts += inventory(places) + judged(places)
    parts += ["## Ranked", markdown_table(score.ranked(places).select("place_id", "name", "total", "fit"), 50)]
    parts += ["## Notes", markdown_table(summary.fold_notes(notes).select("text", "n"), 25)]
    said = [r["licence"] for r in licences(lanes).orderBy("licence").collect()] if {"connector", "lane"} <= set(lanes.columns) else []
    parts += ["## Sources", "\n".join(f"- {s}" for s in said)] if said else []
    return "\n\n".join(parts) + "\n"


def inventory(places: DataFrame) -> list[str]:
    """Reachability, websites, scores and activities in numbers; needs the columns of ``contact_counts``."""
    if not {"emails", "phones", "site_confidence", "cms", "has_pricing", "has_ecommerce", "page_count"} <= set(places.columns):
        return []
    c = summary.contact_counts(places).first()
    lines = [
        f"- **Contacts.** {c['with_any']} of {c['places']} have an e-mail address or a phone number, {c['with_both']} both",
        f"- **Websites.** {c['corroborated']} corroborated, {c['declared']} declared, {c['unverified']} unverified; {c['pages_read']} pages read",
        f"- **Sites.** {c['with_cms']} with a known content system, {c['with_pricing']} publish prices, {c['with_ecommerce']} sell online",
    ]
    parts = ["## Inventory", "\n".join(lines)]
    if "total" in places.columns:
        parts += ["### Score distribution", markdown_table(summary.score_histogram(places.sparkSession, places).select("band", "n"), 10)]
    return parts


def judged(places: DataFrame, most: int = 25) -> list[str]:
    """The verdicts that somebody wrote, word for word, best first, and how many places have none."""
    if not {"fit", "why", "angle"} <= set(places.columns):
        return []
    own = places.where("fit is not null")
    counts = {r["fit"]: r["count"] for r in own.groupBy("fit").count().collect()}
    n, total = sum(counts.values()), places.count()
    if not n:
        return []
    parts = [f"## Judged ({n} of {total})", " · ".join(f"{counts[f]} {f}" for f in ("strong", "possible", "weak", "no") if f in counts)]
    for r in score.ranked(own, limit=most).orderBy("rank").collect():
        parts += [f"### {r['rank']}. {r['name']} — {r['fit']} · {r['total']}"] + [f"**{k}.** {v}" for k, v in (("Why", r["why"]), ("Angle", r["angle"])) if v]
    return parts + ([f"…and {n - most} more verdicts in the flat file."] if n > most else []) + ([f"{total - n} companies have a measured score and no verdict yet."] if total > n else [])


# sort by a click on a heading, blanks last whichever way, and filter rows by a word
PAGE_SCRIPT = """<script>
const body = document.querySelector('tbody');
document.querySelectorAll('th').forEach((head, column) => head.onclick = () => {
  const down = head.dataset.down = head.dataset.down === '1' ? '' : '1', sign = down ? -1 : 1;
  const cell = (row) => row.cells[column].textContent.trim();
  const key = (row) => head.dataset.kind === 'number' ? parseFloat(cell(row)) : cell(row);
  const blank = (k) => k === '' || Number.isNaN(k);
  [...body.rows].sort((a, b) => { const x = key(a), y = key(b); return blank(x) || blank(y) ? blank(x) - blank(y) : sign * (x < y ? -1 : x > y ? 1 : 0); }).forEach((row) => body.append(row));
});
document.querySelector('input').oninput = (e) => [...body.rows].forEach((row) => row.hidden = !row.dataset.text.includes(e.target.value.toLowerCase()));
</script>"""


def html_page(places: DataFrame, title: str, limit: int = 2000) -> str:
    """One self-contained page: facets, a dot map and the ranked table, up to ``limit`` rows."""
    rows = score.ranked(places, limit=limit)
    e = rows.crossJoin(F.broadcast(summary.extent(places).withColumnRenamed("best", "best_total")))  # one row
    e = e.withColumn("xy", summary.project(F.col("lat"), F.col("lon"), F.col("south"), F.col("north"), F.col("west"), F.col("east")))
    line = F.concat(F.lit('<tr data-text="'), text.html_escape(F.lower("name")), F.lit('"><td>'), F.col("rank").cast("string"), F.lit("</td><td>"), text.html_escape(F.col("name")), F.lit("</td><td>"), F.coalesce("total", F.lit(0)).cast("string"), F.lit("</td></tr>"))
    dot = F.when(F.col("xy.x").isNotNull(), F.format_string('<circle cx="%.1f" cy="%.1f" r="3"/>', F.col("xy.x"), F.col("xy.y")))
    got = e.orderBy("rank").select(line.alias("line"), dot.alias("dot")).collect()
    facet = " ".join(f"<span>{r['facet']}: {r['n']}</span>" for r in summary.facets(places).collect())
    dots = "".join(r["dot"] or "" for r in got)
    title = html.escape(title)
    head = f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><p>{facet}</p><svg viewBox='0 0 800 600'>{dots}</svg>"
    heads = '<th data-kind="number">#</th><th>name</th><th data-kind="number">score</th>'
    return head + f"<input type=search><table><thead><tr>{heads}</tr></thead><tbody>" + "".join(r["line"] for r in got) + "</tbody></table>" + PAGE_SCRIPT


def delta_report(delta: DataFrame, truncated: bool = False) -> str:
    """The nine sections of a run-to-run delta, empty ones left out."""
    parts = ["# Changes"] + (["> A run was truncated: what is missing may only not have been seen."] if truncated else [])
    for kind in KINDS:
        rows = delta.where(F.col("delta_kind") == kind).select("key", "detail").orderBy("key")
        if not rows.isEmpty():
            parts += [f"## {kind}", markdown_table(rows, 50)]
    return "\n\n".join(parts) + "\n"


def privacy_note(places: DataFrame) -> str | None:
    """A note on personal data, only if there is any."""
    r = summary.privacy_counts(places).first()
    if not any(r[c] for c in ("officers", "people", "personal_emails")):
        return None
    return f"This folder holds personal data: {r['officers']} officers, {r['people']} people, {r['personal_emails']} personal-looking e-mail addresses.\n"


FACTS = [
    ("sources", "sources"), ("match confidence", "match_confidence"), ("category", "category"), ("register", "registry"), ("identifier", "registry_id"), ("establishment", "establishment_id"),
    ("legal name", "legal_name"), ("legal form", "legal_form"), ("register matched by", "registry_evidence"), ("AS OF", "registry_as_of"), ("activity", "activity_code"), ("section", "section"),
    ("activity of the company", "company_activity_code"), ("headcount", "headcount_band"), ("headcount of the company", "company_headcount_band"), ("registered since", "registered_since"),
    ("state", "status"), ("officers", "officers"), ("website", "website"), ("website confidence", "website_confidence"), ("e-mails", "emails"), ("phones", "phones"), ("profiles", "socials"),
    ("open roles", "open_roles"), ("oldest open role, days", "oldest_open_role_days"), ("boards", "ats"), ("content system", "cms"), ("newest content", "last_content_at"), ("pages read", "pages_read"), ("score", "score"),
]


def fact_sheet(places: DataFrame) -> DataFrame:
    """One text per place with the facts that are known: address, register, activity on both levels, money in the currency it was
    filed in, contacts and signals. What is unknown has no line; a place without a website says so. Columns are those of the flat file
    that the table has."""
    have = dict(places.dtypes)
    shown = lambda c: F.array_join(F.col(c), "; ") if have[c].startswith("array") else F.col(c).cast("string")
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"- {label}: "), c))
    lines = [F.concat(F.lit("# "), "name"), line("id", F.col("id").cast("string"))]
    if {"street", "postcode", "city"} <= set(have):
        lines.append(line("address", F.concat_ws(", ", *[F.nullif(F.trim(c), F.lit("")) for c in ("street", "postcode", "city")])))
    for label, c in FACTS:
        if c in have:
            lines.append(line(label, shown(c)))
            if c == "website":
                lines.append(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("- website: none found")))
    if {"revenue", "revenue_currency"} <= set(have):
        year = F.concat(F.lit(" ("), F.col("revenue_year").cast("string"), F.lit(")")) if "revenue_year" in have else F.lit("")
        lines.append(line("revenue", F.concat(text.money(F.col("revenue"), F.col("revenue_currency")), F.coalesce(year, F.lit("")))))
    return places.select("id", F.concat_ws("\n", *lines).alias("sheet"))


class Run:
    """A run folder on any file system: Parquet tables and a manifest that replaces its predecessor atomically."""

    def __init__(self, spark: SparkSession, root: str, name: str | None = None):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name or datetime.now(timezone.utc).strftime('%Y%m%dT%H%M%S')}"

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def manifest(self, **fields) -> dict:
        """Merge fields into the manifest; without any just read it."""
        where = f"{self.path}/manifest.json"
        held = json.loads(files.read_text(self.spark, where) or "{}") | fields
        if fields:
            files.replace_text(self.spark, where, json.dumps(held, indent=2, sort_keys=True))
        return held

    @staticmethod
    def newest(spark: SparkSession, root: str) -> str:
        """The newest run that has a manifest."""
        fs, p = files.filesystem(spark, root)
        runs = [s.getPath().toString() for s in fs.listStatus(p)]
        return max(r for r in runs if files.read_text(spark, f"{r}/manifest.json") is not None)


# fixed values: data licences by source
LICENCES = {
    "osm": "© OpenStreetMap contributors, ODbL",
    "no-brreg": "Norwegian company data: Enhetsregisteret, Brønnøysundregistrene, NLOD 2.0",
    "de-offeneregister": "German company data: OffeneRegister.de / OpenCorporates, CC-BY 4.0",
    "gb-companies-house": "UK company data: Companies House, Open Government Licence v3.0",
    "ee-ariregister": "Estonian company data: Äriregister / Registrite ja Infosüsteemide Keskus, open data",
}


def licences(lanes: DataFrame) -> DataFrame:
    """Licence lines of the sources a run used."""
    table = F.create_map(*[F.lit(x) for kv in LICENCES.items() for x in kv])
    return lanes.select(F.element_at(table, F.coalesce("connector", "lane")).alias("licence")).where("licence is not null").distinct()


def filters_in_words(runs: DataFrame) -> DataFrame:
    """Add ``said``, the filters of each run in words; only those that narrow it, and ceased companies only where they were kept, as
    leaving them out is the default. ``runs`` has the arrays osm_groups, activity_codes, sections, size_bands and registry_ids, a number max_results
    and a flag include_ceased, any of them null."""
    # fixed values: wording of a run's filters
    lists = [("osm_groups", "`, `", "OSM `", "` tags only"), ("activity_codes", ", ", "register activity codes ", ""), ("sections", ", ", "register sections ", ""), ("size_bands", ", ", "headcount bands ", "")]
    said = [F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.col(c).cast("array<string>"), sep), F.lit(tail))) for c, sep, head, tail in lists]
    said.append(F.when(F.size("registry_ids") > 0, F.concat(F.size("registry_ids").cast("string"), F.lit(" explicit register identifier(s)"))))
    said.append(F.when(F.col("max_results") > 0, F.concat(F.lit("capped at "), F.col("max_results").cast("string"), F.lit(" results"))))
    said.append(F.when(F.col("include_ceased"), F.lit("ceased companies included")))
    return runs.withColumn("said", F.array_compact(F.array(*said)))
