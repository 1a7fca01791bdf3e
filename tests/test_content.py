import re
import time

import pytest
from pyspark.sql import functions as F

from placeloom.functions import extract
from placeloom.operators import content

# what the plans must equal, tag by tag ------------------------------------------------------------------------------------


def visible(html, spaced):
    words = re.sub(r"(?s)<[^>]+>", " ", html).split()
    return len(" ".join(words)) if spaced else sum(map(len, words))


def plainly(html, rule):
    tags = list(re.finditer(content.BLOCK, html))
    for tier in rule.tiers:
        found = []
        for k, m in enumerate(tags):
            if not m[0].startswith("</") and re.search(tier, m[0]):
                name, depth, end = re.match(r"<(\w+)", m[0])[1].lower(), 1, len(html) if rule.open_ended else None
                for t in tags[k + 1 :]:
                    if re.match(r"</?(\w+)", t[0])[1].lower() == name:
                        depth += -1 if t[0].startswith("</") else 1
                        if not depth:
                            end = t.start()
                            break
                if end is not None:
                    found.append(html[m.end() : end])
        if found:
            best = max(found, key=lambda x: visible(x, rule.spaced))
            if rule.weak and visible(best, rule.spaced) < rule.weak[0] and visible(best, rule.spaced) < rule.weak[1] * visible(html, rule.spaced):
                return html
            return best
    body = re.search(r"(?is)<body[^>]*>(.*?)(?:</body>|$)", html) if rule.body else None
    return body[1] if body else html


PAGES = [
    "<main>a <main>b</main> c</main> d", "</main></div><main>x</main></main>", "<article>one</article><article>three two</article><MAIN>m</MAIN >", "<main>never closed <p>text", "no tags", "", "<body class=x>b<div>c</div></body>",
    "<div class=\"content\">a<div>b</div>c</div><section id='main' role=\"main\">zz</section>", "<div role='main'>r<div>s</div></div><article>longer than that</article>", "<article><div></article></div>after", "<section class=\"prose x\">" + "w " * 400 + "</section>tail",
    "<article>tiny</article>" + "word " * 50, "<main><!-- a > b --> x</main>", "<main\n id='y'>multi\nline</main\n>", "<article><article></article>e</article>", "<mainly>not main</mainly><main>is</main>",
]


@pytest.mark.parametrize("rule", [content.LARGEST, content.NAMED], ids=["largest", "named"])
def test_main_content(spark, rule):
    pages = spark.createDataFrame([(i, p) for i, p in enumerate(PAGES + PAGES[:3])] + [(99, None)], "content int, html string")
    got = {r["content"]: r["main_html"] for r in content.with_main(pages, "html", rule).collect()}
    assert len(got) == len(PAGES) + 4 and got.pop(99) is None
    for i, p in enumerate(PAGES + PAGES[:3]):
        assert got[i] == plainly(p, rule), p


def test_random_nesting(spark):
    import random

    g = random.Random(4)
    parts = ["<main>", "</main>", "<article class='a'>", "</article>", "<div>", "</div>", '<div class="post">', "<section role='main'>", "</section>", "word ", "<p>", " two  words ", "<br/>", "&amp;"]
    rows = [(i, "".join(g.choice(parts) for _ in range(g.randint(0, 40)))) for i in range(400)]
    pages = spark.createDataFrame(rows, "k int, html string")
    for rule in (content.LARGEST, content.NAMED):
        got = {r["k"]: r["main_html"] for r in content.with_main(pages, "html", rule).collect()}
        assert all(got[k] == plainly(html, rule) for k, html in rows)


def test_linear_in_tags_and_entities(spark):
    deep = spark.range(1).select(F.concat(F.repeat(F.lit("<article>a "), 20_000), F.repeat(F.lit("</article>"), 20_000)).alias("html"))
    many = spark.range(1).select(F.concat(F.lit("<p>"), F.repeat(F.lit("a &amp; &#98; "), 100_000)).alias("html"))
    began = time.perf_counter()
    assert content.with_main(deep, "html").select(F.length("main_html")).first()[0] == 20_000 * 21 - 19
    assert many.select(F.length(extract.html_to_text(F.col("html")))).first()[0] == 600_000 - 1
    assert many.select(F.length(extract.readable_text(F.col("html")))).first()[0] == 600_000 - 1
    assert time.perf_counter() - began < 40


def test_one_shuffle_of_the_tags(spark):
    pages = spark.createDataFrame([(1, "<main>a</main>")], "k int, html string")
    plan = content.main_spans(pages, "html", content.NAMED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Python" not in plan


def test_readable_text(value):
    html = "<header>h</header><head><title>t</title></head><nav>n</nav><h2 class='x'>A&nbsp;b</h2><p>c<br>d<hr/>e <b>f</b></p><table><tr><td>1</td><td>2</td></tr></table><!-- x --><footer>z</footer>&unknown; &#x41;"
    assert value(extract.readable_text(F.lit(html))).split("\n") == ["## A b", "c", "d", "e f", "1", "2", "&unknown; A"]
    assert value(extract.readable_text(F.lit(""))) == "" and value(extract.readable_text(F.lit(None).cast("string"))) is None


def test_canonical_address(value):
    link = lambda html: value(extract.canonical_link(F.lit(html)))
    assert link('<link href="https://x.fr/?a&amp;b" rel=canonical>') == "https://x.fr/?a&b"
    assert link('<link rel="icon" href="i"><meta property="og:url" content=" https://y.fr ">') == "https://y.fr"
    assert link("<p>") is None


def test_consent_lines(value):
    text = "We value your privacy: cookies and advertising partners " + "x" * 120 + "\nAccept all\nA long line that only mentions cookies once " + "y" * 120
    assert value(extract.without_consent_lines(F.lit(text))).startswith("A long line")
