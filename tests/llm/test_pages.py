"""The site style tree against a plain version, and on odd pages."""

from __future__ import annotations

import math
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from taxaspark.llm import sitetree


def alone(html):
    return sitetree.main_text(html, set(), set(), 0.3)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a &lt;b&gt;&#233; <b>c</b><br>d<p>e", "a <b>é c d\n\ne"),
        ("<nav>n</nav><article><header><h1>T</h1></header><p>x<script>if (a<b) '</p>'</script>y</p><div class='ad'>z</div><section id=comments>c</section></article><footer>f", "T\n\nxy"),
        ("<main><ul><li>a<li>b</ul><form>q</form><table><tr><td>1<td>2</table></main>", "a\n\nb\n\n1\n\n2"),
        ("<article><p>1 < 2 & 3</p><!-- x --><aside>s</aside><blockquote>q</blockquote></article>", "1 < 2 & 3\n\nq"),
        ("<div class='site-header'>s</div><div>main text and a <a href='x>y'>link</a></div><div role=navigation>n</div>", "main text and a link"),
        ("</p></div><p>stray</i></p>", "stray"),
        ("<div class='content with-sidebar'><p>Main text</p></div>", "Main text"),
        ("<div id='page' class='has-header'><p>Main text</p></div>", "Main text"),
        ("<main><div class='social-history'>Of the guilds</div><p>and of the towns they stood in</p></main>", "Of the guilds\n\nand of the towns they stood in"),
        ("<p>A lead before it.</p><article><h1>T</h1><p>and the story itself, which is longer</p></article>", "A lead before it.\n\nT\n\nand the story itself, which is longer"),
        ("<div>Story in a plain element, long enough.</div><article class=card>Teaser</article>", "Story in a plain element, long enough.\n\nTeaser"),
        ("<p>a<b", "a"),
        ("<article><p>If <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> holds</p></article>", "If x=2 holds"),
        ("<article><p>Shown</p><div style='display: none'><p>hidden part</p></div><p>end</p></article><div style='display:none'>menu</div>", "Shown\n\nhidden part\n\nend"),
        ("<article><p>Hear <audio src=x>a song</audio> and <object data=y>a picture</object></p></article>", "Hear a song and a picture"),
        ("<article>" + "<b>" * 100 + "in" + "</i>" * 3 + "</b>" * 100 + "<p>out</p></article>", "in\n\nout"),
        ("<article><ul><li>" + "<span>" * 100 + "a<li>b</ul></article>", "a\n\nb"),
        ("<p title=\"x>y\" class=a'>b</p>", "b"),
    ],
)
def test_one_page(html, text):
    assert alone(html) == text


ODD = {
    "deep": "<div>x" * 100_000, "name": "<" + "a" * 1_000_000, "open": "<a " * 300_000, "attribute": "<a b=" * 200_000 + ">", "quote": '<a b="' * 200_000, "inline": "<i>" + "<b>" * 50_000 + "</i>" * 50_000,
    "items": "<ul><li>x" * 50_000, "signs": "<" * 500_000, "closing": "</div>" * 200_000, "scripts": "<script>" * 100_000, "comments": "<!--" * 100_000, "blocks": "<p>x" * 50_000,
}


@pytest.mark.parametrize("name", sorted(ODD))
def test_time_grows_with_the_length(name):
    def took(page):
        began = time.perf_counter()
        sitetree.merge(sitetree.parse(page))
        return time.perf_counter() - began

    page = ODD[name]
    half = took(page[: len(page) // 2])
    assert took(page) < 4 * half + 1


def test_deep_text_is_kept():
    assert alone("<div>x" * 5000).count("x") == 5000


def site(pages):
    """{path: importance} of one host's pages, by plain recursion."""
    merged = [sitetree.merge(sitetree.parse(p)) for p in sorted(set(pages))]
    paths = defaultdict(list)
    for page in merged:
        for path, m in page.items():
            paths[path].append((page, m))
    children = defaultdict(set)
    for path, found in paths.items():
        if found[0][1].node.above:
            children[found[0][1].node.parent].add(path)

    def importance(path):
        found = paths[path]
        n = len(found)
        styles = Counter(frozenset(m.shapes) for _, m in found)
        entropy = -sum(k / n * math.log(k / n) for k in styles.values()) / math.log(n) if n > 1 else 1.0
        parts = [(len(paths[c]), importance(c)) for c in children[path]]
        blocks = Counter(x for _, m in found for x in m.contents)
        if blocks:
            recurring = sum(k * math.log(k) for k in blocks.values()) / sum(blocks.values()) / math.log(max(2, n))
            linked = sum(m.links / max(1, m.chars) for _, m in found) / n
            parts.append((n, (1 - recurring) * (1 - 0.8 * linked)))
        mean = sum(w * x for w, x in parts) / sum(w for w, _ in parts) if parts else 0.0
        keep = 0.9 ** len(styles)
        return (1 - keep) * entropy + keep * mean

    return {p: importance(p) for p in paths}


def test_importances_equal_a_plain_version(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    extra = spark.createDataFrame([(-k, "http://h.example/", f"<div class=x{k % 2}><p>Same</p><ul>{'<li>a' * (k % 4)}</ul></div><p>Own {k // 2}</p>") for k in range(12)], df.schema)
    host = F.regexp_extract("url", "//([^/:?#]*)", 1)
    pages = df.unionByName(extra).select(host.alias("host"), "html", F.xxhash64("html").alias("page_digest"))
    got = defaultdict(dict)
    for r in sitetree.importances(sitetree.site_tree(sitetree.page_nodes(pages.union(pages)))).collect():
        got[r["host"]][r["path"]] = r["importance"]
    given = defaultdict(list)
    for r in pages.collect():
        given[r["host"]].append(r["html"])
    assert set(got) == set(given)
    for h, pages in given.items():
        assert got[h] == pytest.approx(site(pages))


@pytest.fixture(scope="module")
def planted():
    """Pages whose menu, notice and byline have no words that give them away."""
    page = "<div class=q><div class=x><a href=/a>Same words</a> <a href=/b>on all pages</a></div><div class=y><h2>Own head {0}</h2><p>Own words {0} here, and more of them</p></div><div class=z>The same line everywhere</div></div>"
    return [(k, f"https://h.example/{k}", page.format(k)) for k in range(20)]


def test_site_tree(spark, planted):
    page = planted[0][2]
    rows = [*planted, (99, "https://other.example/", page), (100, None, None), (101, None, ""), planted[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("low", F.lit(1)).withColumn("nodes", F.lit(2)).withColumn("page_digest", F.lit(3))
    got = sorted((r["page_id"], r["text"]) for r in sitetree.extract(df).collect())
    own = lambda k: f"Own head {k}\n\nOwn words {k} here, and more of them"
    want = [(k, own(k)) for k in [*range(20), 3]] + [(99, f"Same words on all pages\n\n{own(0)}\n\nThe same line everywhere"), (100, ""), (101, "")]
    assert got == sorted(want)
    off = {r["page_id"]: r["text"] for r in sitetree.extract(df, min_pages=10**9).collect()}
    assert all("everywhere" in off[k] for k in range(20))
    assert sitetree.extract(df.filter("false")).count() == 0
    assert sitetree.extract(df.filter("html is null")).select("text").collect() == [("",)]


def test_the_tree_alone_finds_the_menus_of_given_hosts(spark, small, monkeypatch):
    """With what elements say of themselves switched off."""
    monkeypatch.setattr(sitetree, "WEIGHTS", ((1.0, 1.0),) * 4)
    df = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/pages.parquet")
    host = F.regexp_extract("url", "//([^/:?#]*)", 1)
    tree = sitetree.importances(sitetree.site_tree(sitetree.page_nodes(df.select(host.alias("host"), "html", F.xxhash64("html").alias("page_digest")))))
    rows = tree.filter("m >= 20 and depth = 3").collect()
    assert min(r["importance"] + r["share"] for r in rows if r["own"]) > 0.7
    assert sum(r["importance"] + r["share"] < 0.3 for r in rows) >= len({r["host"] for r in rows})


def test_pages_are_cut_by_bytes(spark, planted, monkeypatch):
    df = spark.createDataFrame(planted, "page_id long, url string, html string")
    whole = sorted(sitetree.extract(df).collect())
    assert sorted(sitetree.extract(df.repartition(7)).collect()) == whole
