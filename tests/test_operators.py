"""Operators on small hand-written tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaspark.functions import exprs, keys
from taxaspark.operators import catalog, corpora, fulltext, projection, taxonomy, vectors
from taxaspark.plans import fusion, search, similarity
from taxaspark.sources import tables
from taxaspark.sources.keyed import KeyedTable
from taxaspark.streaming.ingest import stream_ingest

SPECIMENS = [
    ("img1", "Danaus plexippus", "Monarch", "female", "adult", "dorsal", 34.0522, -118.2437),
    ("img2", "Danaus plexippus plexippus", "Monarch", "male", "adult", "ventral", 34.0525, -118.2439),
    ("img3", "Danaus plexippus Linnaeus", "Monarch", None, "larva", "dorsal", 34.0521, -118.2435),
    ("img4", "Coenonympha pamphilus", "Small Heath", "male", "adult", "dorsal", 51.5074, -0.1278),
    ("img5", "Coenonympha pamphilus", "Small Heath", "male", "adult", "ventral", 51.5075, -0.1279),
    ("img6", "Coenonympha pamphilus", "Small Heath", "male", "pupa", "dorsal", 51.5076, -0.1280),
]


@pytest.fixture(scope="module")
def meta(spark):
    df = spark.createDataFrame(SPECIMENS, "img_id string, species string, common_name string, sex string, life_stage string, class_dv string, lat double, lon double")
    fixed = {"family": "Nymphalidae", "kingdom": "Animalia", "phylum": "Arthropoda", "class": "Insecta", "order": "Lepidoptera", "source_db": "GBIF"}
    return df.withColumns({k: F.lit(v) for k, v in fixed.items()})


def ids(df, column="img_id"):
    return [r[column] for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_search_folds_names(meta):
    found = search.search_catalog(meta, "danaus plexippus")
    rows = found.species.collect()
    assert [(r["species"], r["score"]) for r in rows] == [("danaus_plexippus", 1.0)]
    assert found.total.first()["n"] == 3
    assert len(found.specimens.collect()) == 3


def test_search_field_is_substring(meta):
    assert search.search_catalog(meta, "male", "sex").total.first()["n"] == 5


def test_pages_are_disjoint_and_cover(meta):
    pages = [ids(search.search_catalog(meta, "coenonympha pamphilus", page=p, limit=2).specimens) for p in (1, 2, 3)]
    assert list(map(len, pages)) == [2, 1, 0]
    assert sorted(sum(pages, [])) == ["img4", "img5", "img6"]


def test_search_by_point(meta):
    assert ids(search.search_catalog(meta, "34.0522, -118.2437", "coordinate").specimens) == ["img1", "img2", "img3"]
    assert search.search_catalog(meta, "95.0, -118.2437", "coordinate").total.first()["n"] == 0


def test_backslash_and_percent_in_query(meta):
    assert search.search_catalog(meta, "a\\b", "species").total.first()["n"] == 0
    assert search.search_catalog(meta, "dan%plex", "species").total.first()["n"] == 3


@pytest.mark.parametrize(("name", "key"), [("Danaus plexippus Linnaeus", "danaus_plexippus"), (" Danaus_plexippus ", "danaus_plexippus"), ("Danaus", "danaus"), ("", "")])
def test_binomial_key(spark, name, key):
    assert one(spark, keys.binomial_key(F.lit(name))) == key


def test_keys_differ(spark):
    assert one(spark, keys.underscore_key(F.lit("A b"))) == "a_b"
    assert one(spark, keys.squeezed_key(F.lit("A_b c"))) == "ab c"
    assert one(spark, keys.squeezed_query(F.lit(" A_b c "))) == "abc"
    assert one(spark, keys.image_id(F.lit("/x/y/img.1.png"))) == "img.1"
    assert one(spark, keys.parent_folder(F.lit("/x/y/img.png"))) == "y"
    assert one(spark, keys.folder_name(F.lit("danaus_PLEXIPPUS"))) == "Danaus plexippus"


@pytest.mark.parametrize(("text", "out"), [("a &amp; b", "a & b"), ("&#233;t&#xE9;", "été"), ("&amp;lt;", "&lt;"), ("plain", "plain"), ("&#128512;", "😀")])
def test_entities(spark, text, out):
    assert one(spark, exprs.decode_entities(F.lit(text))) == out


def test_small_functions(spark):
    assert one(spark, exprs.parse_coordinate(F.lit("34.05; -118.2"))).lat == 34.05
    assert one(spark, exprs.parse_coordinate(F.lit("95, 0"))) is None
    assert one(spark, exprs.match_percent(F.lit(0.256), distance=True)) == 74
    assert one(spark, exprs.author_case(F.lit("jean-luc picard"))) == "Jean-Luc Picard"
    assert one(spark, exprs.doi_url(F.lit("10.1/x"))) == "https://doi.org/10.1/x"
    assert one(spark, exprs.gene_category(F.lit("protein_coding rna"))) == "protein"
    assert one(spark, exprs.gene_type_label(F.lit("PROTEIN_CODING"))) == "Protein Coding"
    assert one(spark, exprs.code_label(F.lit("U"), exprs.VOLTINISM)) == "Univoltine"
    assert one(spark, exprs.code_label(F.lit("lc"), exprs.RED_LIST)) == "Least Concern"
    assert one(spark, exprs.highlight(F.lit("A (b) A"), "(B)", F.lit(True))) == "A <mark>(b)</mark> A"
    assert one(spark, exprs.family_list(F.lit("a, b ,,c"))) == ["a", "b", "c"]


def test_trait_decode(spark):
    df = spark.createDataFrame([("1.5", "NA", "1"), ("x", "1.0", "2"), (None, "7", "")], "w string, n string, Jan string")
    out = taxonomy.decode_traits(df, doubles=["w"], ints=["n"])
    assert [tuple(r) for r in out.collect()] == [(1.5, None, "Present"), (None, None, "Unknown"), (None, 7, None)]


def test_classify_and_profile(spark):
    tax = spark.createDataFrame([(1, *"KPCOFG", "Danaus plexippus", "L.", "Monarch", None, "ACCEPTED")], "key long, kingdom string, phylum string, class string, order string, family string, genus string, species string, authorship string, vernacularName string, redlistCategory string, taxonomicStatus string")
    assert taxonomy.classify(tax, "danaus_plexippus").first()["matchedCategory"] == "species"
    assert taxonomy.classify(tax, "f", "genus").count() == 0
    record = taxonomy.taxonomy_record(tax).first()
    assert (record["redlistCategory"], record["taxonomicStatus"]) == ("Unknown", "Accepted")
    traits = spark.createDataFrame([("danaus plexippus", "High")], "species string, CanopyAffinity string")
    profile = taxonomy.species_profile(tax, traits, name="Danaus_plexippus")
    text = profile.select(taxonomy.profile_text(["family"], ["CanopyAffinity"]).alias("t")).first()["t"]
    assert "- Family: F" in text and "- Canopyaffinity: High" in text


@pytest.fixture(scope="module")
def items(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [-1.0, 0.0]), ("z", [0.0, 0.0])]
    return spark.createDataFrame(rows, "img_id string, embedding array<float>")


@pytest.fixture(scope="module")
def item_meta(spark):
    rows = [("a", "sp_one", "x", "dorsal"), ("b", "sp_two", "x", "dorsal"), ("c", "sp_two", "x", "ventral"), ("d", "sp_three", "x", "dorsal"), ("z", None, "x", "dorsal")]
    return spark.createDataFrame(rows, "img_id string, species string, source_db string, class_dv string")


def test_vector_search(spark, items):
    out = {r["imgId"]: r["distance"] for r in vectors.vector_search(items, [1.0, 0.0], k=5).collect()}
    assert out["a"] == pytest.approx(0) and out["c"] == pytest.approx(1) and out["d"] == pytest.approx(2) and out["z"] == 1
    near = vectors.vector_search(items, [1.0, 0.0], k=3, max_distance=0.5)
    assert sorted(ids(near, "imgId")) == ["a", "b"]
    only = spark.createDataFrame([("d",)], "img_id string")
    assert ids(vectors.vector_search(items, [1.0, 0.0], within=only), "imgId") == ["d"]
    assert vectors.vector_search(items, [1.0, 0.0], within=only.filter("false")).count() == 0


def test_batch_top_k_equals_single(spark, items):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query long, centroid array<double>")
    for block in (1, 10):
        out = vectors.batch_top_k(queries, items, k=2, block=block)
        got = {(r["query"], r["rank"]): r["imgId"] for r in out.collect()}
        assert got == {(1, 1): "a", (1, 2): "b", (2, 1): "c", (2, 2): "b"}
    assert vectors.batch_top_k(queries.filter("false"), items, k=2).count() == 0


def test_similarity_table(spark, items, item_meta):
    table = similarity.build_similarity(items, item_meta, k=5)
    own = [(r["similar_species"], r["img_id"], r["rank"]) for r in table.filter("species = 'sp_one'").orderBy("rank").collect()]
    assert own == [("sp_two", "b", 1), ("sp_three", "d", 2)]
    found = similarity.similar_lookup(table, " SP one ").first()
    assert [x["species"] for x in found["dorsal"]] == ["sp_two", "sp_three"] and found["ventral"] == []
    assert similarity.similar_lookup(table, "nobody").count() == 0
    names = spark.createDataFrame([("sp one",), ("sp_three",)], "species string")
    both = similarity.similar_many(table.filter("species = 'sp_one'"), item_meta, items, names, k=5)
    assert {r["species"] for r in both.collect()} == {"sp_one", "sp_three"}
    assert similarity.verify_similarity(table).filter("side is null").first()["n"] == table.count()


def test_encoder_skips(spark):
    df = spark.createDataFrame([("a", "12"), ("b", ""), ("c", "3")], "img_id string, t string")
    make = lambda: lambda xs: [[float(len(x)), 0.0] if x else None for x in xs]
    out = {r["img_id"]: r["embedding"] for r in vectors.embed_column(df, "t", make, 2).collect()}
    assert out == {"a": [1.0, 0.0], "c": [1.0, 0.0]}


def test_best_per_species(spark):
    df = spark.createDataFrame([("a", "i1", 0.5), ("a", "i2", 0.3), ("b", "i3", 0.1)], "species string, imgId string, distance double")
    assert sorted((r["species"], r["distance"]) for r in vectors.best_per_species(df).collect()) == [("a", 0.3), ("b", 0.1)]


def tool(spark, name, kind, rows):
    return fusion.Tool(name, kind, spark.createDataFrame(rows, "imgId string, species string, score double"))


def test_fusion(spark):
    rank = tool(spark, "text", "ranking", [("1", "a", 1.0), ("2", "b", 0.5)])
    keep = tool(spark, "place", "filter", [("9", "b", 1.0), ("8", "c", 1.0)])
    out = fusion.fused_search([rank, keep]).collect()
    assert [(r["species"], r["imgId"], r["score"]) for r in out] == [("b", "2", 0.35)]
    assert fusion.fused_search([rank, tool(spark, "none", "filter", [])]).count() == 0
    failed = fusion.Tool("broken", "filter", None, failed=True)
    assert fusion.fused_search([rank, failed]) is None
    assert [r["species"] for r in fusion.fused_search([rank]).collect()] == ["a", "b"]
    twice = tool(spark, "place", "filter", [("9", "b", 1.0), ("8", "b", 1.0)])
    assert fusion.fused_search([twice]).first()["score"] == 1.0


def test_fusion_penalties(spark):
    score = lambda *tools: {r["species"]: (r["score"], r["tool_names"]) for r in fusion.fused_search(list(tools)).collect()}
    place = tool(spark, "loc", "filter", [("9", "a", 1.0), ("8", "c", 1.0)])
    assert score(tool(spark, "text", "ranking", [("1", "a", 0.9)]), place) == {"a": (0.75, ["text"])}
    text = tool(spark, "text", "ranking", [("1", "a", 0.9)])
    assert score(text, tool(spark, "image", "ranking", [])) == {"a": (0.45, ["text"])}
    other = tool(spark, "image", "ranking", [("5", "b", 1.0), ("4", "a", 0.2)])
    assert score(text, other, tool(spark, "loc", "filter", [("9", "a", 1.0)])) == {"a": (0.4, ["image", "text"])}
    assert score(text, tool(spark, "loc", "filter", [("9", "b", 1.0)])) == {}
    assert score(tool(spark, "text", "ranking", []), place) == {}
    assert score(place, tool(spark, "traits", "filter", [("7", "c", 1.0)])) == {"c": (1.0, ["loc", "traits"])}
    failed = fusion.Tool("text", "ranking", None, failed=True)
    assert fusion.fused_search([failed, place]) is None and score(failed, other) == {"a": (0.1, ["image"]), "b": (0.5, ["image"])}


def test_search_arguments(spark, meta):
    total = lambda *a: search.search_catalog(meta, *a).total.first()["n"]
    assert total("monarch", "Common Name") == 3 and total("monarch", "no such field") == 3 and total("monarch", "family") == 0
    assert total("  ") == 0 and total("", "coordinate") == 0 and total("95.0, -118.2437", "coordinate") == 0
    assert total("34.0522;-118.2437", "coordinate") == 3 and total("34.0522", "coordinate") == 0 and total("3d, 4e1", "coordinate") == 0


def test_batch_top_k_equals_a_full_sort(spark):
    r = random.Random(1)
    rows = [(k, [float(r.randint(-2, 2)) for _ in range(3)]) for k in range(400)]
    items = spark.createDataFrame(rows, "img_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(k, [float(r.randint(-2, 2)) + 0.5 for _ in range(3)]) for k in range(7)], "query long, centroid array<double>")
    pairs = queries.crossJoin(items).select("query", F.col("img_id").alias("imgId"), F.round(vectors.cosine_distance(F.col("embedding"), F.col("centroid")), 9).alias("d"))
    want = {}
    for q, i, d in sorted((r["query"], r["imgId"], r["d"]) for r in pairs.collect()):
        want.setdefault(q, []).append((d, i))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got = {}
        for row in vectors.batch_top_k(queries, items, 30).orderBy("query", "rank").collect():
            got.setdefault(row["query"], []).append(row["imgId"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {q: [i for _, i in sorted(v)[:30]] for q, v in want.items()}


@pytest.mark.parametrize("chunk,fan", [(7, 3), (40, 2), (1000, 32)])
def test_batch_top_k_over_many_chunks(spark, monkeypatch, chunk, fan):
    """Chunks are merged in a tree; the plan has as many nodes for a thousand queries as for two."""
    monkeypatch.setattr(vectors, "FAN", fan)
    r = np.random.default_rng(2)
    items = spark.createDataFrame([(f"i{k:03d}", [float(x) for x in r.integers(-2, 3, 3)]) for k in range(300)] + [("none", None)], "img_id string, embedding array<float>").repartition(5)
    queries = lambda n: spark.createDataFrame([(k, [float(x) + 0.5 for x in np.random.default_rng(k).integers(-2, 3, 3)]) for k in range(n)], "query long, centroid array<double>")
    out = vectors.batch_top_k(queries(9), items, 12, block=4, chunk=chunk)
    got = {}
    for row in out.orderBy("query", "rank").collect():
        got.setdefault(row["query"], []).append((row["imgId"], round(row["distance"], 9)))
    for q in queries(9).collect():
        scan = items.filter("embedding is not null").select("img_id", F.round(vectors.cosine_distance(F.col("embedding"), F.array(*map(F.lit, q["centroid"]))), 9).alias("d")).orderBy("d", "img_id").limit(12)
        assert got[q["query"]] == [(s["img_id"], pytest.approx(s["d"], abs=2e-9)) for s in scan.collect()]
    nodes = lambda n: len(vectors.batch_top_k(queries(n), items, 3, chunk=chunk)._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert nodes(2) == nodes(1000)


def test_projection_keeps_the_largest_variances(spark):
    r = np.random.default_rng(3)
    data = r.normal(size=(60, 5)) * [9, 4, 1, 0.5, 0.1]
    out = projection.project_2d(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "img_id long, embedding array<double>")).orderBy("img_id").collect()
    own = data @ np.linalg.svd(data - data.mean(axis=0))[2][:2].T
    for k, c in enumerate("xy"):
        got = np.array([row[c] for row in out])
        axis = np.linalg.svd(data - data.mean(axis=0))[2][k]
        assert np.allclose(got, own[:, k] * np.sign(axis[np.abs(axis).argmax()]))


def test_min_max_score(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 0.25)], "species string, distance double")
    assert {r["species"]: r["score"] for r in fusion.min_max_score(df, 2.0).collect()} == {"a": 2.0, "b": 0.0, "c": 1.5}
    assert fusion.min_max_score(df.filter("species = 'b'")).first()["score"] == 1.0


def test_fulltext(spark):
    df = spark.createDataFrame([(1, "x", "the red fox"), (2, "x", "red red"), (3, "y", "bleu été"), (4, None, "red")], "id long, species string, text string")
    out = fulltext.fts_search(df, "id", ["text"], "Red the")
    assert [(r["species"], r["id"]) for r in out.collect()] == [("x", 2)]
    assert fulltext.fts_search(df, "id", ["text"], "ete").first()["id"] == 3
    assert fulltext.bm25(fulltext.build_fts(df, "id", ["text"]), "nothing").count() == 0
    assert [r["id"] for r in fulltext.fts_search(df, "id", ["text"], "red", unique=False).collect()] == [2, 1]
    assert fulltext.search_occurrences(df, " ", "id").count() == 0


def test_stored_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "the red foxes"), (2, "y", "fox"), (3, "z", "blue")], "id long, species string, text string")
    stem = lambda w: F.regexp_replace(w, "(es|s)$", "")
    index = fulltext.store_fts(df, "id", ["text"], str(tmp_path / "i"), stem)
    assert sorted(r["id"] for r in fulltext.bm25(index, "Foxes").collect()) == [1, 2]
    other = df.filter("id = 3")
    assert fulltext.store_fts(other, "id", ["text"], str(tmp_path / "i"), stem).lengths.count() == 3
    assert fulltext.store_fts(other, "id", ["text"], str(tmp_path / "i"), stem, overwrite=True).lengths.count() == 1
    plain = fulltext.build_fts(df, "id", ["species", "text"])
    scan = fulltext.scan_scores(df, "id", ["species", "text"], "red fox x")
    both = [sorted((r["id"], round(r["score"], 9)) for r in f.collect()) for f in (fulltext.bm25(plain, "red fox x"), scan)]
    assert both[0] == both[1]


def test_tiles_match_the_inequality(spark):
    pts = spark.createDataFrame([(1, 0.05, 0.95), (2, 0.5, 0.5), (3, 0.26, 0.74)], "id long, x double, y double")
    got = {(r["id"], r["z"], r["tx"], r["ty"]) for r in projection.tile_index(pts, 4).collect()}
    m, want = 68 / 256, set()
    for r in pts.collect():
        for z in range(5):
            n = 2**z
            hits = lambda p: [t for t in range(n) if t - m <= p * n < t + 1 + m]  # noqa: B023, E731
            want |= {(r["id"], z, x, y) for x in hits(r["x"]) for y in hits(r["y"])}
    assert got == want


def test_page_sections():
    page = "<h2>One</h2><p>a <b>b</b></p><table class='infobox'><tr><td>k</td></tr></table><h2>Two</h2>c<script>x</script>"
    plain = lambda *a: [p[:3] for p in corpora.split_page(*a)]
    assert plain(page) == [("section", "One", "a b"), ("infobox", "One", "k"), ("section", "One", ""), ("section", "Two", "c")]
    assert corpora.split_page(None) == []
    box = "<div class=navbox><table><caption>Taxon identifiers</caption><tr><th>W</th><td><a>Q1</a></td></tr><tr><th>W</th><td>Q1</td></tr><tr><th>G</th><td>7 <b>x</b></td></tr></table></div>"
    page = f"<h2>One</h2>a<p class=noprint>n</p><div id=catlinks>c</div><i class=taxobox-edit-taxonomy>e</i>{box}<div class='navbox x'><table><tr><th>Links</th><td>b</td></tr></table></div>d"
    assert plain(page) == [("identifiers", "", "Q1 · 7 x"), ("section", "One", "a d")]
    assert corpora.split_page(page)[0][3] == "<span>Q1</span><p><span>7 x</span>"
    assert corpora.split_page("<h2>A</h2><div id='x'>a &lt; b<br>c<h2>B</h2>d</div>") == [("section", "A", "a < b c", "<div id='x'>a &lt; b<br>c</div>"), ("section", "B", "d", "d")]
    nested = "<h2>T</h2><table><tr><td>a<table><tr><td>b</td></tr></table>c</td></tr></table>z"
    assert plain(nested) == [("section", "T", ""), ("table", "T", "a b c"), ("section", "T", "z")]
    assert plain("<p>x</p><h2>A</h2>y<h2>A</h2>y") == [("section", "", "x"), ("section", "A", "y"), ("section", "A", "y")]
    inner = "<p>out</p><div class='a root'><h2>A</h2>in<div class=root>deep</div></div><p>out</p>"
    assert plain(inner, "h2", "root") == [("section", "A", "in deep")] and plain("<p>x</p>", "h2", "root") == []


def _tree(r, depth=0):
    """A random page as nested lists: (tag, class, children) and texts."""
    out = []
    for _ in range(r.randint(0, 4)):
        kind = r.random()
        if kind < 0.35 or depth > 3:
            out.append(r.choice(["one", "a < b", " two  three ", "x&y"]))
        else:
            tag = r.choice(["div", "p", "h2", "table", "span", "script", "ul"])
            name = r.choice(["", "", "noprint", "infobox", "stub wide"])
            out.append((tag, name, [r.choice(["T one", "B &"])] if tag == "h2" else _tree(r, depth + 1) if tag != "script" else ["var"]))
    return out


def _rendered(nodes):
    import html

    return "".join(html.escape(n, False) if isinstance(n, str) else f"<{n[0]} class='{n[1]}'>{_rendered(n[2])}</{n[0]}>" for n in nodes)


def _parts_of(nodes):
    """The parts by walking the tree: a heading begins one, an outer table is one."""
    found, state = [], {"title": "", "text": "", "kind": "section"}

    def close():
        text = " ".join(state["text"].split())
        if text or (state["kind"] == "section" and state["title"]):
            found.append((state["kind"], state["title"].strip(), text))
        state["text"] = ""

    def walk(nodes):
        for n in nodes:
            if isinstance(n, str):
                state["text"] += n
                continue
            tag, name, inner = n
            if tag == "script" or {"noprint", "stub"} & set(name.split()):
                parts_words = lambda t: not isinstance(t, str) and (t[0] in ("p", "div", "table") or any(map(parts_words, t[2])))
                state["text"] += " " if parts_words(n) else ""
                continue
            if tag == "h2":
                close()
                state["title"] = "".join(inner)
            elif tag == "table" and state["kind"] == "section":
                close()
                state["kind"] = "infobox" if "infobox" in name.split() else "table"
                walk(inner)
                close()
                state["kind"] = "section"
            else:
                apart = " " if tag in ("p", "div", "table") else ""
                state["text"] += apart
                walk(inner)
                state["text"] += apart

    walk(nodes)
    close()
    return found


def test_parts_of_random_pages():
    r = random.Random(6)
    for _ in range(400):
        tree = _tree(r)
        got = corpora.split_page(_rendered(tree))
        assert [p[:3] for p in got] == _parts_of(tree)
        for _, _, text, part in got:  # a part's html has its text, and closes what it opens
            again = "".join(corpora.split_page(part.replace("<table", "<div").replace("</table", "</div"), "none")[0][2].split()) if text else ""
            assert again == "".join(text.split()) and part.count("<") == 2 * part.count("</")


def test_mentions(spark):
    df = spark.createDataFrame([("On Danaus  plexippus", None), ("danausplexippus", "x"), (None, "DANAUS PLEXIPPUS.")], "title string, abstract string")
    assert corpora.mentions(df, "Danaus_plexippus").count() == 2
    assert corpora.mentions(df, "Danaus_x", "genus").count() == 2


def test_catalog_helpers(spark, meta):
    assert catalog.meta_by_id(meta, "img4.png").first()["img_id"] == "img4"
    assert sorted(ids(catalog.side_filter(meta, "DORSAL"))) == ["img1", "img3", "img4", "img6"]
    assert catalog.exclude_species(meta, "coenonympha_pamphilus").count() == 3
    assert catalog.source_counts(meta).first()["source"] == "other"
    assert catalog.collection_stats(meta).first()["n_species"] == 4
    names = spark.createDataFrame([("coenonympha_pamphilus",)] * 2, "species string")
    assert catalog.images_for_species(meta, names).count() == 6
    assert catalog.existing_species(meta, names).count() == 1
    assert "kingdom" not in catalog.public_meta(meta).columns


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "img_id string, v int")
    batch = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "img_id string, v int")
    assert sorted(map(tuple, tables.insert_if_absent(rows, batch).collect())) == [("c", 3)]
    assert sorted(map(tuple, tables.upsert(rows, batch).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    keys_ = spark.createDataFrame([("a",)], "img_id string")
    assert sorted(map(tuple, tables.replace_keys(rows, batch, keys_).collect())) == [("b", 2), ("b", 9), ("c", 3), ("c", 3)]
    (tmp_path / "t.tsv").write_text("a\tgeoreferencedDate\n1\t2020\n")
    df = tables.read(spark, str(tmp_path / "t.tsv"), "tsv", types={"georeferencedDate": "string"})
    assert df.dtypes == [("a", "int"), ("georeferencedDate", "string")]
    assert tables.ingest(spark, str(tmp_path / "t.tsv"), "own_t", "tsv").count() == 1
    tables.ingest(spark, None, "own_t", mode="if_absent", df=rows)
    assert tables.count_entries(spark, "own_t") == 1 and tables.count_entries(spark, "nowhere") is None
    assert tables.open_vectors(spark, str(tmp_path / "v"), {"e": 2}).count() == 0
    (tmp_path / "i/danaus_plexippus").mkdir(parents=True)
    for name in ("x.PNG", "y.txt"):
        (tmp_path / "i/danaus_plexippus" / name).write_bytes(b"1")
    files = tables.scan_images(spark, str(tmp_path / "i"))
    assert ids(files) == ["x"]
    entry = tables.metadata_entries(files).first()
    assert (entry["id"], entry["scientificName"]) == ("danaus_plexippus_x", "Danaus plexippus")
    (tmp_path / "i/plain").mkdir()
    (tmp_path / "i/plain/z.png").write_bytes(b"1")
    assert tables.write_metadata_json(tables.scan_images(spark, str(tmp_path / "i")), str(tmp_path / "j")) == (1, 1)
    clash = spark.createDataFrame([("c", 5), ("c", 3)], "img_id string, v int")
    assert sorted(map(tuple, tables.upsert(rows, clash).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    for force, want in ((False, [("a", 1), ("b", 2), ("c", 3), ("c", 5)]), (True, [("c", 3), ("c", 5)])):
        tables.store_keys(spark, "own_k", rows, rows.select("img_id"), force=True)
        assert sorted(map(tuple, tables.store_keys(spark, "own_k", clash, clash.select("img_id").distinct(), force).collect())) == want
    assert spark.read.text(str(tmp_path / "j")).first()["value"].startswith('{"danaus_plexippus_x":{')


def test_stream_ingest_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "img_id string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream_ingest(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
        assert KeyedTable.open(spark, str(tmp_path / "out")).read().count() == 2
        rows.write.mode("append").parquet(str(tmp_path / "in"))
