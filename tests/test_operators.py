import pytest
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.operators import concepts as C
from siltstone.operators import extraction as E
from siltstone.operators import layout as L
from siltstone.operators import matrix as M
from siltstone.operators import tagging as G
from siltstone.plans import workflows as W
from siltstone.sources import papers as SP


def items(spark):
    rows = [("c", 0, "k0", None, "A", None, "x", "", None), ("c", 1, "k1", "note", "N", None, "x", "", None), ("c", 2, "k2", "article", "a", None, "", "", None), ("c", 3, "k3", "article", "", None, "x", "", None), ("c", 4, "k4", "book", "B", None, None, "", None)]
    return spark.createDataFrame(rows, schemas.ITEMS)


def test_last_item_of_a_title_at_the_first_place(spark):
    got = SP.papers(items(spark)).orderBy("pos").collect()
    assert [(r.pos, r.key, r.title) for r in got] == [(0, "k2", "a"), (4, "k4", "B")]


def test_first_parsable_attachment(spark):
    rows = [("i", 0, "text/html", b"no"), ("i", 1, "application/pdf", b"\xff"), ("i", 2, "application/pdf", b""), ("i", 3, "application/pdf", b"late"), ("j", 0, "application/pdf", b"\xff")]
    got = SP.first_text(spark.createDataFrame(rows, schemas.ATTACHMENTS)).collect()
    assert [(r.item_key, r.full_text) for r in got] == [("i", "")]


def test_matrix_forms_agree(spark):
    papers = spark.createDataFrame([("p", "One cat. Two dogs. Three cats."), ("q", "None."), ("r", None)], "paper string, text string")
    wide = {r["paper"]: r for r in M.ontology_matrix(papers, ["cat", "dog", "paper"]).collect()}
    assert wide["p"]["cat"] == "One cat. | Three cats." and wide["q"]["cat"] == "" and wide["p"]["paper_val"] == "" and "r" not in wide
    tall = M.match_tall(papers, ["cat", "dog"])
    pivoted = M.pivot_wide(tall, "paper", ["cat", "dog"], "sentences").collect()
    assert [(r.paper, r.cat, r.dog) for r in pivoted] == [("p", "One cat. | Three cats.", "Two dogs.")]


def test_many_terms_in_one_pass(spark, monkeypatch):
    """The automaton finds what the built-in functions find: nested and overlapping terms, marks, none."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("paper"), "text")
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").groupBy("w").count().orderBy(F.desc("count"), "w").limit(60)
    terms = [r.w for r in words.collect()]
    terms = [*terms, *[t[1:-1] for t in terms if len(t) > 4], "e", "th", ".", ". ", "zzzz", "paper", "É"]
    few = [sorted(map(tuple, f(docs, terms).collect())) for f in (M.match_tall, M.ontology_matrix)]
    for library in (M.ahocorasick, None):
        monkeypatch.setattr(M, "FEW", 1)
        monkeypatch.setattr(M, "ahocorasick", library)
        assert [sorted(map(tuple, f(docs, terms).collect())) for f in (M.match_tall, M.ontology_matrix)] == few
    assert M.ontology_matrix(docs, terms).columns[:2] == ["paper", terms[0]]


def test_rankings_order_and_counts(spark):
    rows = spark.createDataFrame([("p", "b", 1.0), ("q", "b", 0.0), ("p", "a", 0.5), ("p", "a", 0.5), ("q", "c", 0.5)], schemas.CONCEPTS_SHORT)
    assert [tuple(r) for r in C.rankings(rows).collect()] == [("a", 2, 0.5), ("b", 2, 0.5), ("c", 1, 0.5)]
    assert {tuple(r) for r in C.paper_frequency(rows).collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert C.rankings(rows.limit(0)).collect() == []


def test_batches_partition_the_concepts(spark):
    rows = spark.range(205).select(F.concat(F.lit("c"), "id").alias("concept"), (F.col("id") % 7).alias("doc_frequency"))
    got = C.batches(rows, 40).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 40), (1, 40), (2, 40), (3, 40), (4, 40), (5, 5)]


def test_label_variants(spark):
    rows = spark.createDataFrame([("thin films",), ("thin-film",), ("Thin Films ",), ("gas",)], "concept string")
    got = {r.label: r.canonical for r in C.label_variants(rows).collect()}
    assert got == {"thin films": "thin films", "thin-film": "thin films", "gas": "gas"}


def test_tags_last_wins_and_broken_batches(spark):
    rows = spark.createDataFrame([("a", 2), ("b", 1)], "concept string, doc_frequency long")
    good = lambda names: [{"concept": " A ", "mds_study_stage": ["data", "?"]}, {"concept": "a", "mds_study_stage": ["tool"]}]
    got = {r.concept: r[G.STAGE_COLUMN] for r in G.attach_tags(rows, G.batched_tags(rows, good)).collect()}
    assert got == {"a": "mds:tool", "b": ""}

    def broken(names):
        raise ValueError

    assert G.untagged(G.attach_tags(rows, G.batched_tags(rows, broken))).first().untagged == 2


def test_layout_rectangles_do_not_overlap(spark):
    stages = [s[0] for s in L.STAGES]
    rows = [(f"c{i}", i % 5, "" if (s := stages[i * i % 13]) == "unclassified" else f"mds:{s}", "") for i in range(150)]
    drawn = L.stage_of(spark.createDataFrame(rows, f"concept string, doc_frequency long, `{G.STAGE_COLUMN}` string, `{G.LEVEL_COLUMN}` string"))
    grouped = L.groups(drawn)
    boxes = [(r.x, r.y, r.w, r.h) for r in L.place_groups(grouped).collect()]
    c = L.canvas(grouped).first()
    boxes.append((c.cx, c.cy, c.centre_w, c.centre_h))
    for i, (x, y, w, h) in enumerate(boxes):
        for a, b, d, e in boxes[:i]:
            assert x + w <= a or a + d <= x or y + h <= b or b + e <= y
    ids = sorted(r.id for r in L.place_nodes(drawn, grouped).collect())
    assert ids == list(range(2, 152))


def test_group_of_23_has_the_known_size(spark):
    drawn = spark.range(23).select(F.concat(F.lit("c"), "id").alias("concept"), F.lit(1).alias("doc_frequency"), F.lit("").alias("level"), F.lit("sample").alias("stage"))
    g = L.groups(drawn).first()
    assert (g.w, g.h) == (1059, 325)


def test_offline_extraction_is_repeatable_and_errors_stay_in_their_row(spark):
    papers = spark.createDataFrame([("p", "10.1/x", "Thin films of tin were grown. Films were annealed."), ("q", None, ""), ("r", None, "boom")], "paper string, doi string, abstract string")

    class Fails(E.Offline):
        def concepts(self, text, top_n):
            if text == "boom":
                raise RuntimeError("no answer")
            return super().concepts(text, top_n)

    rows = E.concept_table(papers, Fails(), 5).collect()
    assert {r.paper for r in rows if r.error is None} == {"p"} and [r.error for r in rows if r.paper == "r"] == ["RuntimeError: no answer"]
    assert len([r for r in rows if r.paper == "p"]) == 5
    assert E.keyphrases("", 5) == [] and E.keyphrases("tin tin", 5)[0][0] in ("tin", "tin tin")


def test_workflows(spark):
    rows = [("p", "c", "10.1/x", "Thin films were grown. Growth of thin films was fast.", ""), ("q", "c", None, "Thin films were measured.", "Full text. Thin films here.")]
    papers = spark.createDataFrame(rows, "paper string, collection string, doi string, abstract string, full_text string")
    matrix, frequency = W.vocabulary_analytics(papers, top_n=5)
    assert "thin films" in matrix.columns and {tuple(r) for r in frequency.collect()} >= {("thin films", 2)}
    concepts = spark.createDataFrame([("Thin Films ",), (None,), (" ",)], "concept string")
    found, table = W.discover_schema(papers, concept_file=concepts)
    assert found is None and table.columns == ["domain", "doi", "thin films"]
    assert {r["thin films"] for r in table.collect()} == {"Thin films were grown.", "Thin films here."}
    enriched, xml = W.tag_and_draw(spark.createDataFrame([("thin film", 3), ("xrd", 2), ("odd", 1)], "concept string, doc_frequency long"))
    assert {r.concept: r[G.STAGE_COLUMN] for r in enriched.collect()} == {"thin film": "mds:sample", "xrd": "mds:tool", "odd": ""}
    assert xml.count('id="concept-') == 3 and 'id="grp-unclassified"' in xml


def test_structured_extract(spark):
    paper = [("T", "10.1/x", [("A", "Bee", "author")], "", "The band gap was 1.5 eV.")]
    df = spark.createDataFrame(paper, f"title string, doi string, authors {schemas.ITEMS['authors'].dataType.simpleString()}, full_text string, abstract string")
    r = W.structured_extract(df, ["band gap", "DOI"]).first().asDict()
    assert r == {"Title": "T", "Author": "Bee", "Institution": "Not Specified", "Country": "Not Specified", "DOI": "https://doi.org/10.1/x", "Device Type": "Not Specified", "band gap": "The band gap was 1.5 eV.", "DOI_val": r["DOI_val"]}


def test_marginal_relevance_of_large_groups(spark, tmp_path):
    """Every vector of a group of thousands competes, and the centre is of them all."""
    import numpy as np

    from siltstone import queries as Q

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist(), i % 3 and 1) for i in range(6000)] + [(6000, None, 0), (6001, [1.0] * 16, 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = set()
    for label in (0, 1, 7):
        some = [(k, np.array(v, np.float32).astype(float)) for k, v, l in rows if l == label and v]
        v = np.array([x / np.linalg.norm(x) for _, x in some])
        centre = v.mean(axis=0)
        want |= {(label, some[i][0]) for i in E.mmr(centre / np.linalg.norm(centre), v, 10)}
    assert {tuple(r) for r in Q.mmr_select(spark, str(tmp_path)).collect()} == want and len(want) == 21


#: A published diagram's groups (members, x, y, width, height), its workspace and its page.
KNOWN_GROUPS = {
    "materials processing": (7, 529, 60, 534, 255),
    "sample": (23, 1118, 60, 1059, 325),
    "recipe": (2, 2288, 440, 359, 115),
    "result": (15, 60, 895, 884, 255),
    "analysis": (25, 999, 895, 1059, 395),
    "results and metadata": (6, 2113, 895, 534, 185),
}
KNOWN_WORKSPACE = (60, 440, 2173, 400)
KNOWN_PAGE = (2707, 1350)


def test_known_diagram(spark):
    rows = [(f"{stage} {i:02}", 1, f"mds:{stage}", "") for stage, (n, *_) in KNOWN_GROUPS.items() for i in range(n)]
    enriched = spark.createDataFrame(rows, f"concept string, doc_frequency long, `{G.STAGE_COLUMN}` string, `{G.LEVEL_COLUMN}` string")
    drawn = L.stage_of(enriched)
    grouped = L.groups(drawn)
    assert {r.stage: (r.n, r.x, r.y, r.w, r.h) for r in L.place_groups(grouped).collect()} == KNOWN_GROUPS
    c = L.canvas(grouped).first()
    assert (c.cx, c.cy, c.centre_w, c.centre_h) == KNOWN_WORKSPACE and (c.canvas_w, c.canvas_h) == KNOWN_PAGE
    from xml.etree import ElementTree as ET

    from siltstone.sinks import diagram

    root = ET.fromstring(diagram.diagram_xml(enriched))
    box = lambda cell: tuple(int(cell[0].get(k)) for k in ("x", "y", "width", "height"))
    cells = {c.get("id"): c for c in root.iter("mxCell") if len(c)}
    assert {k: box(v) for k, v in cells.items() if k.startswith("grp-")} == {"grp-" + s.replace(" ", "_"): v[1:] for s, v in KNOWN_GROUPS.items()}
    nodes = [c for k, c in cells.items() if k.startswith("concept-")]
    assert len(nodes) == 78 and len({(c.get("parent"), box(c)) for c in nodes}) == 78
    for parent, ids in {p: sorted(int(c.get("id")[8:]) for c in nodes if c.get("parent") == p) for p in {c.get("parent") for c in nodes}}.items():
        assert ids == list(range(ids[0], ids[0] + len(ids)))  # numbered on within a group
    model = next(root.iter("mxGraphModel"))
    assert (int(model.get("pageWidth")), int(model.get("pageHeight"))) == KNOWN_PAGE


def test_known_ranking(spark):
    """Means as published, not rounded; of equal frequencies the higher mean first, of equal means by name."""
    rows = [("a", "crystalline silicon", 0.95), ("a", "cadmium telluride", 0.92), ("b", "cadmium telluride", 0.8), ("b", "crystalline silicon", 0.68), ("a", "cdsete solar cells", 1.0), ("a", "cadmium selenide telluride", 1.0), ("b", "negative", -0.0449)]
    got = C.rankings(spark.createDataFrame(rows, schemas.CONCEPTS_SHORT)).collect()
    assert [tuple(r) for r in got] == [("cadmium telluride", 2, 0.8600000000000001), ("crystalline silicon", 2, 0.815), ("cadmium selenide telluride", 1, 1.0), ("cdsete solar cells", 1, 1.0), ("negative", 1, -0.0449)]


def test_matrix_invariants(spark):
    """Columns stand in ranking order, every sentence holds its column's label, and the matrix of a concept file is
    the same as that of the ranking it was written from."""
    papers = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.concat(F.lit("p"), "item_id").alias("paper"), F.lit("").alias("doi"), F.col("text").alias("abstract"))
    rows, ranked, matrix = W.local_analytics(papers, columns=40)
    per_paper = rows.groupBy("paper").agg(F.count("concept").alias("n"), F.countDistinct("concept").alias("d")).collect()
    assert all(r.n == r.d <= 20 for r in per_paper)
    assert matrix.columns[1:] == [r.concept for r in ranked.limit(40).collect()]
    cells = [(c, s) for r in matrix.collect() for c in matrix.columns[1:] for s in r[c].split(" | ") if s]
    assert cells and all(c in s.lower() for c, s in cells)
    custom = W.custom_matrix(papers, ranked.limit(40).select(F.upper("concept").alias("Concept")))
    assert sorted(map(tuple, custom.select(matrix.columns).collect())) == sorted(map(tuple, matrix.collect()))


def test_picks_of_too_many_groups_are_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(g, i, [float(g), float(i), 1.0]) for g in range(5) for i in range(4)], "label int, id int, v array<double>")
    assert E.mmr_groups(df, "label", "id", "v", 2).count() == 10
    monkeypatch.setattr(E, "MOST_NUMBERS", 5 * 3 * 2 - 1)
    with pytest.raises(ValueError, match="fewer groups"):
        E.mmr_groups(df, "label", "id", "v", 2)
