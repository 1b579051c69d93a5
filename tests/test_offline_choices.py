"""Workflows with what is learned from the collection in place of word lists and hashes."""

from siltstone import schemas
from siltstone.operators import extraction as E
from siltstone.operators import tagging as G
from siltstone.plans import workflows as W

SCHEMA = f"paper string, collection string, doi string, abstract string, full_text string, title string, authors {schemas.ITEMS['authors'].dataType.simpleString()}"
BODIES = ["Thin film growth. Annealing of the thin film growth chamber.", "thin film growth and lattice strain", "A lattice strain map; lattice strain of grains", "Lattice strain", "", None]


def papers(spark):
    return spark.createDataFrame([(f"p{i}", "c", "", b, b, f"T{i}", None) for i, b in enumerate(BODIES)], SCHEMA)


def test_vocabulary_of_nested_terms(spark):
    matrix, kept = W.vocabulary_analytics(papers(spark), top_n=2, nested=2)
    assert {(r.concept, r.doc_frequency) for r in kept.collect()} == {("lattice strain", 3), ("thin film growth", 2)}  # not "thin film", nor whole runs
    assert matrix.columns == ["paper", "lattice strain", "thin film growth"] and matrix.count() == 4


def test_local_analytics_with_learned_vectors(spark):
    rows, ranked, matrix = W.local_analytics(papers(spark), top_n=5, learned=True)
    assert {r.paper for r in rows.collect()} == {"p0", "p1", "p2", "p3"} and matrix.count() == 4
    assert "lattice strain" in {r.concept for r in ranked.collect()}


def test_schema_by_spelling(spark):
    class Spelled(E.Offline):
        def concepts(self, text, top_n):
            names = {"p": ["annealing", "lattice strain"], "q": ["anealing", "lattice-strain"], "r": ["lattice strain", "annealing"], "s": ["mobility"]}[text[0]]
            return [{"canonical": n, "paper_term": "", "relevance": 1.0} for n in names]

    rows = [(x, "c", "", x, f"{x} about annealing.", "T", None) for x in "pqrs"]
    _, table = W.discover_schema(spark.createDataFrame(rows, SCHEMA), Spelled(), most=2, by_spelling=True)
    assert table.columns == ["domain", "doi", "annealing", "lattice strain"]


def test_tags_spread_to_unknown_concepts(spark):
    concepts = spark.createDataFrame([("xrd detector", 5), ("goniometer", 4), ("sputter deposition", 3), ("qqq", 2), ("alone", 1)], "concept string, doc_frequency long")
    rows = spark.createDataFrame([("a", "XRD detector"), ("a", "goniometer"), ("b", "goniometer"), ("b", "xrd detector"), ("c", "qqq"), ("c", "sputter deposition"), (None, "alone"), ("d", None)], "paper string, concept string")
    tags = {r.concept: r.stages for r in G.spread_all(concepts, rows).collect()}
    assert tags == {"xrd detector": ["tool"], "goniometer": ["tool"], "sputter deposition": ["synthesis"], "qqq": ["synthesis"], "alone": []}
    enriched, _ = W.tag_and_draw(concepts, rows=rows)
    assert {r.concept: r["mds:studyStage"] for r in enriched.collect()}["goniometer"] == "mds:tool"


def test_vocabulary_reads_texts_once(spark):
    """The frequencies of the vocabulary's phrases are those that chose it: no second pass counts them again."""
    kept = W.vocabulary_analytics(papers(spark), top_n=2)[1]
    assert kept.count() == 2 and "Generate" not in kept._jdf.queryExecution().toString()


def test_matrix_lowers_sentences_once(spark):
    from siltstone.operators import matrix as M

    docs = spark.createDataFrame([("p", "One ALPHA. Two beta! alpha and Beta? None"), ("q", "")], "paper string, text string").selectExpr("paper", "concat(text, '') AS text")
    wide = M.ontology_matrix(docs, ["alpha", "beta", "gamma"])
    assert [tuple(r) for r in wide.collect()] == [("p", "One ALPHA. | alpha and Beta?", "Two beta! | alpha and Beta?", "")]
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
