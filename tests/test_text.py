import re

from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import text as X


def one(spark, c, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(c.alias("r")).first().r


def test_strip_is_unicode(spark):
    assert one(spark, X.strip(F.col("a")), a=" \t x y \n") == "x y"


def test_sentences_match_python(spark):
    text = "A b. C d!  E? f g.\nH. "
    assert one(spark, X.sentences(F.col("a")), a=text) == re.split(r"(?<=[.!?])\s+", text)


def test_term_is_a_substring(spark):
    assert one(spark, X.joined_matches(F.col("a"), F.lit("cat")), a="Cats run. Dogs. Concatenate!") == "Cats run. | Concatenate!"


def test_slug_doi_cell_tags(spark):
    for a, want in (("Band gap (eV)", "band_gap_ev"), ("  ", "concept"), ("__A--b__", "a_b")):
        assert one(spark, X.slug(F.col("a")), a=a) == want == schemas.slug(a)
    for a, want in ((None, "Not Specified"), ("", "Not Specified"), ("10.1/x", "https://doi.org/10.1/x"), ("http://a", "http://a"), ("Not Specified", "Not Specified")):
        assert one(spark, X.doi_url(F.col("a").cast("string")), a=a) == want
    for v, q, want in (("v", "q", "v | q"), ("v", "", "v"), ("", "q", "q"), ("", "", "")):
        assert one(spark, X.cell(F.col("v"), F.col("q")), v=v, q=q) == want
    assert one(spark, X.primary_tag(F.col("a")), a="mds:Data Processing , mds:tool") == "data processing"
    assert one(spark, X.tag_text(F.array(F.lit("a"), F.lit("b")))) == "mds:a, mds:b"
    assert one(spark, X.file_stem_slug(F.col("a")), a="/x/concepts_tem-semi-u-v3.csv") == "tem"


def test_title_case_and_elapsed(spark):
    for a in ("tem-semi_2d-films", "o'neil x1y", "ab__c", "", "Éa éB"):
        assert one(spark, X.title_case(F.col("a")), a=a) == a.replace("_", " ").title()
    assert [one(spark, X.elapsed(F.lit(s))) for s in (0, 59, 60, 125, 3725)] == ["0s", "59s", "1m 00s", "2m 05s", "62m 05s"]


def test_round_is_exact(spark):
    for v in (0.71585, 0.12345, -0.04495, 2.5):
        assert one(spark, X.round_exact(F.col("a")), a=v) == round(v, 4)


def test_group_columns(spark):
    got = [r.r for r in spark.range(0, 60).select(X.group_columns(F.col("id")).alias("r")).collect()]
    assert got == [max(1, n) if n <= 3 else max(3, min(8, round((n * 1.5) ** 0.5))) for n in range(60)]


def test_field_names_are_distinct():
    names = schemas.field_names(["DOI", "a b", "a-b", "x"])
    assert list(names.values()) == ["doi_val", "a_b", "a_b_val", "x"]
    assert schemas.unique_labels(["paper", " ", "a", "A", "a"], ["paper"]) == ["paper_val", "a"]


def brute_phrases(text, least_words=1, longer_than=4):
    """Word by word: runs between stop words and marks."""
    out, run = {}, []
    for w in re.findall(r"[^\W_][\w-]*|[^\w\s-]+", text.lower()) + ["the"]:
        if w in X.STOP_WORDS or not (w[0].isalnum()):
            if len(run) >= least_words and len(" ".join(run)) > longer_than:
                out[" ".join(run)] = None
            run = []
        else:
            run.append(w)
    return list(out)


def test_noun_phrases_against_brute_force(spark):
    texts = ["The thin film of the tin, and it", "", "of the", "Tin-doped  oxide_layer (ITO) was grown\nby sputtering; thin film, Thin Film.", "Größe überall \u00e9t\u00e9 42 kV -x- __a a__b", "a\u00a0wide\u2003gap", "x" * 3000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for least, longer in ((1, 4), (2, 0)):
        got = {r.i: r.p for r in rows.select("i", X.noun_phrases(F.col("t"), least, longer).alias("p")).collect()}
        assert [got[i] for i in range(len(texts))] == [brute_phrases(t, least, longer) for t in texts]
    assert brute_phrases(texts[0]) == ["thin film"]
