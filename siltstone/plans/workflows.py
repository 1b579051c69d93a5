"""The workflows: vocabulary, local analytics, schema discovery, structured extraction, tagging and diagram."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import text as X
from siltstone.operators import concepts as C
from siltstone.operators import extraction as E
from siltstone.operators import labels as spellings
from siltstone.operators import matrix as M
from siltstone.operators import papers as P
from siltstone.operators import tagging as G
from siltstone.operators import terms as T
from siltstone.operators import vectors
from siltstone.operators.answers import Asker, Store
from siltstone.sinks import diagram, tables
from siltstone.sources import concepts as S
from siltstone.sources import files
from siltstone.sources.config import Settings


def _labels(df: DataFrame, most: int) -> list[str]:
    """The first ``most`` labels on the driver: the one barrier of a workflow. For tables that are cut to
    their ``most`` best rows on purpose."""
    return [r[0] for r in df.select("concept").limit(most).collect()]


def _all_labels(df: DataFrame, most: int) -> list[str]:
    """All labels on the driver, sorted; an error if there are more than ``most``."""
    found = _labels(df, most + 1)
    if len(found) > most:
        raise ValueError(f"more than {most} distinct labels to normalise: raise most_labels, or give a concept file")
    return sorted(found)


def _delay(extractor) -> float:
    """Seconds between a remote model's calls; the offline rules need none."""
    settings = getattr(extractor, "settings", None)
    return settings.delay_s if settings else 0.0


def vocabulary_analytics(papers: DataFrame, top_n: int = 80, least: int = 2, least_words: int = 1, longer_than: int = 4, chunker=None, nested: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(matrix of the vocabulary's phrases, phrase frequencies). ``papers(paper, abstract)``; ``chunker`` as of
    :func:`extraction.phrase_table`. With ``nested`` phrases are the collection's terms by nested n-grams that occur
    so often at least (:func:`terms.terms`), instead of whole runs of words."""
    if nested:
        found = T.terms(papers, "abstract", least=nested, longer_than=longer_than).where(F.col("words") >= least_words)
        phrases = T.term_table(papers, found, "abstract")
    else:
        phrases = E.phrase_table(papers, least_words=least_words, longer_than=longer_than, chunker=chunker)
    # of the phrases in `least` papers, or of all if those are fewer than `top_n`, the most frequent are the most frequent of
    # all either way; so texts are read once for them, and once for the matrix
    best = C.phrase_frequency(phrases).orderBy(F.desc("doc_frequency"), "concept").limit(top_n).collect()
    terms = sorted(r.concept for r in best)
    kept = papers.sparkSession.createDataFrame([tuple(r) for r in best], "concept string, doc_frequency long").orderBy(F.desc("doc_frequency"), "concept")
    return M.ontology_matrix(P.with_abstract(papers), terms, "abstract"), kept


def local_analytics(papers: DataFrame, extractor: E.Extractor | None = None, top_n: int = 20, columns: int = 80, learned: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concept rows, rankings, matrix of the best concepts). With ``learned`` the offline rules take word vectors learned
    from these papers (:func:`vectors.learn`) instead of hashed letters."""
    if learned and extractor is None:
        extractor = E.Offline(vectors.learn(papers, "abstract"))
    rows = E.concept_table(papers, extractor or E.Offline(), top_n, delay_s=_delay(extractor)).where("error IS NULL").select("paper", F.col("canonical").alias("concept"), "relevance")
    ranked = C.rankings(rows)
    terms = _labels(C.top_concepts(ranked, columns), columns)
    return rows, ranked, M.ontology_matrix(P.with_abstract(papers), terms, "abstract")


def custom_matrix(papers: DataFrame, concept_file: DataFrame, column: str = "concept") -> DataFrame:
    """The matrix of the concepts of a file."""
    return M.ontology_matrix(P.with_abstract(papers), S.concept_list(concept_file, column), "abstract")


def discover_schema(papers: DataFrame, extractor: E.Extractor | None = None, settings: Settings = Settings(), concept_file: DataFrame | None = None, normalize=None, most: int = 80, most_labels: int = 10_000, store: Store | None = None, by_spelling: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """(concept rows or None, schema table). Discovery is skipped if a concept file is given; the
    concepts are normalised by ``normalize(list)``, else the first ``most`` unique labels are taken.
    ``normalize`` gets the whole label set: of labels that differ in hyphens, spaces or a plural only, the
    most frequent one. More than ``most_labels`` of them are an error, never cut. With a ``store`` the extractor is a
    remote model whose answers are kept there, so a run that ended early is continued. With ``by_spelling`` and no
    ``normalize`` the terms are the ``most`` most frequent labels, spellings of one label counted together."""
    extractor, found = extractor or E.Offline(), None
    asker = Asker(extractor, store) if store else None
    if concept_file is not None:
        terms = S.concept_list(concept_file)
    else:
        found = asker.concept_table(papers, settings.top_n) if asker else E.concept_table(papers, extractor, settings.top_n, delay_s=_delay(extractor))
        labels = found.where("error IS NULL").select(F.col("canonical").alias("concept"))
        if by_spelling:
            counted = labels.groupBy("concept").agg(F.count(F.lit(1)).alias("doc_frequency"))
            terms = sorted(_labels(spellings.normalized(counted, most), most))
        else:
            terms = _labels(C.normalize_fallback(labels, most), most)
        if normalize:
            variants = C.label_variants(labels).select(F.col("canonical").alias("concept"))
            terms = normalize(_all_labels(C.unique_labels(variants), most_labels)) or terms
    terms = schemas.unique_labels([t.strip().lower() for t in terms])
    texts = P.chosen_text(P.with_any_text(papers), settings.max_chars)
    values = asker.value_table(texts, terms) if asker else E.value_table(texts, extractor, terms, delay_s=_delay(extractor))
    base = texts.select("paper", F.coalesce("collection", F.lit("")).alias("domain"), F.coalesce("doi", F.lit("")).alias("doi"))
    return found, M.schema_table(base, values, terms).drop("paper")


def structured_extract(papers: DataFrame, concepts: list[str], extractor: E.Extractor | None = None, device_type: bool = True) -> DataFrame:
    return E.record_table(papers, extractor or E.Offline(), concepts, device_type, _delay(extractor))


def tag_and_draw(concept_file: DataFrame, tagger=None, title: str = "Concepts", asker: Asker | None = None, size: int = 40, rows: DataFrame | None = None) -> tuple[DataFrame, str]:
    """(enriched concepts, diagram XML). Tags are an ``asker``'s, whose answers are kept, or a ``tagger``'s, or those of
    the offline rules; ``size`` concepts are asked for at a time. With ``rows(paper, concept)`` concepts that no rule
    knows get the tags that spread to them from those of the same papers (:func:`tagging.spread_all`)."""
    loaded = S.load_concepts(concept_file)
    tags = asker.tags(loaded, size) if asker else G.batched_tags(loaded, tagger, size) if tagger else G.offline_tags(loaded) if rows is None else G.spread_all(loaded, rows)
    enriched = G.attach_tags(loaded, tags).orderBy(F.desc("doc_frequency"), "concept")
    return enriched, diagram.diagram_xml(enriched, title)


def tag_all(spark, folder: str, out: str, on: date, version: int = 6) -> dict[str, str]:
    """Tags and draws every concept file below a folder; a file that fails does not stop the others.
    Returns each path's outcome. The loop is over files, each a distributed job."""
    done = {}
    for row in files.discover(spark, folder).collect():
        try:
            stem = X.file_stem_slug(F.lit(row.path))
            slug, title = spark.range(1).select(stem.alias("slug"), X.title_case(stem).alias("title")).first()
            enriched, xml = tag_and_draw(S.read_csv(spark, row.path), title=title)
            tables.write_csv(enriched, f"{out}/{tables.file_name('enriched', slug, 'user', version, on)}", single=True)
            diagram.write_text(spark, xml, f"{out}/{tables.diagram_name(row.path, version, on)}")
            done[row.path] = "ok"
        except Exception as e:  # noqa: BLE001
            done[row.path] = f"{type(e).__name__}: {e}"
    return done
