"""Paper-by-concept tables with source sentences: tall inside, wide only at the end.

A few terms are matched by built-in functions, each against each sentence. Beyond ``FEW`` of them one pass
over a sentence finds all terms with an automaton (or, where that library is missing, term by term).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import text as X

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

FEW = 100


def _finder(terms: list[str]):
    """A function from a text to the numbers of the terms that it contains."""
    if ahocorasick is None:
        return lambda s: {i for i, t in enumerate(terms) if t in s}
    automaton = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        automaton.add_word(t, i)
    automaton.make_automaton()
    return lambda s: {i for _, i in automaton.iter(s)}


def _many(split: DataFrame, terms: list[str], key: str) -> DataFrame:
    """key, hits: for each row of ``split(key, _s)`` its terms (number, sentences joined), in their order."""

    def run(batches):
        find = _finder(terms)
        for batch in batches:
            out = []
            for sents, lower in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found: dict[int, list[str]] = {}
                for s, low in zip(sents, lower):
                    for i in find(low):
                        found.setdefault(i, []).append(s)
                out.append([{"term": i, "sentences": X.CELL.join(found[i])} for i in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("term", pa.int32()), ("sentences", pa.string())])))], [key, "hits"])

    rows = split.select(key, "_s", F.transform("_s", F.lower).alias("_l"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, hits array<struct<term: int, sentences: string>>")


def match_tall(papers: DataFrame, terms: list[str], text: str = "text", key: str = "paper") -> DataFrame:
    """paper, concept, sentences: one row for each paper and term that some sentence contains.

    The terms are a literal array, so there is no join: each text is split once, in its own row, and
    only hits leave it.
    """
    terms = schemas.unique_labels(terms)
    split = papers.where(~X.missing(F.col(text))).select(key, X.sentences(F.col(text)).alias("_s"))
    if len(terms) > FEW:
        return _many(split, terms, key).select(key, F.inline("hits")).select(key, F.get(F.array(*map(F.lit, terms)), F.col("term")).alias("concept"), "sentences")
    hits = F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.struct(t.alias("concept"), X.matching(F.col("_s"), t).alias("found")))
    hits = F.filter(hits, lambda h: F.size(h["found"]) > 0)
    # an outer explode: for the other kind the planner computes the hits once more, to drop empty ones
    return split.select(key, F.explode_outer(hits).alias("h")).where("h IS NOT NULL").select(key, "h.concept", F.array_join("h.found", X.CELL).alias("sentences"))


def pivot_wide(tall: DataFrame, key: str, concepts: list[str], column: str, base: list[str] | None = None) -> DataFrame:
    """One row a key, one column a concept in the given order; missing cells are empty. The explicit
    list spares the pivot a pass that finds the values, and fixes the columns."""
    base = base or [key]
    names = schemas.unique_labels(concepts, base)
    wide = tall.groupBy(*base).pivot("concept", concepts).agg(F.first(column))
    labels = [c for c in dict.fromkeys(concepts) if c.strip()]
    return wide.select(*base, *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in zip(labels, names)])


def ontology_matrix(papers: DataFrame, terms: list[str], text: str = "text", key: str = "paper") -> DataFrame:
    """key plus one column a term with the matching sentences, for every paper with text.

    Each cell is computed in the paper's own row: no pivot, no shuffle.
    """
    terms = schemas.unique_labels(terms)
    names = schemas.unique_labels(terms, [key])
    split = papers.where(~X.missing(F.col(text))).select(key, X.sentences(F.col(text)).alias("_s"))
    if len(terms) > FEW:
        cells = F.map_from_entries("hits")
        dense = F.transform(F.sequence(F.lit(0), F.lit(len(terms) - 1)), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit("")))
        wide = _many(split, terms, key).select(key, dense.alias("_c"))
        return wide.select(key, *[F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(names)])
    split = split.select(key, "_s", F.transform("_s", F.lower).alias("_l"))  # once for all terms
    found = lambda t: F.filter("_s", lambda _, i: F.contains(F.get("_l", i), F.lit(t)))
    return split.select(key, *[F.array_join(found(t), X.CELL).alias(n) for t, n in zip(terms, names)])


def schema_table(papers: DataFrame, values: DataFrame, concepts: list[str]) -> DataFrame:
    """domain, doi and one ``value | quote`` cell a concept for every paper, found or not.

    ``papers(paper, domain, doi)``, ``values(paper, concept, value, quote[, pos])``; only requested concepts
    count, and of repeated ones the last.
    """
    pos = F.col("pos") if "pos" in values.columns else F.lit(0)
    wanted = values.select("paper", X.clean_label(F.col("concept")).alias("concept"), F.struct(pos, X.cell(F.col("value"), F.col("quote")).alias("cell")).alias("v"))
    wanted = wanted.where(F.col("concept").isin(concepts)).groupBy("paper").pivot("concept", concepts).agg(F.max("v"))
    names = schemas.unique_labels(concepts, ["domain", "doi"])
    joined = papers.join(wanted, "paper", "left")
    return joined.select("paper", "domain", "doi", *[F.coalesce(F.col(f"`{c}`.cell"), F.lit("")).alias(n) for c, n in zip(concepts, names)])
