"""Concepts tagged with study stages and supply-chain levels."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import concepts as C
from siltstone.operators.graph import propagate_between

#: The study stages, in order.
STUDY_STAGES = [
    "synthesis",
    "formulation",
    "materials processing",
    "sample",
    "tool",
    "recipe",
    "data",
    "data processing",
    "result",
    "analysis",
    "modeling",
    "results and metadata",
]
#: The supply-chain levels, in order.
SUPPLY_CHAIN_LEVELS = ["materials", "subcomponent", "component", "assembly", "subsystem", "system"]
STAGE_COLUMN, LEVEL_COLUMN = "mds:studyStage", "mds:supplyChainLevel"

#: Offline rules, tried in order: what a concept's words say of its stage.
STAGE_RULES = [
    ("tool", r"\b(microscop\w*|spectromet\w*|diffractomet\w*|tem|sem|xrd|afm|xps|instrument|detector|camera|simulator)\b"),
    ("modeling", r"\b(model\w*|simulation|dft|finite element|calculation|theory)\b"),
    ("analysis", r"\b(analysis|statistic\w*|fitting|regression|interpretation|comparison)\b"),
    ("data processing", r"\b(filtering|normali[sz]ation|smoothing|correction|processing of data|segmentation)\b"),
    ("recipe", r"\b(temperature|pressure|voltage range|scan rate|dwell|condition\w*|setting\w*|exposure time)\b"),
    ("materials processing", r"\b(anneal\w*|etch\w*|treatment|doping|passivat\w*|activation|polish\w*|sinter\w*)\b"),
    ("formulation", r"\b(ink|mixture|blend\w*|precursor|solution|stoichiometry)\b"),
    ("synthesis", r"\b(deposition|synthesis|growth|sputter\w*|evaporat\w*|spin.?coat\w*|sublimation)\b"),
    ("result", r"\b(efficiency|lifetime|voc|jsc|ff|eqe|fill factor|mobility|density|yield|performance|recombination|bandgap|band gap)\b"),
    ("data", r"\b(spectr\w+|image\w*|curve\w*|dataset|signal|pattern\w*|measurement\w*)\b"),
    ("results and metadata", r"\b(summary|metadata|doi|certification)\b"),
    ("sample", r"\b(cell\w*|film\w*|layer\w*|crystal\w*|material\w*|perovskite\w*|cdte|silicon|absorber|device\w*|surface|grain\w*)\b"),
]
LEVEL_RULES = [
    ("system", r"\b(system|array|grid|plant)\b"),
    ("assembly", r"\b(module\w*|panel\w*)\b"),
    ("component", r"\b(cell\w*|device\w*|diode\w*)\b"),
    ("subcomponent", r"\b(layer\w*|contact\w*|film\w*|electrode\w*|interface\w*|absorber)\b"),
    ("materials", r"\b(material\w*|crystal\w*|cdte|silicon|perovskite\w*|grain\w*|dopant\w*)\b"),
]


def _by_rule(c, rules) -> "F.Column":
    out = F.lit(None).cast("string")
    for tag, pattern in reversed(rules):
        out = F.when(F.rlike(c, F.lit(pattern)), tag).otherwise(out)
    return F.array_compact(F.array(out))


def offline_tags(concepts: DataFrame) -> DataFrame:
    """concept, stages, levels by keyword rules; entirely in the JVM."""
    c = X.clean_label(F.col("concept"))
    return concepts.select(c.alias("concept"), _by_rule(c, STAGE_RULES).alias("stages"), _by_rule(c, LEVEL_RULES).alias("levels"))


def spread_all(concepts: DataFrame, rows: DataFrame, rounds: int = 20) -> DataFrame:
    """concept, stages, levels: the offline rules' tags, and for concepts that no rule knows those that spread from the
    concepts of the same papers, ``rows(paper, concept)``."""
    known = offline_tags(concepts)
    pairs = rows.select("paper", X.clean_label(F.col("concept")).alias("concept"))
    out = known
    for column in ("stages", "levels"):
        seeds = known.where(F.size(column) > 0).select("concept", F.get(column, F.lit(0)).alias("label"))
        found = spread_tags(pairs, seeds, rounds).select(F.col("concept").alias("_c"), F.array("label").alias("_spread"))
        joined = out.join(found, F.col("concept") == F.col("_c"), "left")
        out = joined.withColumn(column, F.when((F.size(column) == 0) & F.col("_spread").isNotNull(), F.col("_spread")).otherwise(F.col(column))).drop("_c", "_spread")
    return out


def batched_tags(concepts: DataFrame, tagger: Callable[[list[str]], list[dict]], size: int = 40) -> DataFrame:
    """concept, stages, levels, pos from a tagger called with one batch of concepts at a time. A batch
    whose answer is unusable leaves its concepts untagged."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf.sort_values(["doc_frequency", "concept"], ascending=[False, True])["concept"].tolist()
        try:
            found = tagger(names)
            rows = [(str(t["concept"]).strip().lower(), list(t.get("mds_study_stage") or []), list(t.get("mds_supply_chain_level") or []), i) for i, t in enumerate(found)]
        except Exception:  # noqa: BLE001
            rows = []
        return pd.DataFrame(rows, columns=["concept", "stages", "levels", "pos"])

    return C.batches(concepts, size).groupBy("batch").applyInPandas(run, "concept string, stages array<string>, levels array<string>, pos long")


def spread_tags(rows: DataFrame, seeds: DataFrame, rounds: int = 20) -> DataFrame:
    """concept, label, share for the concepts of ``rows(paper, concept)`` that a label of ``seeds(concept, label)`` reaches: the
    label of the largest share, ties alphabetical.

    Labels go from concepts to the papers that name them and on to the papers' other concepts, so no paper's
    concepts are paired with each other; see :func:`graph.propagate_between`. Two rounds are one step between
    concepts.
    """
    pairs = rows.where("paper IS NOT NULL AND concept IS NOT NULL").select(F.col("concept").alias("a"), F.col("paper").alias("b"))
    found = propagate_between(pairs, seeds.select(F.col("concept").alias("node"), "label"), rounds)
    best = found.groupBy("node").agg(F.min(F.struct((-F.col("share")).alias("less"), "label")).alias("best"))
    return best.select(F.col("node").alias("concept"), "best.label", (-F.col("best.less")).alias("share"))


def attach_tags(concepts: DataFrame, tags: DataFrame) -> DataFrame:
    """``concepts`` plus the two tag columns; unknown tags are dropped, concepts without a tag have
    empty cells, and of repeated tags the last counts. Spark picks the join by size."""
    pos = F.col("pos") if "pos" in tags.columns else F.lit(0)
    known = lambda c, all_: F.filter(c, lambda t: t.isin(all_))
    clean = tags.select(X.clean_label(F.col("concept")).alias("_k"), pos.alias("_p"), known(F.col("stages"), STUDY_STAGES).alias("s"), known(F.col("levels"), SUPPLY_CHAIN_LEVELS).alias("l"))
    one = clean.where(~X.missing(F.col("_k"))).groupBy("_k").agg(F.max_by(F.struct("s", "l"), "_p").alias("t"))
    return concepts.withColumn("_k", X.clean_label(F.col("concept"))).join(one, "_k", "left").select(
        *concepts.columns, X.tag_text(F.col("t.s")).alias(STAGE_COLUMN), X.tag_text(F.col("t.l")).alias(LEVEL_COLUMN)
    )


def untagged(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count_if(F.col(f"`{STAGE_COLUMN}`") == "").alias("untagged"))
