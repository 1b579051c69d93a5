"""A diagram's geometry as DataFrame arithmetic: groups by study stage in zones around a workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.tagging import LEVEL_COLUMN, STAGE_COLUMN

#: Pixels.
NODE_W = 160
NODE_H = 55
GAP_X = 15
GAP_Y = 15
HEADER_H = 36
GROUP_PAD = 12
GRID_GAP = 55
MARGIN = 60
CENTER_MIN_W = 500
CENTER_MIN_H = 400
PAGE_MIN_W = 1600
PAGE_MIN_H = 1200
#: Stage, zone, fill, stroke; in drawing order.
STAGES = [
    ("synthesis", "top", "#f4cccc", "#cc0000"),
    ("formulation", "top", "#fce5cd", "#e06c00"),
    ("materials processing", "top", "#ead1dc", "#a64d79"),
    ("sample", "top", "#fff2cc", "#d6b656"),
    ("tool", "left", "#dae8fc", "#3e7fc1"),
    ("data", "left", "#cfe2f3", "#4a86e8"),
    ("recipe", "right", "#d5e8d4", "#82b366"),
    ("data processing", "right", "#f8cecc", "#b85450"),
    ("result", "bottom", "#d9ead3", "#38761d"),
    ("analysis", "bottom", "#e1d5e7", "#9673a6"),
    ("modeling", "bottom", "#ffe6cc", "#d79b00"),
    ("results and metadata", "bottom", "#d0e0e3", "#006eaf"),
    ("unclassified", "below", "#f5f5f5", "#888888"),
]
UNKNOWN = ("#ffffff", "#aaaaaa")


def stage_of(enriched: DataFrame) -> DataFrame:
    """concept, doc_frequency, level, stage: the first stage tag, or unclassified."""
    primary = X.primary_tag(F.col(f"`{STAGE_COLUMN}`"))
    return enriched.select("concept", "doc_frequency", F.coalesce(F.col(f"`{LEVEL_COLUMN}`"), F.lit("")).alias("level"), F.when(primary.isin([s[0] for s in STAGES]), primary).otherwise("unclassified").alias("stage"))


def stage_color(stage) -> "F.Column":
    """struct(fill, stroke) of the first stage in a tag text."""
    first = X.primary_tag(stage)
    color = lambda a, b: F.struct(F.lit(a).alias("fill"), F.lit(b).alias("stroke"))
    out = color(*UNKNOWN)
    for name, _, fill, stroke in STAGES:
        out = F.when(first == name, color(fill, stroke)).otherwise(out)
    return out


def groups(staged: DataFrame) -> DataFrame:
    """stage, seq, zone, fill, stroke, n, n_cols, w, h of every stage that has concepts (13 at most)."""
    spark = staged.sparkSession
    rows = ", ".join(f"('{s}', {i}, '{z}', '{f}', '{k}')" for i, (s, z, f, k) in enumerate(STAGES))
    dim = spark.sql(f"SELECT * FROM VALUES {rows} AS t(stage, seq, zone, fill, stroke)")
    n_cols = X.group_columns(F.col("n"))
    cols, lines = F.least(F.col("n_cols"), F.col("n")), F.ceil(F.col("n") / F.col("n_cols"))
    return (
        staged.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(dim), "stage").withColumn("n_cols", n_cols)
        .withColumn("w", (cols * (NODE_W + GAP_X) - GAP_X + 2 * GROUP_PAD).cast("long"))
        .withColumn("h", (lines * (NODE_H + GAP_Y) - GAP_Y + 2 * GROUP_PAD + HEADER_H).cast("long"))
    )


def canvas(grouped: DataFrame) -> DataFrame:
    """One row: zone sizes, workspace cx, cy, centre_w, centre_h, and inner_w, canvas_w, canvas_h."""
    in_ = lambda z, c: F.when(F.col("zone") == z, F.col(c))
    total = lambda z, c: F.coalesce(F.sum(in_(z, c)) + GRID_GAP * (F.count(in_(z, c)) - 1), F.lit(0))
    most = lambda z, c: F.coalesce(F.max(in_(z, c)), F.lit(0))
    sized = grouped.agg(
        *[total(z, "w").alias(f"{z}_w") for z in ("top", "bottom")], *[most(z, "h").alias(f"{z}_h") for z in ("top", "bottom")],
        *[most(z, "w").alias(f"{z}_w") for z in ("left", "right")], *[total(z, "h").alias(f"{z}_h") for z in ("left", "right")],
    )
    gap = lambda c: F.when(F.col(c) > 0, GRID_GAP).otherwise(0)
    sides = F.col("left_w") + gap("left_w") + gap("right_w") + F.col("right_w")
    return (
        sized.withColumn("inner_w", F.greatest("top_w", "bottom_w", sides + CENTER_MIN_W))
        .withColumn("canvas_w", F.col("inner_w") + 2 * MARGIN)
        .withColumn("centre_w", F.greatest(F.col("inner_w") - sides, F.lit(CENTER_MIN_W)))
        .withColumn("centre_h", F.greatest("left_h", "right_h", F.lit(CENTER_MIN_H)))
        .withColumn("cx", MARGIN + F.col("left_w") + gap("left_w"))
        .withColumn("cy", MARGIN + F.col("top_h") + gap("top_h"))
        .withColumn("canvas_h", 2 * MARGIN + F.col("top_h") + gap("top_h") + F.col("centre_h") + gap("bottom_h") + F.col("bottom_h"))
    )


def place_groups(grouped: DataFrame) -> DataFrame:
    """``groups`` plus x, y. Windows run over 13 rows at most."""
    before = Window.partitionBy("zone").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(F.col(c) + GRID_GAP).over(before), F.lit(0))
    z = F.col("zone")
    centred = lambda c: MARGIN + F.greatest(F.lit(0), F.floor((F.col("inner_w") - F.col(c)) / 2))
    x = F.when(z == "top", centred("top_w") + F.col("_rw")).when(z == "bottom", centred("bottom_w") + F.col("_rw")).when(z == "right", F.col("cx") + F.col("centre_w") + GRID_GAP).otherwise(MARGIN)
    y = (
        F.when(z == "top", MARGIN).when(z.isin("left", "right"), F.col("cy") + F.col("_rh"))
        .when(z == "bottom", F.col("cy") + F.col("centre_h") + GRID_GAP).otherwise(F.col("canvas_h") - MARGIN + GRID_GAP)
    )
    moved = grouped.withColumn("_rw", run("w")).withColumn("_rh", run("h")).join(F.broadcast(canvas(grouped)))
    return moved.select(*grouped.columns, x.cast("long").alias("x"), y.cast("long").alias("y"))


def place_nodes(staged: DataFrame, grouped: DataFrame) -> DataFrame:
    """concept, level, stage, id, x, y within the group: most frequent first, ids from 2 in drawing order."""
    base = grouped.select("stage", "seq", "n_cols", "stroke", (F.coalesce(F.sum("n").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 2).alias("_first"))
    j = F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("doc_frequency"), "concept")) - 1
    ranked = staged.withColumn("j", j).join(F.broadcast(base), "stage")
    return ranked.select(
        "concept", "level", "stage", "stroke", (F.col("_first") + F.col("j")).cast("long").alias("id"),
        (GROUP_PAD + F.pmod("j", "n_cols") * (NODE_W + GAP_X)).cast("long").alias("x"),
        (HEADER_H + GROUP_PAD + F.floor(F.col("j") / F.col("n_cols")) * (NODE_H + GAP_Y)).cast("long").alias("y"),
    )


#: Words of the file format, for every text box in a diagram.
BOX = "rounded=1;whiteSpace=wrap;html=1;align=center;verticalAlign=middle;"


def node_style(fill, stroke) -> "F.Column":
    return F.concat(F.lit(f"{BOX}fillColor="), fill, F.lit(";strokeColor="), stroke, F.lit(";"))


def node_label(concept, stage, level) -> "F.Column":
    """HTML label: the concept, and its tags in small print below."""
    lines = F.transform(F.array_compact(F.array(F.nullif(stage, F.lit("")), F.nullif(level, F.lit("")))), lambda t: F.concat(F.lit("<small>"), t, F.lit("</small>")))
    return F.concat_ws("<br>", F.concat(F.lit("<strong>"), concept, F.lit("</strong>")), lines)
