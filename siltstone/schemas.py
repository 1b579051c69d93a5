"""Schemas of the flat tables, and builders of those that are known only at run time."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from siltstone.functions.text import NAME_PART

AUTHOR = T.StructType([T.StructField(n, T.StringType()) for n in ("firstName", "lastName", "creatorType")])
CATALOG = T.StructType([T.StructField("name", T.StringType()), T.StructField("key", T.StringType())])
ITEMS = T.StructType(
    [T.StructField("collection", T.StringType()), T.StructField("pos", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("key", "item_type", "title", "doi", "abstract", "date")]
    + [T.StructField("authors", T.ArrayType(AUTHOR))]
)
PAPERS = T.StructType([*ITEMS.fields, T.StructField("full_text", T.StringType())])
ATTACHMENTS = "item_key string, pos long, content_type string, content binary"
CONCEPTS_SHORT = "paper string, concept string, relevance double"
CONCEPTS_LONG = "paper string, doi string, canonical string, paper_term string, relevance double"
VALUES = "paper string, concept string, value string, quote string"
RANKINGS = "concept string, doc_frequency long, avg_relevance double"
#: Tool results as JSON.
CONCEPTS_JSON = "struct<concepts: array<struct<canonical: string, paper_term: string, relevance: double>>>"
VALUES_JSON = "struct<values: array<struct<canonical: string, value: string, quote: string>>>"
TAGS_JSON = "struct<tagged_concepts: array<struct<concept: string, mds_study_stage: array<string>, mds_supply_chain_level: array<string>>>>"
CALLS_JSON = "array<struct<name: string, arguments: string>>"
#: Fields that every structured extraction has, with their table headers.
FIXED_FIELDS = {"author": "Author", "institution": "Institution", "country": "Country", "doi": "DOI", "device_type": "Device Type"}
#: Fixed values.
DEVICE_TYPES = ("photovoltaic cell", "light emitting diode", "photodetector", "Not Specified")


def slug(label: str) -> str:
    """The same name as :func:`siltstone.functions.text.slug`, for lists on the driver."""
    return "_".join(re.findall(NAME_PART, label.lower())) or "concept"


def unique_labels(labels, taken=()) -> list[str]:
    """Labels in order, blanks and repeats dropped; one that equals a base column gets ``_val``."""
    out, used = [], {t.lower() for t in taken}
    for label in labels:
        if not (label or "").strip():
            continue
        name = f"{label}_val" if label.lower() in {t.lower() for t in taken} else label
        if name.lower() not in used:
            used.add(name.lower())
            out.append(name)
    return out


def field_names(concepts: list[str], fixed=tuple(FIXED_FIELDS)) -> dict[str, str]:
    """A distinct field name for each concept: its slug, with ``_val`` appended while taken."""
    out, used = {}, set(fixed)
    for c in concepts:
        name = slug(c)
        while name in used:
            name += "_val"
        used.add(name)
        out[c] = name
    return out


def extraction_struct(concepts: list[str], device_type: bool = True) -> T.StructType:
    """Record of one paper's structured extraction."""
    fixed = [f for f in FIXED_FIELDS if device_type or f != "device_type"]
    return T.StructType([T.StructField(n, T.StringType()) for n in [*fixed, *field_names(concepts).values()]])
