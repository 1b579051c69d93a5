"""What a remote model is asked: for each task the instructions, the tool it answers with and the
schema of the tool's result, as JSON schema for the request and as a Spark type for the reply."""

from __future__ import annotations

from dataclasses import dataclass

from siltstone import schemas

TEXT, SCORE = {"type": "string"}, {"type": "number", "minimum": 0, "maximum": 1}


def rows(**fields) -> dict:
    """Schema of a list of records with these fields, all required."""
    return {"type": "array", "items": {"type": "object", "properties": fields, "required": list(fields)}}


@dataclass(frozen=True)
class Task:
    tool: str
    result: str
    schema: dict
    instructions: str
    reply: str

    def request(self) -> dict:
        """The tool as a request states it."""
        parameters = {"type": "object", "properties": {self.result: self.schema}, "required": [self.result]}
        return {"type": "function", "function": {"name": self.tool, "description": self.instructions.split(".")[0] + ".", "parameters": parameters}}


DISCOVER = Task(
    "record_concepts", "concepts", rows(canonical=TEXT, paper_term=TEXT, relevance=SCORE),
    "Name what the abstract is about. Give each concept a short lower-case label of one to four words that other papers of the field could "
    "use too, the wording of this paper, and how central it is to the paper, from 0 to 1. Numbers and product names are wordings, never labels.",
    schemas.CONCEPTS_JSON,
)
NORMALIZE = Task(
    "record_labels", "labels", {"type": "array", "items": TEXT},
    "Reduce a list of labels to a vocabulary. Labels that mean the same become one; leave out those that fit any paper or only a single one. "
    "Keep between 30 and 80, in lower case, one to four words each, the most important first.",
    "struct<labels: array<string>>",
)
POPULATE = Task(
    "record_values", "values", rows(canonical=TEXT, value=TEXT, quote=TEXT),
    "Look up what the paper says on each listed concept. Give its value in the paper's own words and the one sentence that states it best. "
    "Leave both empty where the paper is silent; never infer.",
    schemas.VALUES_JSON,
)


def tag_task(stages: list[str], levels: list[str]) -> Task:
    many = lambda of: {"type": "array", "items": {"type": "string", "enum": list(of)}}
    return Task(
        "record_tags", "tagged_concepts", rows(concept=TEXT, mds_study_stage=many(stages), mds_supply_chain_level=many(levels)),
        "Sort each concept by the stage of a study it belongs to and the level of the supply chain it concerns. Use listed tags only, the most "
        "fitting first, and none where none fits.",
        schemas.TAGS_JSON,
    )


def record_task(concepts: list[str], device_type: bool = True) -> Task:
    """One record with the fixed fields and one field a concept."""
    names = schemas.field_names(concepts)
    fixed = {f: {"type": "string", "enum": list(schemas.DEVICE_TYPES)} if f == "device_type" else TEXT for f in schemas.FIXED_FIELDS if device_type or f != "device_type"}
    fields = fixed | {n: TEXT | {"description": c} for c, n in names.items()}
    return Task("record_paper", "record", {"type": "object", "properties": fields, "required": list(fields)}, f"Fill in the record from the text. Write {schemas.DEVICE_TYPES[-1]} where it does not say.", "")
