"""Remote answers that are kept: each question once over all runs, whatever ends a run."""

import json
import os
import sys
import time
import uuid
from collections import Counter
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle

from siltstone import schemas
from siltstone.operators import answers as A
from siltstone.operators import extraction as E
from siltstone.operators import remote
from siltstone.plans import workflows as W
from siltstone.sources.config import Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test

SCHEMA = f"paper string, collection string, doi string, abstract string, full_text string, title string, authors {schemas.ITEMS['authors'].dataType.simpleString()}"


def logged(folder, what: str) -> None:
    with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
        f.write(f"{time.time()}\n{what}")


def log(folder) -> list[tuple[float, str]]:
    out = []
    for name in os.listdir(folder):
        at, what = open(os.path.join(folder, name)).read().split("\n", 1)
        out.append((float(at), what))
    return sorted(out)


@dataclass(frozen=True)
class Echo:
    folder: str
    fatal: str = ""
    down: str = ""

    def __call__(self, question: str) -> str:
        if self.fatal and self.fatal in question:
            raise SystemExit("killed")  # ends the task, as losing its executor would
        logged(self.folder, question)
        if self.down and self.down in question:
            raise OSError("no route")
        return f"<{question}>"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def test_a_killed_run_asks_nothing_twice(spark, tmp_path, folder):
    questions = spark.createDataFrame([(i, f"question {i % 60}") for i in range(90)] + [(90, None), (91, "")], "digest long, question string").withColumnRenamed("digest", "id")
    store = A.Store(str(tmp_path / "store"), round=10, lanes=2)
    with pytest.raises(Exception, match="killed|SystemExit|exited|crashed"):
        A.ask_all(questions, Echo(folder, fatal="question 7"), store)
    kept = {r.digest for r in store.read(spark).collect()}
    sent = Counter(q for _, q in log(folder))
    assert 0 < len(kept) < 61
    found = A.ask_all(questions, Echo(folder), store).collect()
    assert {(r.id, r.question, r.answer, r.error) for r in found} == {(i, f"question {i % 60}", f"<question {i % 60}>", None) for i in range(90)} | {(90, None, None, None), (91, "", "<>", None)}
    again = Counter(q for _, q in log(folder)) - sent
    assert set(again.values()) == {1} and len(again) == 61 - len(kept)  # what was kept was not asked again, equal questions once
    before = len(log(folder))
    assert A.ask_all(questions, Echo(folder), store).where("answer IS NULL").count() == 1 and len(log(folder)) == before
    A.ask_all(questions, Echo(folder), store, about="another model")
    assert len(log(folder)) == before + 61


def test_failures_are_told_and_asked_again(spark, tmp_path, folder):
    questions = spark.createDataFrame([("a",), ("b",), ("a",)], "question string")
    store = A.Store(str(tmp_path / "store"))
    got = A.ask_all(questions, Echo(folder, down="a"), store).collect()
    assert sorted((r.question, r.answer, r.error) for r in got if r.answer is None) == [("a", None, "OSError: no route")] * 2
    assert {(r.question, r.answer, r.error) for r in A.ask_all(questions, Echo(folder), store).collect()} == {("a", "<a>", None), ("b", "<b>", None)}
    assert Counter(q for _, q in log(folder)) == {"a": 2, "b": 1}
    assert A.ask_all(questions.where("false"), Echo(folder), store).count() == 0


def test_one_rate_for_all_tasks(spark, tmp_path, folder):
    """Twelve calls in three lanes at 0.1 s: no lane begins a call before 0.3 s after its last."""
    questions = spark.createDataFrame([(f"q{i}",) for i in range(12)], "question string")
    A.ask_all(questions, Echo(folder), A.Store(str(tmp_path / "store"), lanes=3), delay_s=0.1)
    times = [t for t, _ in log(folder)]
    assert all(b - a >= 0.28 for a, b in zip(times, times[3:]))


@dataclass(frozen=True)
class Model:
    """A transport with a fixed answer for each tool."""

    folder: str
    spoil: str = ""

    def __call__(self, url, headers, body):
        name, text = body["tools"][0]["function"]["name"], body["messages"][1]["content"]
        logged(self.folder, f"{name}: {text}")
        lines = [x[2:] for x in text.splitlines() if x.startswith("- ")]
        if self.spoil == "down":
            raise OSError("no route")
        result = {
            "record_concepts": {"concepts": [{"canonical": " Thin Film ", "paper_term": "ITO ", "relevance": 0.5}, {"canonical": "gap", "paper_term": "1 eV", "relevance": 0.91237}, {"canonical": "none"}, {"canonical": "late", "relevance": 0.5}]},
            "record_values": {"values": [{"canonical": c.upper(), "value": "v", "quote": f"about {c}"} for c in lines] + [{"canonical": "unasked", "value": "x", "quote": ""}]},
            "record_tags": {"tagged_concepts": [{"concept": c, "mds_study_stage": ["tool", "odd"], "mds_supply_chain_level": ["system"]} for c in lines if c != "left"]},
        }[name]
        call = {"function": {"name": name, "arguments": "{broken" if self.spoil == "json" else json.dumps(result)}}
        return {"choices": [{"message": {"content": "no"} if self.spoil == "none" else {"tool_calls": [call]}}]}


def asker(tmp_path, folder, spoil=""):
    return A.Asker(remote.Remote(Settings(model_url="u", model_name="m", model_key="k", delay_s=0), Model(folder, spoil)), A.Store(str(tmp_path / "store")))


PAPERS = [("p", "c", "10.1/x", "Thin films.", "Text on the gap.", "T", None), ("q", None, None, "Thin films.", "", "U", None), ("r", "c", "", "", None, "V", None)]


def test_tables_equal_those_of_the_plain_extractor(spark, tmp_path, folder):
    """The same rows as one call a row gives, papers with one text asked about once, a second run without a call."""
    papers, a = spark.createDataFrame(PAPERS, SCHEMA), asker(tmp_path, folder)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(a.concept_table(papers, 3)) == rows(E.concept_table(papers, a.model, 3))
    assert Counter(q.split(":")[0] for _, q in log(folder)) == {"record_concepts": 1 + 2}
    texts = papers.withColumnRenamed("full_text", "text")
    assert rows(a.value_table(texts, ["gap", "thin film"])) == rows(E.value_table(texts, a.model, ["gap", "thin film"]))
    before = len(log(folder))
    found, table = W.discover_schema(papers, a.model, Settings(top_n=3), store=a.store)
    assert rows(found) == rows(a.concept_table(papers, 3))
    assert table.columns == ["domain", "doi", "gap", "late", "thin film"] and table.count() == 2
    sent = len(log(folder)) - before
    W.discover_schema(papers, a.model, Settings(top_n=3), store=a.store)
    assert sent == 2 and len(log(folder)) == before + sent


@pytest.mark.parametrize("spoil", ["json", "none", "down"])
def test_spoilt_answers(spark, tmp_path, folder, spoil):
    papers, a = spark.createDataFrame(PAPERS[:1], SCHEMA), asker(tmp_path, folder, spoil)
    got = a.concept_table(papers).collect()
    assert [r.error for r in got] == (["OSError: no route"] if spoil == "down" else [])
    assert [r.error for r in a.value_table(papers.withColumnRenamed("full_text", "text"), ["gap"]).collect()] == [r.error for r in got]
    assert a.tags(spark.createDataFrame([("gap", 1)], "concept string, doc_frequency long")).count() == 0


def test_tags_in_batches(spark, tmp_path, folder):
    concepts = spark.createDataFrame([(f"c{i}", i) for i in range(5)] + [("left", 9)], "concept string, doc_frequency long")
    enriched, _ = W.tag_and_draw(concepts, asker=asker(tmp_path, folder), size=4)
    assert {(r.concept, r["mds:studyStage"], r["mds:supplyChainLevel"]) for r in enriched.collect()} == {(f"c{i}", "mds:tool", "mds:system") for i in range(5)} | {("left", "", "")}
    assert sorted(q for _, q in log(folder)) == ["record_tags: - c1\n- c0", "record_tags: - left\n- c4\n- c3\n- c2"]
