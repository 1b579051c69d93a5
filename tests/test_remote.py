import json
import sys
import types
import zlib
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.operators import extraction as E
from siltstone.operators import prompts, remote
from siltstone.operators import tagging as G
from siltstone.plans import workflows as W
from siltstone.sources import papers as SP
from siltstone.sinks.pdf import as_pdf
from siltstone.sources import pdf
from siltstone.sources.config import Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test


@dataclass(frozen=True)
class Fake:
    """A transport that answers each task by a fixed rule; ``spoil`` breaks the answer in some way."""

    spoil: str = ""

    def __call__(self, url, headers, body):
        assert url == "http://model" and headers == {"Authorization": "Bearer k"} and body["model"] == "m"
        name, (system, user) = body["tools"][0]["function"]["name"], body["messages"]
        assert body["tool_choice"] == {"type": "function", "function": {"name": name}} and system["role"] == "system"
        text = user["content"]
        lines = [x[2:] for x in text.splitlines() if x.startswith("- ")]
        result = {
            "record_concepts": {"concepts": [{"canonical": " Thin Film ", "paper_term": "ITO", "relevance": 0.5}, {"canonical": "gap", "paper_term": "1 eV", "relevance": 0.9}, {"canonical": "none"}]},
            "record_labels": {"labels": [" GAP", "thin film", ""]},
            "record_values": {"values": [{"canonical": c, "value": "v", "quote": f"about {c}"} for c in lines] + [{"canonical": "unasked", "value": "x", "quote": ""}]},
            "record_tags": {"tagged_concepts": [{"concept": c, "mds_study_stage": ["tool", "odd"], "mds_supply_chain_level": ["system"]} for c in lines]},
            "record_paper": {"record": {"author": "Bee", "doi": "10.1/x", "device_type": "laser", "gap": "1 eV"}},
        }[name]
        arguments = {"": json.dumps(result), "json": "{broken", "list": "[]"}.get(self.spoil, json.dumps(result))
        call = {"function": {"name": "another" if self.spoil == "name" else name, "arguments": arguments}}
        message = {"content": "no"} if self.spoil == "none" else {"tool_calls": [call]}
        if self.spoil == "down":
            raise OSError("no route")
        return {"choices": [{"message": message}]}


def client(spoil=""):
    return remote.Remote(Settings(model_url="http://model", model_name="m", model_key="k"), Fake(spoil))


PAPERS = [("p", "c", "10.1/x", "Thin films.", "Text on the gap.", "T", [("A", "Bee", "author")])]
PAPER_SCHEMA = f"paper string, collection string, doi string, abstract string, full_text string, title string, authors {schemas.ITEMS['authors'].dataType.simpleString()}"


def test_workflow_with_a_remote_model(spark):
    papers = spark.createDataFrame(PAPERS, PAPER_SCHEMA)
    model = client()
    found, table = W.discover_schema(papers, model, normalize=model.normalize)
    assert [(r.canonical, r.paper_term, r.relevance, r.error) for r in found.collect()] == [("gap", "1 eV", 0.9, None), ("thin film", "ITO", 0.5, None), ("none", "", 0.0, None)]
    assert table.columns == ["domain", "doi", "gap", "thin film"] and tuple(table.first()) == ("c", "10.1/x", "v | about gap", "v | about thin film")
    record = W.structured_extract(papers, ["gap", "lifetime"], model).first().asDict()
    assert record == {"Title": "T", "Author": "Bee", "Institution": "Not Specified", "Country": "Not Specified", "DOI": "https://doi.org/10.1/x", "Device Type": "Not Specified", "gap": "1 eV", "lifetime": "Not Specified"}
    enriched, _ = W.tag_and_draw(spark.createDataFrame([("gap", 2)], "concept string, doc_frequency long"), model.tags)
    assert tuple(enriched.first())[2:] == ("mds:tool", "mds:system")


@pytest.mark.parametrize("spoil", ["json", "list", "none", "name", "down"])
def test_spoilt_answers(spark, spoil):
    """Another tool's name still counts; nothing usable gives nothing; a dead line stays in its row."""
    model = client(spoil)
    rows = E.concept_table(spark.createDataFrame(PAPERS, PAPER_SCHEMA), model).collect()
    if spoil == "name":
        assert len(rows) == 3
    elif spoil == "down":
        assert [r.error for r in rows] == ["OSError: no route"]
    else:
        assert rows == [] and model.normalize(["a"]) == [] and model.record("c", ["gap"]) == {} and model.tags(["a"]) == []
        got = G.attach_tags(spark.createDataFrame([("a", 1)], "concept string, doc_frequency long"), G.offline_tags(spark.createDataFrame([], "concept string")))
        assert got.count() == 1


def test_requests_and_replies_fit():
    from pyspark.sql.types import StructType

    for task in (prompts.DISCOVER, prompts.POPULATE, prompts.tag_task(["a"], ["b"]), prompts.NORMALIZE):
        reply = StructType.fromDDL(task.reply)
        assert reply.names == [task.result]
        items = task.request()["function"]["parameters"]["properties"][task.result]["items"]
        inner = reply[0].dataType.elementType
        assert items.get("required", None) == (inner.names if isinstance(inner, StructType) else None)
    fields = prompts.record_task(["Band gap", "DOI"]).schema["properties"]
    assert list(fields) == [*schemas.FIXED_FIELDS, "band_gap", "doi_val"] == schemas.extraction_struct(["Band gap", "DOI"]).names


def test_no_label_is_cut_silently(spark):
    rows = [(f"p{i}", "c", "", f"word{i}q number", "", "T", None) for i in range(101)]
    papers, got = spark.createDataFrame(rows, PAPER_SCHEMA), []

    class OneEach(E.Offline):
        def concepts(self, text, top_n):
            n = int(text[4:].split("q")[0])
            return [{"canonical": f"label {100 * n + k:05d}", "paper_term": "", "relevance": 1.0} for k in range(100)] + [{"canonical": "label-00000"}]

    _, table = W.discover_schema(papers.limit(100), OneEach(), Settings(top_n=200), normalize=lambda labels: got.extend(labels) or ["one"])
    assert len(got) == len(set(got)) == 10_000 and table.columns[2:] == ["one"]  # the variant label-00000 is no label of its own
    with pytest.raises(ValueError, match="more than 10000"):
        W.discover_schema(papers, OneEach(), Settings(top_n=200), normalize=lambda labels: labels)
    got.clear()
    W.discover_schema(papers, OneEach(), Settings(top_n=200), normalize=lambda labels: got.extend(labels) or ["one"], most_labels=20_000)
    assert len(got) == 10_100


def test_pdf_parser_is_optional(spark, monkeypatch):
    class Reader:
        def __init__(self, data):
            body = data.read()
            if not body.startswith(b"%PDF"):
                raise ValueError("not a PDF")
            self.pages = [types.SimpleNamespace(extract_text=lambda x=x: x.decode() or None) for x in body[4:].split(b"\f")]

    for name, _ in pdf.KNOWN:
        monkeypatch.setitem(sys.modules, name, None)
    assert pdf.parser()(as_pdf("by the own reader")) == "by the own reader"
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    parse = pdf.parser()
    assert parse(b"%PDFone \ftwo\f") == "one two"
    with pytest.raises(ValueError):
        parse(b"no")


def test_first_text_takes_the_first_that_parses(spark):
    def parse(data):
        if not data.startswith(b"%PDF"):
            raise ValueError
        return data[4:].decode()

    rows = [("i", 0, "application/pdf", b"bad"), ("i", 1, "application/pdf", b"%PDFgood"), ("i", 2, "application/pdf", b"%PDFlate"), ("j", 0, "text/html", b"%PDFno"), ("k", 5, "application/pdf", b"%PDF"), ("k", 6, "application/pdf", b"%PDFlate")]
    got = {r.item_key: r.full_text for r in SP.first_text(spark.createDataFrame(rows, schemas.ATTACHMENTS), parse).collect()}
    assert got == {"i": "good", "k": ""}


def test_readers_of_catalogs_items_and_attachments(spark, tmp_path):
    (tmp_path / "catalog.json").write_text('{"name":"A","key":"1","pos":0}\n{"name":"B","key":"2","pos":1}\n{"name":"A","key":"3","pos":2}\n')
    catalog = SP.read_catalog(spark, str(tmp_path / "catalog.json"))
    assert {tuple(r) for r in catalog.collect()} == {("A", "3"), ("B", "2")}
    assert [r.key for r in SP.collection_key(catalog, "A").collect()] == ["3"]
    (tmp_path / "items.json").write_text('{"collection":"A","pos":0,"key":"k","title":"T","authors":[{"firstName":"a","lastName":"b"}]}\n{"pos":1,"key":"n","item_type":"note","title":"N"}\n')
    items = SP.read_items(spark, str(tmp_path / "items.json"))
    assert [(r.key, r.authors[0].lastName) for r in SP.real_items(items).collect()] == [("k", "b")]
    for name, body in (("k/b.pdf", b"second"), ("k/a.pdf", b"\xff"), ("n/x.txt", b"no")):
        (tmp_path / "files" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / name).write_bytes(body)
    texts = SP.first_text(SP.read_attachment_files(spark, str(tmp_path / "files")))
    assert [tuple(r) for r in texts.collect()] == [("k", "second")]
    assert {r.title: r.full_text for r in SP.papers(items, texts).collect()} == {"T": "second"}


def slow_vector(text):
    v = np.zeros(256)
    padded = f" {text.lower()} "
    for i in range(len(padded) - 2):
        v[zlib.crc32(padded[i : i + 3].encode()) % 256] += 1
    return v / np.linalg.norm(v)


def brute_keyphrases(text, n):
    """Each candidate's marginal relevance anew in every round, without matrices."""
    phrases = E.candidates(text)
    doc, vec = slow_vector(text), {p: slow_vector(p) for p in phrases}
    dot = lambda a, b: float((a * b).sum())
    chosen = []
    while phrases and len(chosen) < min(n, len(phrases)):
        gain = lambda p: dot(vec[p], doc) / 2 - (max(dot(vec[p], vec[c]) for c in chosen) / 2 if chosen else 0)
        chosen.append(max((p for p in phrases if p not in chosen), key=gain))
    return {(p, round(dot(vec[p], doc), 4)) for p in chosen}


def test_keyphrases_and_rankings_against_brute_force(spark):
    from siltstone import queries as Q

    sf = "/root/testdata/sf0.001"
    texts = {f"item-{r.item_id}": r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = Q.queries()["keyphrases_mmr"](spark, sf).collect()
    for paper in sorted(texts)[:8]:
        got = {(r.canonical, r.relevance) for r in rows if r.paper == paper}
        want = brute_keyphrases(texts[paper], 20)
        assert len(got & want) >= len(want) - 1  # equal gains may fall either way in the last digit
    order = [r.relevance for r in sorted((r for r in rows if r.paper == "item-1"), key=lambda r: r.pos)]
    assert order == sorted(order, reverse=True)
    found, ranked, matrix = W.local_analytics(Q._abstracts(spark, sf))
    by = {}
    for r in found.collect():
        by.setdefault(r.concept, []).append(r.relevance)
    assert {(r.concept, r.doc_frequency, round(r.avg_relevance, 6)) for r in ranked.collect()} == {(c, len(x), round(sum(x) / len(x), 6)) for c, x in by.items()}
    best = sorted(by, key=lambda c: (-len(by[c]), -sum(by[c]) / len(by[c]), c))[:80]
    assert matrix.columns[1:] == best and matrix.count() == len(texts)
    cells = {r["paper"]: r.asDict() for r in matrix.collect()}
    import re

    for paper in sorted(texts)[:5]:
        for c in best:
            assert cells[paper][c] == " | ".join(s for s in re.split(r"(?<=[.!?])\s+", texts[paper]) if c in s.lower())


def test_sentence_stream_and_late_records(spark, tmp_path):
    from siltstone.streaming import inbox

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"key":"1","title":"A","text":"One cat. Two dogs.","at":"2026-01-01T00:00:00"}\n{"key":"2","title":"a","text":"","at":"2026-01-01T01:00:00"}\n')
    schema = "key string, title string, item_type string, text string, at timestamp"
    stream = inbox.new_papers(inbox.read_inbox(spark, str(tmp_path / "in"), schema), "at", "1 hour")
    inbox.for_each_batch(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "check")).start().awaitTermination()
    assert [r.title_key for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
    sentences = inbox.sentence_stream(inbox.read_inbox(spark, str(tmp_path / "in"), schema).withColumnRenamed("key", "paper"), "cat")
    q = sentences.writeStream.format("memory").queryName("cats").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("cats").collect()] == [("1", "One cat.")]


def test_batches_of_many_frequencies(spark):
    """Numbers run on across powers of two, equal frequencies and equal heads."""
    from siltstone.operators import concepts as C

    rows = spark.range(3000).select(F.concat(F.when(F.col("id") % 3 == 0, "same head ").otherwise("c"), "id").alias("concept"), (F.col("id") * F.col("id") % 700).alias("doc_frequency"))
    got = {r.concept: r.batch for r in C.batches(rows, 7).collect()}
    order = sorted((r.concept, r.doc_frequency) for r in rows.collect())
    assert got == {c: i // 7 for i, (c, _) in enumerate(sorted(order, key=lambda x: (-x[1], x[0])))}


def test_installed_models_take_the_rules_place(spark, monkeypatch):
    from siltstone.operators import models

    for load, library in ((models.noun_chunker, "spacy"), (models.sentence_embedder, "sentence_transformers")):
        monkeypatch.setitem(sys.modules, library, None)
        with pytest.raises(ImportError):
            load()
    word = lambda t: types.SimpleNamespace(text=t, pos_={"the": "DET", "it": "PRON"}.get(t.lower(), "NOUN"))

    class Chunk(list):
        text = property(lambda self: " ".join(w.text for w in self))

    parse = lambda text: types.SimpleNamespace(noun_chunks=[Chunk(map(word, part.split())) for part in text.split(",")])
    monkeypatch.setitem(sys.modules, "spacy", types.SimpleNamespace(load=lambda model: parse))
    chunker = models.noun_chunker("m")
    assert chunker("The Thin Film,it,gap,the thin film,the gap", 1, 4) == ["thin film", "gap"]
    assert chunker("The Thin Film,it,silicon", 2, 4) == ["thin film"]
    encoder = types.SimpleNamespace(encode=lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts])
    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=lambda model: encoder))
    assert np.allclose(models.sentence_embedder("m")(["a", "bcd"]), [[0.6, 0.8], [0.6, 0.8]])
    papers = spark.createDataFrame([("p", "one, two words,"), ("q", "")], "paper string, abstract string")
    got = E.phrase_table(papers, chunker=lambda t, least, longer: [x.strip() for x in t.split(",") if len(x) > longer])
    assert [(r.paper, r.phrases) for r in got.collect()] == [("p", ["two words"])]
    fixed = E.Offline(embed=lambda texts: np.array([[1.0, 0.0] if "b" in t else [0.0, 1.0] for t in texts]))
    assert fixed.concepts("alpha beta", 1)[0]["canonical"] == "beta"


def test_schema_found_unaided_against_brute_force(spark):
    import re

    from siltstone import queries as Q

    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = {r.canonical for r in E.concept_table(Q._abstracts(spark, sf), E.Offline(), Settings().top_n).collect()}
    terms = sorted(labels)[:80]
    got = Q.queries()["discover_schema_unaided"](spark, sf)
    assert got.columns == ["domain", "doi", *terms]
    first = lambda t, c: next((s for s in re.split(r"(?<=[.!?])\s+", t) if c in s.lower()), "")
    assert sorted(map(tuple, got.collect())) == sorted(("benchmark", "", *(first(t, c) for c in terms)) for t in texts)
