from datetime import date

import pytest

from siltstone.plans import workflows as W
from siltstone.sinks import tables
from siltstone.sources import concepts as S
from siltstone.sources import files
from siltstone.sources.config import Settings, tool_choice
from siltstone.streaming import inbox


def test_csv_round_trip_and_sniffing(spark, tmp_path):
    df = spark.createDataFrame([("p", "A, \"b\"\nc"), ("q", "")], "paper string, concept string")
    tables.write_csv(df, str(tmp_path / "a"), first="paper", single=True)
    back = S.read_csv(spark, str(tmp_path / "a"))
    assert back.columns == ["paper", "concept"] and {r.concept or "" for r in back.collect()} == {"A, \"b\"\nc", ""}
    assert S.concept_list(back) == ["a, \"b\"\nc"]
    wide = spark.createDataFrame([("d", "x", "1")], "Domain string, DOI string, `Band Gap` string")
    assert S.concept_list(wide) == ["Band Gap"]
    ranked = spark.createDataFrame([(" B ", "2"), ("A", "2"), (None, "9"), ("", "1")], "Concept string, doc_frequency string")
    assert [tuple(r) for r in S.load_concepts(ranked).collect()] == [("A", 2), ("B", 2)]
    with pytest.raises(ValueError):
        S.load_concepts(wide)
    assert not tables.write_unless_empty(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    tables.write_twice(df, str(tmp_path / "one"), str(tmp_path / "two"))
    assert S.read_csv(spark, str(tmp_path / "two")).count() == 2
    assert tables.preview(df, ["concept", "missing"], 1).splitlines()[0] == "| concept |"
    assert tables.file_name("rankings", "My Set", "me", 2, date(2026, 3, 4)) == "rankings_my_set-me-v2-20260304.csv"


def test_files_and_tag_all(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "concepts_a-x.csv").write_text("concept,doc_frequency\nthin film,3\n")
    (tmp_path / "in" / "deep" / "concepts_b-x.csv").write_text("nothing\n1\n")
    assert files.latest(spark, str(tmp_path / "in"), "concepts_*.csv").endswith("concepts_b-x.csv")
    assert files.latest(spark, str(tmp_path / "in"), "rankings_*.csv") is None
    done = W.tag_all(spark, str(tmp_path / "in"), str(tmp_path / "out"), date(2026, 3, 4))
    assert sorted(v.split(":")[0] for v in done.values()) == ["ValueError", "ok"]
    assert (tmp_path / "out" / "diagram_concepts_a-x-v6-20260304.drawio").read_text().startswith("<mxfile")


def test_settings():
    s = Settings.from_env({"SILTSTONE_BATCH": "7", "SILTSTONE_FORCED_TOOL": "no", "SILTSTONE_MODEL_KEY": "secret"})
    assert s.batch == 7 and tool_choice(s, "t") == "auto" and "secret" not in repr(s)


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(('{"key":"1","title":"A"}\n{"key":"2","title":"B"}\n', '{"key":"3","title":"a"}\n{"key":"4","title":"C"}\n')):
        (tmp_path / "in" / f"{i}.json").write_text(rows)
    stream = inbox.new_papers(inbox.read_inbox(spark, str(tmp_path / "in"), "key string, title string, item_type string", 1))
    for _ in range(2):  # the second run finds nothing new
        inbox.for_each_batch(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "check")).start().awaitTermination()
    assert sorted(r.title_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_stream_rankings(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a", 1.0), ("q", "a", 0.0), ("p", "b", 0.5)], "paper string, concept string, relevance double")
    rows.write.parquet(str(tmp_path / "in"))
    q = inbox.stream_rankings(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("ranks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("ranks").collect()] == [("a", 2, 0.5), ("b", 1, 0.5)]
