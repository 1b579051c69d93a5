"""A remote model's answers, kept by the digest of what was asked.

Questions are rows, made and answers taken apart by the JVM; Python only sends them. What the store holds
already is not asked again: questions meet it by digest before any is sent, and equal questions are one.
The rest goes out in rounds, and each round's answers are in the store before the next begins, so a run
that ends early loses one round at most and a second run asks only what is still open. Failures
are kept as such and asked again by the next run.

One rate holds for all tasks: a round is dealt to ``lanes`` tasks, and each waits ``lanes`` times the delay
between its calls.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import text as X
from siltstone.operators import concepts as C
from siltstone.operators import extraction as E
from siltstone.operators import prompts
from siltstone.operators.remote import Remote
from siltstone.operators.tagging import STUDY_STAGES, SUPPLY_CHAIN_LEVELS
from siltstone.sources.files import parquet_if_any

KEPT = "digest string, answer string, error string, at timestamp"


@dataclass(frozen=True)
class Store:
    """A folder of answers, seen by the driver and all executors."""

    path: str
    round: int = 1000
    lanes: int = 4

    def read(self, spark: SparkSession) -> DataFrame:
        return parquet_if_any(spark, f"{self.path}/answers", KEPT)

    def answered(self, spark: SparkSession) -> DataFrame:
        """digest, answer, error: one row a digest, an answer if there is one, else the last failure."""
        kept = self.read(spark).groupBy("digest")
        found = kept.agg(F.max("answer").alias("answer"), F.max_by("error", "at").alias("error"))
        return found.select("digest", "answer", F.when(F.col("answer").isNull(), F.col("error")).alias("error"))


def digest(question, about: str):
    """Names a question: ``about`` holds all else that an answer depends on."""
    return F.sha2(F.concat(F.lit(about + "\n"), question), 256)


def ask_all(questions: DataFrame, ask: Callable[[str], str], store: Store, about: str = "", delay_s: float = 0.0) -> DataFrame:
    """``questions(question, …)`` plus answer and error. ``ask`` takes a question and gives its answer as text; what
    it raises is the row's error. A null question has neither."""
    spark, lanes = questions.sparkSession, max(1, store.lanes)
    keyed = questions.withColumn("digest", digest(F.col("question"), about))
    known = store.read(spark).where("answer IS NOT NULL").select("digest")
    open_ = keyed.where("question IS NOT NULL").select("digest", "question").join(known, "digest", "left_anti").dropDuplicates(["digest"])

    def send(batches):
        first = True
        for batch in batches:
            for key, question in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if delay_s and not first:
                    time.sleep(delay_s * lanes)
                first = False
                try:
                    answer, error = ask(question), None
                except Exception as e:  # noqa: BLE001  a failed question must not lose the others
                    answer, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([answer], pa.string()), pa.array([error], pa.string())], ["digest", "answer", "error"])

    # what is open is written once, by rounds of bounded size, so no round reads the papers again
    waiting = f"{store.path}/open"
    rounds = max(1, -(-open_.count() // store.round))
    open_.withColumn("round", F.pmod(F.xxhash64("digest"), F.lit(rounds)).cast("int")).write.mode("overwrite").partitionBy("round").parquet(waiting)
    rows = spark.read.schema("digest string, question string, round int").parquet(waiting)
    for number in range(rounds):
        dealt = rows.where(F.col("round") == number).select("digest", "question").repartition(lanes, "digest")
        sent = dealt.mapInArrow(send, "digest string, answer string, error string")
        sent.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{store.path}/answers")
    return keyed.join(store.answered(spark), "digest", "left").drop("digest")


@dataclass(frozen=True)
class Asker:
    """A remote model's tables, each row's question answered once for all runs that share a store."""

    model: Remote
    store: Store

    def _calls(self, rows: DataFrame, question, task: prompts.Task, instructions: str | None = None) -> DataFrame:
        """``rows`` plus calls (tool calls as JSON) and error."""
        model, settings = self.model, self.model.settings
        about = json.dumps([settings.model_name, instructions or task.instructions, task.request()], sort_keys=True)
        asked = rows.withColumn("question", question)
        return ask_all(asked, lambda q: model.calls(task, q, instructions), self.store, about, settings.delay_s).drop("question").withColumnRenamed("answer", "calls")

    def concept_table(self, papers: DataFrame, top_n: int = 25, text: str = "abstract") -> DataFrame:
        """As :func:`extraction.concept_table`."""
        rows = papers.where(~X.missing(F.col(text))).select("paper", F.coalesce("doi", F.lit("")).alias("doi"), F.col(text).alias("_text"))
        got = self._calls(rows, F.concat(F.lit(f"At most {top_n} concepts.\n\n"), "_text"), prompts.DISCOVER).drop("_text")
        found = E.tool_payload(F.col("calls"), prompts.DISCOVER.tool, schemas.CONCEPTS_JSON)["concepts"]
        # most relevant first, as the model gave them where that is equal
        found = F.filter(F.coalesce(found, F.array().cast("array<struct<canonical: string, paper_term: string, relevance: double>>")), lambda c: c.isNotNull())
        ranked = F.transform(found, lambda c, i: F.struct((-F.coalesce(c["relevance"], F.lit(0.0))).alias("less"), i.alias("i"), c["canonical"].alias("canonical"), c["paper_term"].alias("paper_term")))
        rows = got.select("paper", "doi", "error", F.posexplode_outer(F.slice(F.array_sort(ranked), 1, top_n)).alias("pos", "c")).where("c IS NOT NULL OR error IS NOT NULL")
        label = lambda name: F.when(F.col("c").isNotNull(), X.strip(F.coalesce(F.col(f"c.{name}"), F.lit(""))))
        return rows.select("paper", "doi", F.lower(label("canonical")).alias("canonical"), label("paper_term").alias("paper_term"), X.round_exact(-F.col("c.less")).alias("relevance"), F.col("pos").cast("long").alias("pos"), "error")

    def value_table(self, papers: DataFrame, concepts: list[str], text: str = "text") -> DataFrame:
        """As :func:`extraction.value_table`."""
        rows = papers.where(~X.missing(F.col(text))).select("paper", F.col(text).alias("_text"))
        listed = "\n\nConcepts:\n" + "\n".join(f"- {c}" for c in concepts)
        got = self._calls(rows, F.concat("_text", F.lit(listed)), prompts.POPULATE).drop("_text")
        found = E.tool_payload(F.col("calls"), prompts.POPULATE.tool, schemas.VALUES_JSON)["values"]
        rows = got.select("paper", "error", F.posexplode_outer(F.filter(found, lambda v: v.isNotNull())).alias("pos", "v"))
        concept = X.clean_label(F.col("v.canonical"))
        rows = rows.where(F.col("error").isNotNull() | concept.isin(concepts))
        stated = lambda name: F.when(F.col("v").isNotNull(), F.coalesce(F.col(f"v.{name}"), F.lit("")))
        return rows.select("paper", concept.alias("concept"), stated("value").alias("value"), stated("quote").alias("quote"), F.col("pos").cast("long").alias("pos"), "error")

    def tags(self, concepts: DataFrame, size: int = 40) -> DataFrame:
        """concept, stages, levels, pos for ``concepts(concept, doc_frequency)``, a batch a question."""
        batches = C.batches(concepts, size).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct((-F.col("doc_frequency")).alias("less"), "concept"))).alias("all"))
        task = prompts.tag_task(STUDY_STAGES, SUPPLY_CHAIN_LEVELS)
        got = self._calls(batches.select("batch", F.col("all.concept").alias("all")), X.bullets(F.col("all")), task)
        found = E.tool_payload(F.col("calls"), task.tool, schemas.TAGS_JSON)["tagged_concepts"]
        rows = got.select(F.posexplode(found).alias("pos", "t"))
        none = F.array().cast("array<string>")
        return rows.select(X.clean_label(F.col("t.concept")).alias("concept"), F.coalesce("t.mds_study_stage", none).alias("stages"), F.coalesce("t.mds_supply_chain_level", none).alias("levels"), F.col("pos").cast("long").alias("pos"))
