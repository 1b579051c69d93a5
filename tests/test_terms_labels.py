"""Nested terms, ordinals, label index and graphs against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import graph, labels, ordinals, terms
from siltstone.operators import papers as P

SF = "/root/testdata/sf0.001"


def runs_of(text):
    """Word runs by a loop over words."""
    out, run = [], []
    for token in re.findall(r"[^\W_][\w-]*|[^\w\s-]+", text.lower()):
        if token in X.STOP_WORDS or not (token[0].isalnum()):
            out.append(run)
            run = []
        else:
            run.append(token)
    return [r for r in [*out, run] if r]


def brute_terms(texts, longest, least):
    counts = Counter(" ".join(r[i : i + k]) for t in texts if t for r in runs_of(t) for k in range(1, longest + 1) for i in range(len(r) - k + 1))
    counts = {c: n for c, n in counts.items() if n >= least}
    longer, inside = Counter(), Counter()
    for c, n in counts.items():
        w = c.split(" ")
        for part in {" ".join(w[i : i + k]) for k in range(1, len(w)) for i in range(len(w) - k + 1)}:
            longer[part] += 1
            inside[part] += n
    return {(c, c.count(" ") + 1, n, longer[c], inside[c], (c.count(" ") + 1) * (n - (inside[c] / longer[c] if longer[c] else 0.0))) for c, n in counts.items()}


def test_terms(spark):
    texts = ["Thin film solar cells. Thin film solar cells, thin film growth", "the solar cells of a thin film; thin film thin film", None, "", "of the", "solo", "cell " * 3000 + "x" * 100_000]
    df = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(texts)], "paper string, text string, concept int")
    got = {tuple(r) for r in terms.term_statistics(terms.term_counts(df, longest=4, least=2)).collect()}
    assert got == brute_terms(texts, 4, 2) and any(c == "thin film" and n == 6 for c, _, n, *_ in got)
    kept = terms.terms(df)
    assert {r.concept for r in kept.collect()} == {c for c, _, _, _, _, s in got if len(c) > 4 and s > 0}
    table = {r.paper: r.phrases for r in terms.term_table(df, kept).collect()}
    assert "thin film" in table["0"] and "solar cells" in table["1"] and set(table) == {"0", "1", "6"}
    assert terms.terms(df.where("false")).count() == 0


def test_terms_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("paper"), F.regexp_replace("text", "[^A-Za-z .]", " ").alias("text"))
    assert {tuple(r) for r in terms.term_statistics(terms.term_counts(docs, least=3)).collect()} == brute_terms([r.text for r in docs.collect()], 4, 3)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_numbered(spark, ranges):
    r = random.Random(ranges)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 1, 1, None, r.randrange(99)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, pos int, key int").repartition(6)
    got = ordinals.numbered(df, ["pos", "key"], ["g"], ranges=ranges)
    first = lambda x: (x is not None, x or 0)
    want = []
    for g in ("a", "b", None):
        some = sorted((x for x in rows if x[0] == g), key=lambda x: (first(x[1]), x[2]))
        want += [(*x, i + 1, len(some)) for i, x in enumerate(some)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    whole = ordinals.numbered(df, ["pos", "key"], ranges=ranges, place="n", total="of").orderBy("n").collect()
    assert [(x.n, x.of) for x in whole] == [(i + 1, 400) for i in range(400)] and [x.key for x in whole] == [x[2] for x in sorted(rows, key=lambda x: (first(x[1]), x[2]))]
    assert ordinals.numbered(df.where("false"), ["pos"], ["g"]).count() == 0


def test_no_task_numbers_all_rows(spark):
    df = spark.range(2000).select(F.lit("one").alias("collection"), F.col("id").alias("pos"), F.col("id").cast("string").alias("key"), F.lit("t").alias("title"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = P.progress(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SinglePartition" not in plan and "Window" in plan
    held = ordinals.numbered(df, ["pos"], ["collection"], ranges=8)
    sizes = ordinals.boundaries(df, ["collection", "pos"], 8)
    assert len(sizes) == 7 and held.count() == 2000


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def brute_labels(rows):
    """label -> canonical, by all distances."""
    n = Counter()
    for label, k in rows:
        if label and label.strip():
            n[label.strip().lower()] += k
    allowed = lambda x: 0 if len(x) > labels.LONGEST else 2 if len(x) >= 8 else 1 if len(x) >= 5 else 0
    names, group = sorted(n), {}
    up = {x: x for x in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and find(a) != find(b) and distance(a, b) <= min(allowed(a), allowed(b)):
                up[find(a)] = find(b)
    for x in names:
        group.setdefault(find(x), []).append(x)
    return {x: min(g, key=lambda y: (-n[y], y)) for g in group.values() for x in g}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_by_all_distances(spark, seed):
    """Random labels over few letters, so that edits of every kind meet; sparse enough for several groups."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghij") for _ in range(r.choice([4, 5, 7, 8, 9, 12, 20]))) for _ in range(40)]
    rows = [(x, r.randrange(1, 9)) for x in base]
    for x in base:
        for _ in range(6):
            y = x
            for _ in range(r.choice([1, 1, 2, 2, 3])):
                i = r.randrange(len(y) + 1)
                y = r.choice([y[:i] + y[i + 1 :], y[:i] + r.choice("abcdefghijz") + y[i:], y[:i] + r.choice("abcdefghijz") + y[i + 1 :]])
            rows.append((r.choice([y, y.upper(), f" {y}"]), r.randrange(1, 9)))
    rows += [(None, 5), ("", 5), ("  ", 2), ("x" * 150, 1), ("x" * 151, 1), ("é" * 8, 2), ("é" * 9, 1)]
    got = labels.canonical_labels(spark.createDataFrame(rows, "concept string, doc_frequency long").withColumn("id", F.lit(1)))
    want = brute_labels(rows)
    assert {x.label: x.canonical for x in got.collect()} == want and len(set(want.values())) < len(want)
    sums = defaultdict(int)
    for label, k in rows:
        if label and label.strip():
            sums[want[label.strip().lower()]] += k
    assert {tuple(x) for x in labels.normalized(spark.createDataFrame(rows, "concept string, doc_frequency long"), 10**6).collect()} == set(sums.items())


def test_labels_of_the_documents(spark):
    """The frequent words of the smallest table, by all distances."""
    words = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("concept")).where("length(concept) > 4").distinct()
    rows = words.groupBy("concept").agg(F.count(F.lit(1)).alias("doc_frequency")).where("doc_frequency >= 5")
    assert {x.label: x.canonical for x in labels.canonical_labels(rows).collect()} == brute_labels([tuple(x) for x in rows.collect()])
    assert labels.canonical_labels(rows.where("false")).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 300)] + [(r.randrange(1000, 1060), r.randrange(1000, 1060)) for _ in range(40)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_propagation_is_the_dense_iteration(spark):
    r = random.Random(6)
    nodes, unit = range(30), 1 << 40
    weight = defaultdict(int)
    for _ in range(60):
        a, b = r.sample(nodes, 2)
        w = r.randrange(1, 9)
        weight[a, b] += w
        weight[b, a] += w
    seeds = [(0, "x"), (1, "y"), (2, "x"), (2, "z"), (77, "x"), (0, "x")]
    own = {0: {"x": unit}, 1: {"y": unit}, 2: {"x": unit // 2, "z": unit // 2}, 77: {"x": unit}}
    now = {k: dict(v) for k, v in own.items()}
    for _ in range(6):
        new = {}
        for n in {*nodes, 77}:
            total = sum(w for (a, _), w in weight.items() if a == n)
            mean = Counter()
            for (a, b), w in weight.items():
                if a == n:
                    for label, s in now.get(b, {}).items():
                        mean[label] += w * s
            found = {label: s // total for label, s in mean.items()} if total else {}
            if n in own:
                found = Counter({label: math.floor(s * 0.5) for label, s in found.items()})
                found.update({label: math.floor(s * 0.5) for label, s in own[n].items()})
            found = {label: s for label, s in found.items() if s}
            if found:
                new[n] = found
        now = new
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "a long, b long, weight long")
    got = graph.propagate(edges, spark.createDataFrame(seeds, "node long, label string"), rounds=6)
    assert {(x.node, x.label): x.share for x in got.collect()} == {(n, label): s / unit for n, v in now.items() for label, s in v.items()}


def test_words_of_all_characters_are_those_of_the_runs(spark):
    """Numbers of words and breaks give the runs that the replacements give, whatever characters stand between words."""
    from siltstone.functions import text as X
    from siltstone.operators import terms as T

    odd = [chr(c) for c in [*range(1, 0x3100), *range(0xFE00, 0x10000, 7), *range(0x10000, 0x1F700, 97)] if not 0xD800 <= c < 0xE000]
    r = random.Random(3)
    texts = [" ".join(f"a{c}the{c}{c}b{c} _{c}-of- c" for c in odd[i : i + 50]) for i in range(0, len(odd), 50)]
    texts += ["".join(r.choice(["the", "of", "cell", "x1", "-", "_", "--", " ", "  ", "|", ".", "\n", " ", "\x1c", "The", "İs"]) for _ in range(60)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(X.word_runs(F.col("text")).alias("runs"), X.spaced_words(F.col("text")).alias("words")).collect()
    for row in rows:
        number = T._Numbers()
        got, runs = [number[w] for w in row.words.split()], [[]]
        for i in got:
            if i == 0:
                runs.append([])
            elif i > 0:
                runs[-1].append(number.words[i])
        assert [" ".join(x) for x in runs if x] == [x for x in row.runs if x]


def test_long_runs_take_time_by_their_length(spark):
    """One run of 60,000 words: each n-gram once splits the run anew where words are not bound."""
    import time

    from siltstone.operators import terms as T

    docs = spark.createDataFrame([("p", " ".join(f"w{i % 997}x" for i in range(60_000)))], "paper string, text string")
    t = time.monotonic()
    found = T.term_counts(docs, least=2)
    assert found.count() == 4 * 997 and found.agg(F.sum("occurrences")).first()[0] == 4 * 60_000 - 6
    assert time.monotonic() - t < 60


def test_tags_between_two_sides_and_what_they_leave(spark):
    """Every number of rounds gives what spreading over all edges gives, and shares of past rounds are removed."""
    import glob
    import os

    from siltstone.operators import staging, tagging

    r = random.Random(5)
    pairs = spark.createDataFrame([(f"a{r.randrange(40)}", f"b{r.randrange(60)}") for _ in range(300)], "a string, b string")
    seeds = spark.createDataFrame([(f"a{i}", "xyz"[i % 3]) for i in range(0, 44, 4)] + [("a0", "z")], "node string, label string")
    e = pairs.distinct().withColumn("weight", F.lit(1).cast("long"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    rows = lambda df: sorted(tuple(x) for x in df.where("node LIKE 'a%'").collect())
    for n in (1, 4):
        assert rows(graph.propagate_between(pairs, seeds, n)) == rows(graph.propagate(both, seeds, n))
    folder = staging._folder(pairs).removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    tagging.spread_tags(pairs.toDF("concept", "paper"), seeds.withColumnRenamed("node", "concept"), 6).count()
    assert len(set(glob.glob(f"{folder}/*")) - before) == 5 and os.path.isdir(folder)  # edges, two sizes, seeds, shares


def test_pairs_of_papers_and_terms_come_without_grouping_papers(spark):
    """Blanks of every kind, rows of several batches: each pair once, not gathered by paper."""
    from siltstone.operators import terms as T

    r = random.Random(8)
    odd = [chr(c) for c in range(1, 0x3001) if chr(c).isspace()]
    texts = ["".join(r.choice(["thin", "film", "the", "solar", "cells", "|", "--x"]) + r.choice(odd) for _ in range(r.randrange(60))) for _ in range(300)]
    papers = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "paper long, text string").repartition(3)
    wanted = spark.createDataFrame([(c,) for c in ("thin", "thin film", "film thin solar", "solar cells thin film", "none", "thin", None)], "concept string")

    def holds(text, concept):
        return any(f" {concept} " in f" {run} " for run in map(" ".join, runs_of(text)))

    want = {(i, c) for i, t in enumerate(texts) for (c,) in set(map(tuple, wanted.where("concept IS NOT NULL").collect())) if holds(t, c)}
    found = T.term_pairs(papers, wanted)
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_split_at_all_blanks_in_portions_of_a_batch(monkeypatch):
    import pyarrow as pa

    from siltstone.operators import terms as T

    r = random.Random(9)
    odd = [chr(c) for c in range(1, 0x3001) if chr(c).isspace()]
    texts = ["".join(r.choice(["thin", "\u00e9x", "the", "_", "|", "--x"]) + r.choice(odd) * r.randrange(1, 3) for _ in range(r.randrange(30))) for _ in range(200)] + ["", " ", "a"]
    number = T._Numbers()
    want = [[number.words[i] for i in map(number.__getitem__, t.split()) if i >= 0] for t in texts]
    monkeypatch.setattr(T, "HELD", 300)
    got, portions = [], 0
    for ids, starts, numbers, low, _ in T._held([pa.RecordBatch.from_arrays([pa.array(texts)], ["words"])], 0):
        assert low == len(got)
        portions += 1
        got += [[numbers.words[i] for i in ids[a : b - 1]] for a, b in zip(starts, [*starts[1:], len(ids)])]
    assert got == want and portions > 9


def test_many_labels_beside_each_other_and_no_shuffle_files_left(spark):
    """More labels than a row holds, and what a round has shuffled is gone when it is written."""
    import glob

    from siltstone.operators import staging

    r = random.Random(7)
    pairs = spark.createDataFrame([(f"a{r.randrange(40)}", f"b{r.randrange(60)}") for _ in range(300)], "a string, b string")
    seeds = spark.createDataFrame([(f"a{r.randrange(44)}", f"l{i % 21}") for i in range(60)] + [("a1", None), ("a43", None), (None, "l0")], "node string, label string")
    e = pairs.distinct().withColumn("weight", F.lit(1).cast("long"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    rows = lambda df: sorted(tuple(x) for x in df.where("node LIKE 'a%'").collect())
    for n in (2, 3):
        got = rows(graph.propagate_between(pairs, seeds, n))
        assert got == rows(graph.propagate(both, seeds, n)) and len({x[1] for x in got}) > 2 * graph.WIDE
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    held = lambda: set(glob.glob(f"{folder}/*/shuffle_*.data"))
    before = held()
    staging.packed(pairs.groupBy("a").count())
    assert held() <= before
