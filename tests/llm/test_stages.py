"""Operators of the pipeline on tables with clashing columns, nulls, ties, repeats and long texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from siltstone.llm import common, exact_dedup, packing, simhash, substring_dedup, without

CLASHES = ["_id", "_sha", "_text_sha", "id", "digest", "keep", "rows", "several", "goes", "n", "keep_id", "group_size", "k", "top", "a.b", "Keep_"]


def test_exact_copies_with_clashing_columns(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(["a", "b c", "b  c", "", None, "d" * 5000, *map(str, range(30))])) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    want = {}
    for i, t in rows:
        key = " ".join((t or "").split())
        want[key] = min(want.get(key, 10**9), 10**9 if i is None else i)
    for most in (2, 2048):
        kept = exact_dedup.drop_exact_copies(df, most, 8 * most)
        assert kept.columns == df.columns
        assert Counter((" ".join((r.text or "").split()), 10**9 if r.doc_id is None else r.doc_id) for r in kept.collect()) == Counter(want.items())
    assert exact_dedup.drop_exact_copies(df.limit(0)).collect() == []


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_rows_off_a_list(spark, few):
    """All but the listed ids, by a filter that names many in error, too; nulls and repeated ids stay or go together."""
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(3000)]), f"t{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate([*CLASHES, "_piece", "_bits", "_maybe", "_wrong", "bit"])])
    gone = set(rnd.sample(range(3000), 1500))
    ids = spark.createDataFrame([(i,) for i in gone], "id long")
    for bits in (1 << 29, 1 << 15, 1):  # with 32,768 bits for 1,500 ids three spots are often all set
        got = without.without(df, ids, most_bits=max(bits, without.PIECE), few=few)
        assert got.columns == df.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(r for r in rows if r[0] not in gone)
    assert without.without(df, ids.limit(0)).count() == len(rows)


def test_no_text_is_shuffled_where_ids_are_unique(spark):
    """However long the list of rows to drop is: no exchange carries texts, with automatic broadcasts off."""
    df = spark.createDataFrame([(i, f"text {i % 7} " * 9, "en", "s", 0) for i in range(500)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = df.join(df.select("doc_id"), "doc_id", "left_semi")
        assert any("text" in columns for columns in _exchanged(plain))  # what the test would find
        for stage in (lambda: exact_dedup.drop_exact_copies(df), lambda: P.drop_near_copies(spark, df, None)):
            out = stage()
            assert not any("text" in columns for columns in _exchanged(out))
            assert sorted(r.doc_id for r in out.collect()) == list(range(7))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def _exchanged(df) -> list[set[str]]:
    """The columns that each shuffle of the physical plan carries."""
    out, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            columns = node.output()
            out.append({columns.apply(i).name() for i in range(columns.size())})
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return out


@pytest.mark.parametrize("per_bucket", [1 << 20, 7])
def test_packing_with_clashing_columns(spark, per_bucket):
    rnd = random.Random(6)
    rows = [(1 if i % 3 else i, 0, rnd.choice([64, 64, 1, 5, 33, 40]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, mark int").repartition(4)
    for c in ("salt", "bucket", "nth", "start_of", "_bucket", "_nth", "sequence_id", "offset", "a.b"):
        df = df.withColumn(c, F.lit(3))
    got = packing.pack(df, 64, per_bucket)
    rows_out = got.collect()
    assert got.columns == [*[c for c in df.columns if c not in ("sequence_id", "offset")], "sequence_id", "offset"]
    assert sorted((r.doc_id, r.piece, r.length, r.mark) for r in rows_out) == sorted(rows)
    least = max(sum(r[2] for r in rows) / 64, sum(r[2] > 32 for r in rows))
    assert check_places(rows_out, 64) <= 1.1 * least + 1
    assert packing.pack(df.limit(0), 64).collect() == []


def odd_documents(spark):
    """Rows as of ``documents`` with nulls in every column, blank and very long texts, repeated rows and ids."""
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    texts = [prose(60) for _ in range(30)] + [None, "", " \n", "x" * 200_000, prose(30_000), "語" * 50_000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (3, texts[4], None, None, None), (None, texts[5], None, None, None), (None, None, None, None, None), (None, prose(50), "en", None, 1), (99, texts[6] + " and more", "en", "s", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_odd_rows(spark, name):
    rows, docs = odd_documents(spark)
    out = dict(P.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
    got = out.collect()
    if name != P.STAGES[-1][0]:
        assert out.columns == P.COLUMNS
    key = lambda r: tuple(r)
    if name == "quality_classifier":
        assert Counter(map(key, got)) - Counter(rows) == Counter()
        assert all(Counter(map(key, got))[r] in (0, n) for r, n in Counter(rows).items())  # repeated rows share their fate
    if name == "exact_dedup":
        assert len(got) == len({exact_key(r[1]) for r in rows}) == len({exact_key(r.text) for r in got})
    if name == "simhash_near_dedup":
        texts = {exact_key(r[1]) for r in rows}
        # every text still has a row like it, or one nearly like it; rows of null ids stay
        assert sum(r.doc_id is None for r in got) == sum(r[0] is None for r in rows)
        assert len({exact_key(r.text) for r in got}) >= len(texts) - 3
        assert 99 not in {r.doc_id for r in got}
    if name == "suffix_array_dedup":
        assert {r.doc_id for r in got} >= {0, 1, 2, 3} and all(r.text and r.n_chars == len(r.text) for r in got)
    if name == "best_fit_packing":
        assert check_places(got, 2048) <= sum(r.length for r in got) / 2048 + 3
        assert len({(r.doc_id, r.piece) for r in got}) and sum(r.piece == 0 for r in got) == len(rows)


def check_places(rows, capacity):
    """Sequences used; each is filled without gaps."""
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= capacity
    return len(places)


def exact_key(text):
    import re

    return re.sub("[ \t-\r]+", " ", text or "")


def hot_documents(n, seed=9):
    """A passage in every document, and in every third a second one within it, random text around them."""
    rnd = random.Random(seed)
    passage, short = " ".join(f"common{i}" for i in range(20)), "One line that many have, of over fifty bytes in all."
    return passage, [(i, f"{rnd.random()} {passage} {rnd.random()}" + (f" {rnd.random()} {short} {rnd.random()}" if i % 3 == 0 else "")) for i in range(n)]


def brute_removed(rows, length=50):
    first, out = {}, {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out[i] = sum(gone)
    return out


@pytest.mark.parametrize("hot", [2, 40, 1 << 30])
def test_hot_grams_change_nothing(spark, hot):
    _, rows = hot_documents(700)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in substring_dedup.cut_repeats(df, run_bytes=20_000, hot=hot).collect()}
    assert got == brute_removed(rows)


def test_passage_of_every_document_loads_no_part(spark):
    """20,000 documents with one passage: what runs send of one gram is spread over all parts, evenly; unsplit it would
    all go to one."""
    import numpy as np

    _, rows = hot_documents(20_000)
    parts, hot, per_run = 12, 512, 500
    runs = []
    for a in range(0, len(rows), per_run):
        texts = [t for _, t in rows[a : a + per_run]]
        runs.append((np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])))
    slices = []
    for r, (data, offsets) in enumerate(runs):
        ids, texts = np.arange(len(offsets) - 1), data.tobytes()
        batch = substring_dedup.pa.record_batch([substring_dedup.pa.array(ids), substring_dedup.pa.array([texts[a:b] for a, b in zip(offsets, offsets[1:])], substring_dedup.pa.binary())], ["c0", "c1"])
        body = substring_dedup._run_row([batch], len(texts)).column(1)[0].as_py()
        one = substring_dedup.pa.record_batch([substring_dedup.pa.array([r]), substring_dedup.pa.array([body])], ["run", "body"])
        slices += [b.to_pandas() for b in substring_dedup._hash_blocks(50, parts)([one])]
    hashes = __import__("pandas").concat(slices)

    def most(hot):
        marks = __import__("pandas").concat([substring_dedup._repeated(hot)(p) for _, p in hashes.groupby("part")])
        sent, grams = Counter(), Counter()
        for r, (data, offsets) in enumerate(runs):
            own = {int(p): m for p, m in zip(marks["part"][marks["run"] == r], marks["marks"][marks["run"] == r])}
            for part, keys, *_ in substring_dedup._keys(50, parts)(data, offsets, own, np.zeros(0, np.int64)):
                sent[part] += len(keys)
                grams.update((part, k[: substring_dedup.GRAM].tobytes()) for k in keys)
        return max(grams.values()), max(sent.values()) / (sum(sent.values()) / parts)

    (split, uneven), (whole, _) = most(hot), most(1 << 30)
    assert whole > 15_000 and split < whole / 5 and uneven < 1.5


def test_scratch_tables_go(spark):
    import os

    with common.scratch(spark):
        path = common.staged(spark.range(5)).inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(os.path.dirname(path.removeprefix("file://")))
    kept = common.staged(spark.range(3))
    assert kept.count() == 3


def test_staged_tables_go_with_the_driver(tmp_path):
    """Also when the session was stopped before."""
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession\nfrom siltstone.llm.common import staged\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}/c').getOrCreate()\n"
        "print(staged(s.range(3)).count())\ns.stop()\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("3"), done.stderr[-2000:]
    import time

    for _ in range(50):
        left = [f for _, _, fs in os.walk(tmp_path) for f in fs]
        if not left:
            break
        time.sleep(0.2)
    assert not left


def test_cut_texts_with_clashing_columns(spark):
    passage = "the same passage of more than fifty bytes, which stands in both of them"
    rows = [(1, f"first {passage} end", 7), (2, f"second {passage} end", 8), (None, passage, 9), (2, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    for c in ("run", "part", "body", "copies", "reply", "n_bytes", "c0", "c1", "a.b", "a`b"):
        df = df.withColumn(c, F.col("mark"))
    out = substring_dedup.cut_texts(df)
    got = {r.mark: r for r in out.collect()}
    assert out.columns == df.columns and all(r["a.b"] == r["a`b"] == r.run == r.c1 == m for m, r in got.items())
    assert got[7].text == rows[0][1] and got[8].text == "second" and got[9].text == "" and got[10].text == ""
