"""URL filtering by fixed rules and mined association rules.

Fixed rules decide first: a rule fits its host and all subdomains where the path starts with the
rule's path; the longest wins. The urls they decide are the labels: FP-growth mines which
combinations of up to ``longest`` url tokens go with "block" or "allow" among them. Rules are pruned
by support, confidence and conviction (a rule must at least halve the share of exceptions that its
verdict has among all labels), and a longer rule is dropped unless it is surer than every shorter
one inside it. What no fixed rule decides is matched by an inverted index: each rule is filed under
its rarest token, so a url looks up its own tokens only. The surest matching rule decides; without
any, allow.

No url or token is cut. Tokens that always stand together are mined as one and any of them matches,
and a token of all labelled urls tells nothing and is left out; both change no verdict. What is left
of a url may still be long, and FP-growth's work doubles with each token. So frequent tokens are
dealt into groups, and FP-growth gets a url under choices of ``longest`` groups, with the tokens of those
groups only. Each combination has one choice of its own: its tokens' groups, filled up with the first
others. A url is given under the choices of its own combinations alone, so a short url has few rows
however long others are, and a combination is counted in its choice only, over all labelled urls that
have it. There are as many groups as make each choice ``width`` tokens at most.

Up to ``max_rules`` rules are pruned on the driver and go to all tasks as the index. If there are more, they stay a
table: rules and what is inside them meet in a join, as do the distinct sets of tokens and the rules filed under one of
theirs, so :func:`judge` uses every rule however many there are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
VERDICTS = ("allow", "block")
#: Rules that the driver and each task hold at most; more stay a table.
MAX_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url) -> tuple["F.Column", "F.Column"]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host, path) -> tuple["F.Column", "F.Column"]:
    """Text and verdict of the longest fixed rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def url_tokens(host: str, path: str) -> list[str]:
    """All token kinds of a url, without its numbers: host labels with their place from the right
    and their parts between hyphens, path segments with their place, ending."""
    out = []
    labels = host.split(".")[::-1] if host else []
    for i, x in enumerate(labels):
        out.append(f"h{i}={x}")
        if "-" in x:
            out += [f"part={y}" for y in x.split("-") if y]
    for i, x in enumerate(path.split("/")[1:]):
        stem, dot, end = x.rpartition(".")
        if dot:
            out.append(f"end={end}")
        if (y := stem if dot else x) and not re.search("[0-9]", y):
            out.append(f"p{i}={y}")
    if path.endswith("/"):
        out.append("slash")
    return list(dict.fromkeys(out))


def _tokens(host, path) -> "F.Column":
    @F.pandas_udf("array<string>")
    def of(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([url_tokens(h, p) for h, p in zip(host, path)], dtype=object)

    return of(host, path)


class Rules(list):
    """(tokens, verdict, confidence, support); ``stands`` maps each frequent token to the one that stands
    for it in the rules."""

    def __init__(self, rules=(), stands=None):
        super().__init__(rules)
        self.stands = stands or {}


def mine(judged: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, min_conviction: float = 2.0, longest: int = 4, max_rules: int = MAX_RULES, width: int = 12) -> Rules:
    """Rules from ``judged(host, path, verdict)``, for a driver that can hold ``max_rules``: if there are more, the support
    is raised to the lowest one that leaves no more. (:func:`judge` keeps all.)"""
    classes, rules, total = _all_rules(judged, min_support, min_confidence, min_conviction, longest, width)
    if rules is None:
        return Rules()
    found = _first(rules, max_rules + 1)
    if len(found) > max_rules:
        found = [r for r in found if r.freq > found[-1].freq]
    return _held(found, classes, total)


def _first(rules: DataFrame, n: int) -> list:
    return rules.orderBy(F.desc("freq")).limit(n).collect()


def _held(found: list, classes: list[list[str]], total: int) -> Rules:
    kept = prune([(frozenset(classes[i][0] for i in r.some), VERDICTS[r.label], r.confidence, r.freq / total) for r in found])
    return Rules(kept, {t: tokens[0] for tokens in classes for t in tokens})


def _all_rules(judged: DataFrame, min_support: float, min_confidence: float, min_conviction: float, longest: int, width: int) -> tuple[list[list[str]], DataFrame | None, int]:
    """(classes of tokens that stand together, rules before pruning (some: numbers of classes, label, freq, confidence),
    labelled urls); no table if there is nothing to mine."""
    from pyspark.ml.fpm import FPGrowth

    if longest > width:
        raise ValueError("width must not be less than longest")
    urls = staged(judged.where(F.col("verdict").isin(*VERDICTS)).select(F.monotonically_increasing_id().alias("id"), _tokens("host", "path").alias("tokens"), (F.col("verdict") == VERDICTS[1]).cast("int").alias("label")))
    total, block = urls.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not total:
        return [], None, 0
    least = max(1, int(np.ceil(min_support * total)))
    marks = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"m{i}") for i in range(2)]
    uses = urls.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks).where(F.col("n").between(least, total - 1))
    together = defaultdict(list)
    for r in uses.collect():  # at most the mean number of tokens / min_support
        together[-r.n, r.m0, r.m1].append(r.token)
    classes = [sorted(tokens) for _, tokens in sorted(together.items(), key=lambda x: (x[0][0], min(x[1])))]
    if not classes:
        return [], None, total
    n = len(classes)
    rank = {tokens[0]: i for i, tokens in enumerate(classes)}
    reps = F.array(*[F.lit(t) for t in rank])
    urls = staged(urls.select(F.transform(F.array_intersect("tokens", reps), lambda t: F.array_position(reps, t) - 1).alias("items"), "label"))
    groups = _groups(urls, n, longest, width)
    size = min(longest, groups)
    if groups**size * (n + 2) >= 1 << 63:
        raise ValueError("too many frequent tokens: raise the support")
    dealt = staged(deal(urls, n, groups, size))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(1, dealt.count())).fit(dealt)
    code = lambda x: F.pmod(x, F.lit(n + 2))
    sets = model.freqItemsets.where(F.size("items") <= longest + 1).select(
        F.filter("items", lambda x: code(x) < n).alias("some"), F.get(F.filter("items", lambda x: code(x) >= n), F.lit(0)).alias("label"), "freq"
    )
    sets = sets.where(F.size("some").between(1, longest)).withColumn("some", F.array_sort("some"))
    sets = sets.where(_own_choice(F.transform("some", lambda x: code(x) % groups), groups, size) == F.floor(F.get("some", F.lit(0)) / (n + 2)))
    alone = sets.where("label IS NULL").select("some", F.col("freq").alias("n"))
    share = F.when(F.col("label") == 1, block / total).otherwise(1 - block / total)
    rules = (
        sets.where("label IS NOT NULL").withColumn("label", (code(F.col("label")) - n).cast("int")).join(alone, "some").withColumn("confidence", F.col("freq") / F.col("n"))
        .where((F.col("confidence") >= min_confidence) & (F.col("confidence") > share) & ((1 - F.col("confidence")) * min_conviction <= 1 - share))
        .select(F.array_sort(F.transform("some", code)).alias("some"), "label", "freq", "confidence")
    )
    return classes, rules, total


def _number(choice, groups: int) -> int:
    out = 0
    for g in choice:
        out = out * groups + g
    return out


def _own_choice(of, groups: int, size: int) -> "F.Column":
    """Number of the choice of a combination, given its tokens' groups: :func:`deal` has the same rule."""
    of = F.array_distinct(of)
    first = F.sequence(F.lit(0), F.lit(min(groups, 2 * size) - 1)).cast("array<long>")
    filled = F.array_sort(F.concat(of, F.slice(F.array_except(first, of), F.lit(1), size - F.size(of))))
    return F.aggregate(filled, F.lit(0).cast("long"), lambda a, g: a * groups + g)


def deal(urls: DataFrame, n: int, groups: int, size: int) -> DataFrame:
    """items: each url of ``urls(items, label)``, of ``n`` items, once for each choice of ``size`` groups that is the own choice
    of one of its combinations. Items are numbered anew in each choice; the label is the last."""

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for items, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of = defaultdict(list)
                for i in items:
                    of[i % groups].append(i)
                choices = set()
                for k in range(1, min(size, len(of)) + 1):
                    for some in combinations(sorted(of), k):
                        rest = [g for g in range(min(groups, 2 * size)) if g not in some][: size - k]
                        choices.add(tuple(sorted([*some, *rest])))
                for choice in choices:
                    some = [i for g in choice for i in of.get(g, ())]
                    rows.append([_number(choice, groups) * (n + 2) + i for i in [*some, n + label]])
                    held += len(some)
                if held > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["items"])
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["items"])

    return urls.mapInArrow(run, "items array<long>")


def _groups(urls: DataFrame, n: int, longest: int, width: int) -> int:
    """The fewest groups (of ranks with the same remainder) so that no ``longest`` of them hold more than
    ``width`` items of a url; 1 if no url has more. A group for each item always does."""
    sizes = [1, *(g for g in range(longest + 1, 33)), *(1 << k for k in range(6, 31))]
    sizes = [g for g in sizes if g < n] + [max(n, 1)]
    most = lambda g: F.aggregate(F.slice(F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda r: F.size(F.filter("items", lambda i: i % g == r))), False), 1, longest), F.lit(0), lambda a, x: a + x)
    longest_url = urls.agg(F.max(F.size("items"))).first()[0] or 0
    if longest_url <= width:
        return 1
    for g in sizes[1:]:
        if g * width >= longest * longest_url and urls.agg(F.max(most(g))).first()[0] <= width:
            return g
    return n


def prune(rules):
    """Drops rules that are no surer than a shorter rule of the same verdict inside them."""
    sure = {(r[0], r[1]): r[2] for r in rules}
    inside = lambda r: (frozenset(c) for k in range(1, len(r[0])) for c in combinations(r[0], k))
    kept = [r for r in rules if not any(sure.get((s, r[1]), -1) >= r[2] for s in inside(r))]
    return sorted(kept, key=lambda r: (len(r[0]), sorted(r[0]), r[1]))


def prune_table(rules: DataFrame) -> DataFrame:
    """:func:`prune` of a table ``rules(some, label, freq, confidence)``."""
    parts = "transform(sequence(1, shiftleft(1, size(some)) - 2), m -> filter(some, (x, i) -> (shiftright(m, i) & 1) = 1))"
    inside = rules.where(F.size("some") > 1).select("some", "label", "confidence", F.explode(F.expr(parts)).alias("part"))
    shorter = rules.select(F.col("some").alias("part"), "label", F.col("confidence").alias("sure"))
    weak = inside.join(shorter, ["part", "label"]).where("sure >= confidence").select("some", "label").distinct()
    return rules.join(weak, ["some", "label"], "left_anti")


def match_table(sets: DataFrame, rules: DataFrame, n: int) -> DataFrame:
    """have, found: the verdict of the surest rule of ``rules(some, label, freq, confidence)`` inside each set of
    ``sets(have)``, distinct sets of numbers below ``n``. Sets without a rule are left out."""
    uses = dict(rules.select(F.explode("some").alias("i")).groupBy("i").agg(F.count(F.lit(1))).collect())
    used = F.array(*[F.lit(uses.get(i, 0)).cast("long") for i in range(n)])
    filed = F.array_min(F.transform("some", lambda i: F.struct(F.get(used, i.cast("int")).alias("uses"), i.alias("i"))))["i"]
    filed = rules.select("some", filed.alias("at"), F.struct("confidence", "freq", F.size("some").alias("longer"), (F.col("label") == 0).alias("allow")).alias("best"))
    asked = sets.select("have", F.explode("have").alias("at"))
    fits = asked.join(filed, (asked["at"] == filed["at"]) & (F.size(F.array_except("some", "have")) == 0))
    return fits.groupBy("have").agg(F.max("best").alias("best")).select("have", F.when(F.col("best.allow"), VERDICTS[0]).otherwise(VERDICTS[1]).alias("found"))


class Index:
    """Rules filed under one token each: the one that fewest rules have."""

    def __init__(self, rules):
        self.stands = getattr(rules, "stands", {})
        uses = defaultdict(int)
        for r in rules:
            for t in r[0]:
                uses[t] += 1
        self.by_token = defaultdict(list)
        for r in rules:
            self.by_token[min(r[0], key=lambda t: (uses[t], t))].append(r)

    def verdict(self, tokens: list[str]) -> str:
        have = {self.stands.get(t, t) for t in tokens}
        fits = [r for t in have for r in self.by_token.get(t, ()) if r[0] <= have]
        # surest first; then more support, more tokens; a tie of all goes to allow
        return max(fits, key=lambda r: (r[2], r[3], len(r[0]), r[1] == "allow"), default=(None, "allow"))[1]


def judge(pages: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, max_rules: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages(page_id, url)``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and has no token:
    allow. Repeated rows get equal results. Without decided urls nothing is mined. An empty table
    gives an empty result; other columns are not read. ``max_rules`` only says how rules are held, all count.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    judged = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    classes, rules, total = _all_rules(judged.select("host", "path", "verdict"), min_support, min_confidence, 2.0, 4, 12)
    found = [] if rules is None else _first(rules, max_rules + 1)
    if len(found) > max_rules:
        return _judge_by_table(judged, classes, staged(prune_table(staged(rules))))
    index = Index(_held(found, classes, total))

    @F.pandas_udf("string")
    def by_index(host: pd.Series, path: pd.Series, verdict: pd.Series) -> pd.Series:
        return pd.Series([v if isinstance(v, str) else index.verdict(url_tokens(h, p)) for h, p, v in zip(host, path, verdict)], dtype=object)

    return judged.select("page_id", "host", "path", "rule", by_index("host", "path", "verdict").alias("verdict"))


def _judge_by_table(judged: DataFrame, classes: list[list[str]], rules: DataFrame) -> DataFrame:
    """What no fixed rule decides by rules that stay a table; each distinct set of frequent tokens is matched once."""
    number = {t: i for i, tokens in enumerate(classes) for t in tokens}

    @F.pandas_udf("array<long>")
    def numbers(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([sorted({number[t] for t in url_tokens(h, p) if t in number}) for h, p in zip(host, path)], dtype=object)

    names = ["page_id", "host", "path", "rule"]
    rest = staged(judged.where("verdict IS NULL").select(*names, numbers("host", "path").alias("have")))
    found = match_table(rest.select("have").where(F.size("have") > 0).distinct(), rules, len(classes))
    matched = rest.where(F.size("have") > 0).join(found, "have", "left").select(*names, F.coalesce("found", F.lit(VERDICTS[0])).alias("verdict"))
    without = rest.where(F.size("have") == 0).select(*names, F.lit(VERDICTS[0]).alias("verdict"))
    return judged.where("verdict IS NOT NULL").unionByName(matched).unionByName(without)
