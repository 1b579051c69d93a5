"""Short urls stay few rows however long others are, and combinations are counted exactly."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from siltstone.llm import url_filter as U


def page(r, n, letters):
    path = "/" + "/".join(r.choice(letters) for _ in range(n))
    return "host.org", path, "block" if path.startswith("/a") == (r.random() < 0.9) else "allow"


@pytest.mark.parametrize("long", [20, 40])
def test_rows_of_short_urls(spark, long):
    rnd = random.Random(long)
    r = [page(rnd, 5, "abcdef") for _ in range(400)] + [page(rnd, long, "ab") for _ in range(12)]
    seen = {}
    deal = U.deal

    def watched(urls, n, groups, size):
        out = deal(urls, n, groups, size)
        rows = urls.collect()
        seen.update(short=deal(urls.where("size(items) <= 8"), n, groups, size).count(), urls=sum(len(x.items_) <= 8 for x in urls.withColumnRenamed("items", "items_").collect()), all=out.count(), groups=groups, rows=len(rows))
        return out

    U.deal = watched
    try:
        rules = U.mine(spark.createDataFrame(r, "host string, path string, verdict string"), 0.01, 0.6, 1.2)
    finally:
        U.deal = deal
    assert seen["groups"] > 4 and seen["short"] <= 40 * seen["urls"]
    want = Counter()
    tokens = [({rules.stands.get(t, t) for t in U.url_tokens(h, p)}, v) for h, p, v in r]
    for some, verdict, confidence, support in rules:
        n = sum(some <= have for have, _ in tokens)
        hits = sum(some <= have and v == verdict for have, v in tokens)
        assert confidence == hits / n and support == hits / len(r)
        want[len(some)] += 1
    assert len(want) > 1  # rules of several lengths
    # no rule is missing: all combinations of up to four, by brute force over the same tokens, pruned alike
    total, block = len(r), sum(v == "block" for _, _, v in r)
    standing = set(rules.stands.values())
    both, alone = Counter(), Counter()
    for have, v in tokens:
        for k in range(1, 5):
            for c in combinations(sorted(have & standing), k):
                alone[c] += 1
                both[c, v] += 1
    share = {"block": block / total, "allow": 1 - block / total}
    least = math.ceil(0.01 * total)
    found = [(frozenset(c), v, m / alone[c], m / total) for (c, v), m in both.items() if m >= least and m / alone[c] >= 0.6 and m / alone[c] > share[v] and (1 - m / alone[c]) * 1.2 <= 1 - share[v]]
    assert rules == U.prune(found)
