"""The most frequent values against plain counts."""

import collections
import random

import pytest

from pagequarry.operators import frequent


def rows(spark, seed, n=3000, values=400):
    rng = random.Random(seed)
    data = [(f"v{min(int(rng.paretovariate(0.7)), values)}", rng.choice("ab"), rng.randrange(1, 4), i) for i in range(n)]
    return data, spark.createDataFrame(data, "value string, kind string, n long, first long").repartition(5)


@pytest.mark.parametrize("size,top", [(5, 3), (40, 10), (1000, 500), (1, 1)])
def test_equal_to_plain_counts(spark, size, top):
    data, table = rows(spark, size)
    counts, first = collections.Counter(), {}
    for value, kind, n, place in data:
        counts[value, kind] += n
        first.setdefault((value, kind), place)
    want = sorted(counts, key=lambda k: (-counts[k], first[k]))[:top]
    got = frequent.most_frequent(table, ["value", "kind"], "first", top, size).orderBy("rank").collect()
    assert [(r.value, r.kind, r["count"], r["first"]) for r in got] == [(*k, counts[k], first[k]) for k in want]


def test_summaries_are_small_and_miss_no_more_than_they_say(spark):
    data, table = rows(spark, 7)
    found = frequent.summaries(table, ["value"], 20).collect()
    counts = collections.Counter()
    for value, _, n, _ in data:
        counts[value] += n
    kept = collections.Counter()
    for r in found:
        if r.missed is None:
            kept[r.value] += r.n
    missed = sum(r.missed for r in found if r.missed is not None)
    assert len(found) <= 5 * 21
    assert all(kept[v] <= n <= kept[v] + missed for v, n in counts.items())


def test_an_empty_table(spark):
    _, table = rows(spark, 1)
    assert frequent.most_frequent(table.limit(0), ["value"], "first", 5).collect() == []


def test_all_values_alike(spark):
    table = spark.range(500).selectExpr("cast(id as string) as value", "1L as n", "id as first").repartition(4)
    got = frequent.most_frequent(table, ["value"], "first", 3, 10).orderBy("rank").collect()
    assert [(r.value, r["count"]) for r in got] == [("0", 1), ("1", 1), ("2", 1)]
