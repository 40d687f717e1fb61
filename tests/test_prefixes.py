import random

import pytest

from linkaudit.operators.prefixes import beginning


def plain(points, prefixes):
    return sorted({(g, t, n, p) for g, t, n in points for h, p in prefixes if None not in (g, t, p) and g == h and t.startswith(p)})


def run(spark, points, prefixes, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = beginning(spark.createDataFrame(points, "group string, text string, n long"), spark.createDataFrame(prefixes, "group string, text string"))
        rows = [(r.group, r.text, r.n, r.prefix) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(rows) == len(set(rows))
    return sorted(rows)


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_prefixes_of_random_texts(spark, parts, seed):
    """Prefixes nested in each other and open over the ends of ranges, characters beyond ASCII, empty texts, nulls."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abé😀/") for _ in range(rng.randrange(n)))
    groups = ["", "g", "g/é", None]
    points = [(rng.choice(groups), rng.choice([text(9), text(9), None]), i) for i in range(300)]
    prefixes = [(rng.choice(groups), rng.choice([text(5), text(5), text(3), None])) for _ in range(80)]
    assert run(spark, points, prefixes, parts) == plain(points, prefixes)


def test_one_prefix_of_all_texts_is_found_in_every_range(spark):
    points = [("site", f"https://host/{i:04d}", i) for i in range(400)]
    prefixes = [("site", "https://host/"), ("site", "https://host/01"), ("other", "https://host/")]
    assert run(spark, points, prefixes, 16) == plain(points, prefixes)


def test_no_prefixes_and_no_points(spark):
    assert run(spark, [("g", "a", 1)], [], 4) == [] == run(spark, [], [("g", "a")], 4)
