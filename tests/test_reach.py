from __future__ import annotations

import random

from statuta.operators import reach


def led(links, ends):
    found = set(ends)
    while more := {a for a, b in links if b in found} - found:
        found |= more
    return found


def run(spark, links, ends, rounds=None):
    df = spark.createDataFrame(links, "id string, target string").repartition(3)
    return {r.id for r in reach.leading_to(df, spark.createDataFrame([(e,) for e in ends], "id string"), rounds).collect()}


def test_random_links(spark):
    rng = random.Random(1)
    for n, m in ((8, 10), (30, 40), (60, 60)):
        links = [(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)]
        links += [(b, a) for a, b in links[: m // 4]]
        ends = [str(rng.randrange(n)) for _ in range(2)]
        assert run(spark, links, ends) == led(links, ends)


def test_a_chain_of_ten_thousand_takes_few_rounds(spark):
    n, rounds = 10_000, []
    links = [(f"{i:05d}", f"{i + 1:05d}") for i in range(n)] + [("x", "y"), ("y", "z"), ("z", "x")]
    assert len(run(spark, links, [f"{n:05d}"], rounds)) == n + 1 and len(rounds) <= 20
    rounds = []
    both = links + [(b, a) for a, b in links[:n]]  # chains whose records point back
    assert len(run(spark, both, ["04000"], rounds)) == n + 1 and len(rounds) <= 20


def test_circles_loops_and_nothing(spark):
    assert run(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], ["q"]) == {"q"}
    assert run(spark, [("a", "b"), ("b", "c"), ("c", "a")], ["c"]) == {"a", "b", "c"}
    assert run(spark, [], ["q"]) == {"q"} and run(spark, [("a", "b")], []) == set()
