import random
import re
from itertools import combinations

import pytest

from talkmill.llm import neardup as nd


def sets_of(data):
    out = {}
    for key, text in data:
        words = frozenset(re.findall(r"[^\W_]+", text.lower())) if text and key else frozenset()
        if words:
            out.setdefault(key, set()).add(words)
    return out


def brute(data):
    sets = sets_of(data)
    close = lambda a, b: len(a & b) * 10 >= 7 * len(a | b)
    return {(a, b) for a, b in combinations(sorted(sets), 2) if any(close(x, y) for x in sets[a] for y in sets[b])}


def corpus(seed, count):
    rng = random.Random(seed)
    common = "the port of is in and to".split()
    data = []
    for i in range(count):
        if data and rng.random() < 0.5:
            words = rng.choice(data)[1].split()
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
            rng.shuffle(words)
        else:
            words = common + [f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 1, 2, 5, 18, 25, 30, 60]))]
        data.append((f"k{i:04}", " ".join(words) or "x"))
    return data


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_pair_is_lost(spark, rows, seed):
    data = corpus(seed, 350)
    got = {tuple(r) for r in nd.similar_pairs(rows(data, "id string, s string"), "id", "s").collect()}
    assert got == brute(data) and len(got) > 50


def test_bounds():
    t = nd.THRESHOLD
    for a in range(1, 60):
        for b in range(1, a + 1):
            most = max((a + b - 2 * o for o in range(b + 1) if o * 10 >= 7 * (a + b - o)), default=None)
            if most is not None:
                assert most <= nd.most_apart(a + b, t)
                bands = nd.band_limits(60, t)
                at = [next(i for i, x in enumerate(bands) if x[0] <= n <= x[1]) for n in (a, b)]
                assert at[0] - at[1] in (0, 1)
    for band in nd.band_limits(200, t):
        assert 2 * nd.segments_of(band, t, nd.SLACK) >= nd.most_apart(2 * band[1], t) + 1


def test_allocation_is_cheapest():
    rng = random.Random(5)
    from itertools import product

    for _ in range(50):
        costs = [(a := rng.randrange(9), a + rng.randrange(9)) for _ in range(4)]
        units = rng.randint(1, 8)
        price = lambda vs: sum(0 if v < 0 else c[v] for v, c in zip(vs, costs))
        best = min(price(vs) for vs in product((-1, 0, 1), repeat=4) if sum(v + 1 for v in vs) >= units)
        vs = nd.allocate(costs, units)
        assert sum(v + 1 for v in vs) >= units and price(vs) == best


def test_edges(spark, rows):
    data = [("a", "One two three"), ("a", "One two three"), ("b", "three, TWO one!"), ("c", None), ("d", ""), ("e", "?!"), (None, "one two three"), ("f", "one two"), ("g", "Привет мир"), ("h", "привет, МИР"), ("i", "w " * 50_000 + "long"), ("j", "long w")]
    df = rows(data, "id string, s string").selectExpr("*", "1 AS key", "2 AS words", "3 AS sid")
    assert {tuple(r) for r in nd.similar_pairs(df, "id", "s").collect()} == {("a", "b"), ("g", "h"), ("i", "j")}
    assert nd.similar_pairs(df.limit(0), "id", "s").count() == 0
    groups = {r["id"]: (r["group_key"], r["links"]) for r in nd.similar_groups(df, "id", "s").collect()}
    assert groups == {"a": ("a", 0), "b": ("a", 0), "c": ("c", 0), "d": ("d", 0), "e": ("e", 0), "f": ("f", 0), "g": ("g", 0), "h": ("g", 0), "i": ("i", 0), "j": ("i", 0)}


def test_groups_follow_chains(spark, rows):
    base = [f"w{i}" for i in range(20)]
    data = [("k1", " ".join(base)), ("k2", " ".join(base[2:] + ["x1"])), ("k3", " ".join(base[4:] + ["x1", "x2"])), ("k0", "alone")]
    groups = {r["id"]: (r["group_key"], r["links"]) for r in nd.similar_groups(rows(data, "id string, s string"), "id", "s").collect()}
    assert groups["k3"][0] == "k1" and groups["k0"] == ("k0", 0) and groups["k2"][1] == 2
    assert nd.similar_groups(rows([], "id string, s string"), "id", "s").count() == 0
