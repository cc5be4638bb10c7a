from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from quireflow.llm.mixing import mix, plan_shares, positions, tilted
from quireflow.llm.packing import best_fit_decreasing, pack
from quireflow.llm.tokens import token_count


def brute(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits)[1]] -= s
        else:
            left.append(capacity - s)
    return sorted(left)


@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_tree_finds_the_tightest_bin(case):
    capacity, sizes = case
    used = Counter()
    for s, b in zip(sizes, best_fit_decreasing(sizes, capacity)):
        used[b] += s
    assert sorted(capacity - u for u in used.values()) == brute(sizes, capacity)


def test_pack(spark):
    items = spark.createDataFrame([(i, n) for i, n in enumerate([0, None, 3, 7, 10, 25, 4, 6, 3])], "id long, n long")
    boxes = spark.createDataFrame([("a", 10), ("b", 100), ("none", 0), ("null", None)], "kind string, capacity int")
    rows = pack(items, "id", "n", boxes, "kind", "capacity").collect()
    for kind, cap in (("a", 10), ("b", 100)):
        mine = [r for r in rows if r["kind"] == kind]
        assert sum(r["piece_size"] for r in mine) == 58
        used = Counter()
        for r in mine:
            used[r["container_id"]] += r["piece_size"]
        assert all(u <= cap for u in used.values()) and all(used[r["container_id"]] == r["container_used"] for r in mine)
        parts = sorted((r["id"], r["piece_no"], r["piece_start"], r["piece_size"]) for r in mine)
        assert len({p[0] for p in parts}) == 7
        assert [p[1:] for p in parts if p[0] == 5] == ([(0, 0, 10), (1, 10, 10), (2, 20, 5)] if cap == 10 else [(0, 0, 25)])
    assert {r["kind"] for r in rows} == {"a", "b"}
    assert pack(items.limit(0), "id", "n", boxes, "kind", "capacity").collect() == []


def test_plan():
    assert plan_shares({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}) == {"a": 30.0, "b": 30.0}
    assert plan_shares({"a": 100, "b": 10, "c": 0}, {"a": 0.4, "b": 0.4, "c": 0.2}, {"a": 1, "b": 2, "c": 9}, 100) == {"a": 80.0, "b": 20.0, "c": 0.0}
    assert plan_shares({}, {"a": 1.0}, {"a": 1}) == {"a": 0.0}


def test_mix(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 10 == 0], 10) for i in range(1000)] + [(2000, None, 10), (2001, "z", 10), (2002, "a", 0), (2003, "a", None)], "id long, src string, n long")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.2, 3), ("empty", 0.1, 4)], "source string, target_share double, max_repeats int")
    out, shares = mix(docs, "id", "src", "n", targets, {"b": tilted(0.8)})
    rows = out.collect()
    assert [r["progress"] for r in rows] == sorted(r["progress"] for r in rows)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["a"]["reached_share"] - 0.7 / 0.9) < 0.01 and abs(got["b"]["reached_share"] - 0.2 / 0.9) < 0.01 and got["empty"]["tokens"] == 0
    assert got["b"]["most_used"] <= 3 and max(Counter((r["id"]) for r in rows if r["source"] == "a").values()) == 1
    late = [r["progress"] for r in rows if r["source"] == "b"]
    assert sum(p > 0.5 for p in late) > 0.6 * len(late)
    assert mix(docs.limit(0), "id", "src", "n", targets)[0].collect() == []


def test_tokens(spark):
    df = spark.createDataFrame([("Hello world",), (None,), ("",), ("<|endoftext|>",)], "t string")
    assert [r[0] for r in df.select(token_count(df.t)).collect()][:3] == [2, 0, 0]


def test_weights_sum_to_one_at_every_moment():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1, "none": 0.0}
    due = positions(shares, {"b": tilted(0.9), "c": [(0.0, 0.0), (0.5, 0.0), (0.75, 1.0), (1.0, 0.2)]})
    assert set(due) == {"a", "b", "c"} and all(p == sorted(p) and p[0] == 0 and abs(p[-1] - 1) < 1e-9 for p in due.values())
    import numpy as np

    for t in np.linspace(0.01, 0.99, 60):  # of all tokens the share t is used when the progress is t
        used = sum(shares[s] * np.interp(t, p, np.linspace(0, 1, len(p))) for s, p in due.items())
        assert abs(used - t) < 2e-3
    assert due["c"][1] > 0.5  # nothing of c in the first half


def test_progress_is_a_position_in_tokens(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], 10) for i in range(6000)], "id long, src string, n long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 1)], "source string, target_share double, max_repeats int")
    rows = mix(docs, "id", "src", "n", targets, {"a": tilted(-0.9), "c": [(0.0, 0.1), (0.8, 0.1), (1.0, 5.0)]})[0].collect()
    total = sum(r["tokens"] for r in rows)
    used = 0
    for r in rows:
        assert abs(used / total - r["progress"]) < 0.01
        used += r["tokens"]


def test_loss_of_shards(spark):
    import random

    rng = random.Random(5)
    items = spark.createDataFrame([(i, min(999, int(rng.lognormvariate(4.5, 0.9)) + 1)) for i in range(20_000)], "id long, n long")
    box = spark.createDataFrame([("a", 1000, "x")], "kind string, capacity int, size string")
    used = []
    for shard in (20_000, 2000):
        got = pack(items, "id", "n", box, "kind", "capacity", shard)
        used.append(got.select("container_id").distinct().count())
        assert got.groupBy("id").count().filter("count > 1").count() == 0 and got.count() == 20_000
    assert used[1] <= 1.01 * used[0]
