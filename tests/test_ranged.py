"""Folds of one key by all tasks, and greedy budgets in rounds, against the plain sequence."""

import pickle
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import assemble, budgets, folds, ranged

MACHINES = {
    "gate": (ranged.speech_gate, lambda rng: (rng.choice([0.9, 0.9, 0.1, None]),)),
    "barge": (ranged.barge_in, lambda rng: (rng.choice([0.9, 0.9, 0.9, 0.9, 0.1]),)),
    "band": (ranged.band_hysteresis, lambda rng: (rng.choice([3.0, -3.0, 0.0, None]),)),
    "lengths": (ranged.Lengths, lambda rng: (rng.random() < 0.8, rng.randrange(99))),
    "changes": (ranged.Changes, lambda rng: (rng.choice(["a", "b", None]),)),
    "streaks": (ranged.Streaks, lambda rng: (rng.random() < 0.6,)),
    "far streaks": (lambda: ranged.Streaks(4, 3), lambda rng: (rng.random() < 0.5,)),
}


def sequence(name, seed, n):
    rng = random.Random(seed)
    if name.endswith("gaps"):
        at, out = 0.0, []
        for _ in range(n):
            at += rng.choice([0.0, 0.5, 1.0, 3.0])
            out.append((at,))
        return ranged.Gaps(2.0 if name == "gaps" else 9.0), out
    make, row = MACHINES[name]
    return make(), [row(rng) for _ in range(n)]


@settings(max_examples=250, deadline=None)
@given(st.sampled_from([*MACHINES, "gaps", "wide gaps"]), st.integers(0, 10**6), st.lists(st.integers(0, 9), min_size=1, max_size=9), st.integers(0, 9))
def test_a_range_is_summed_up_as_a_function_of_its_entry_state(name, seed, slices, ahead):
    machine, rows = sequence(name, seed, ahead + sum(slices))
    columns = lambda part: [list(c) for c in zip(*part)]
    entry = machine.run(machine.start, columns(rows[:ahead]))[0] if ahead else machine.start
    function, at, state = machine.identity(), ahead, entry
    for n in slices:
        if n:
            function = machine.then(function, columns(rows[at : at + n]))
            state = machine.run(state, columns(rows[at : at + n]))[0]
        at += n
    told = pickle.loads(pickle.dumps(machine.told(function)))
    assert machine.apply(told, entry) == state
    pickle.dumps(machine)


def test_a_rule_without_end_is_refused():
    with pytest.raises(ValueError):
        ranged.Finite(0, (1,), lambda s, x: (s + x, (s,)), int, most=50)


@pytest.mark.parametrize("name", [*MACHINES, "gaps"])
@pytest.mark.parametrize("keys", [1, 5])
def test_fold_equals_the_ordered_fold(spark, name, keys):
    machine, rows = sequence(name, 7, 700)
    inputs = [f"x{i}" for i in range(len(rows[0]))]
    kinds = {bool: "boolean", float: "double", int: "long", str: "string"}
    shape = ", ".join(f"{c} {kinds[next(type(r[i]) for r in rows if r[i] is not None)]}" for i, c in enumerate(inputs))
    # One key holds most rows and goes over nearly all ranges; with one key, it holds all.
    table = spark.createDataFrame([(None if i % 97 == 1 and keys > 1 else "hot" if i % 7 or keys == 1 else f"k{i % keys}", i, *r) for i, r in enumerate(rows)], f"k string, i int, {shape}").repartition(5)
    made = {"gate": "a string", "barge": "a boolean", "band": "a string, b string, c boolean", "lengths": "a long, b long", "changes": "a long", "gaps": "a boolean"}.get(name, "a long, b boolean")
    got = ranged.fold(table, ["k"], ["i"], inputs, machine, made, ["i"], parts=13)
    plain = folds.ordered_fold(table, ["k"], ["i"], inputs, lambda: folds.Fed(machine), made, ["i"])
    assert sorted(got.collect(), key=lambda r: r["i"]) == sorted(plain.collect(), key=lambda r: r["i"])
    assert ranged.fold(table.limit(0), ["k"], ["i"], inputs, machine, made, ["i"]).count() == 0
    spread = {r["p"] for r in ranged.dealt(table, ["k"], ["i"], inputs, 13).filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(spread) > 6


def greedy(rows, budget, seed):
    """Admitted ids of (id, amount) by the plain loop."""
    import hashlib

    left, out = round(budget * 10**6), []
    for i, amount in sorted(rows, key=lambda r: hashlib.sha256(f"{seed}|{r[0]}".encode()).hexdigest()):
        if amount is not None and 0 <= round(amount * 10**6) <= left:
            left -= round(amount * 10**6)
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("few", [0, 25, 10**6])
@pytest.mark.parametrize("kind", ["even", "mixed", "giants"])
def test_rounds_admit_what_the_plain_loop_admits(spark, few, kind):
    rng = random.Random(len(kind))
    amount = {"even": lambda: 3.6, "mixed": lambda: rng.choice([None, -1.0, 0.0, rng.random(), rng.random() * 50]), "giants": lambda: rng.choice([1e9, 400.0, 399.5, 0.25])}[kind]
    rows = [(i, "hot" if i % 3 else rng.choice(["b", "c", None]), amount()) for i in range(600)]
    table = spark.createDataFrame(rows, "id long, k string, s double").repartition(4)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(budgets.capped(table, "s", 500.25, (), 5, ["id"], parts=16, few=few)) == greedy([(i, s) for i, _, s in rows], 500.25, 5)
    want = sorted(x for key in ("hot", "b", "c", None) for x in greedy([(i, s) for i, k, s in rows if k == key], 90.5, 5))
    assert ids(budgets.capped(table, "s", 90.5, ["k"], 5, ["id"], parts=16, few=few)) == want
    assert budgets.capped(table.limit(0), "s", 1.0, ["k"], 5, ["id"], few=few).count() == 0


def test_shares_of_a_budget(spark):
    table = spark.createDataFrame([(f"{c}{i}", c, 3600.0) for c in ("kathbath", "indicvoices") for i in range(30)], "id string, corpus string, seconds double")
    kept = budgets.shared_out(table, "seconds", 36_000.0, {"kathbath": 0.3, "indicvoices": 0.7}, "corpus", 0, ["id"])
    assert {r["corpus"]: r["count"] for r in kept.groupBy("corpus").count().collect()} == {"kathbath": 3, "indicvoices": 7}
    with pytest.raises(ValueError, match="add up"):
        budgets.shared_out(table, "seconds", 1.0, {"kathbath": 0.3}, "corpus", 0, ["id"])
    with pytest.raises(ValueError, match="no share"):
        budgets.shared_out(table, "seconds", 1.0, {"kathbath": 1.0}, "corpus", 0, ["id"])


@pytest.mark.parametrize(("size", "block"), [(1, 1), (3, 3), (4, 7), (5, 100)])
def test_windows_reach_across_blocks(spark, size, block):
    rows = [(k, i, i * 10) for k, n in (("hot", 61), ("b", 4), (None, 8)) for i in range(n)]
    got = assemble.windows_ahead(spark.createDataFrame(rows, "k string, i int, v int").repartition(3), ["k"], ["i"], "v", size, block)
    want = [(k, i, [v + 10 * j for j in range(size)]) for k, i, v in rows if i + size <= {"hot": 61, "b": 4, None: 8}[k]]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
