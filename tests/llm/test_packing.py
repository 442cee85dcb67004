import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexflow.llm.packing import _encoding, TOKENIZER, best_values, configuration_plan, fractional_solution, pack_documents
from lexflow.runtime import table


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
def test_plan_meets_demand_exactly(histogram):
    lengths, demand = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    plan, told = configuration_plan(lengths, demand, 40)
    assert (sum(content * times for content, times in plan) == demand).all()
    assert all((content * lengths).sum() <= 40 and times > 0 for content, times in plan)
    assert told["bound"] <= sum(times for _, times in plan) + 1e-6
    assert sum(times for _, times in plan) <= 2 * -(-int((lengths * demand).sum()) // 40) + 1


@pytest.mark.parametrize("demand_times", [1, 10, 1000])
def test_program_itself_places_nearly_all(demand_times):
    rng = np.random.default_rng(7)
    lengths, demand = np.unique(np.clip(rng.lognormal(4.2, 0.8, 20_000).astype(np.int64), 1, 256), return_counts=True)
    demand = demand * demand_times
    plan, told = configuration_plan(lengths, demand, 256)
    volume = -(-int((lengths * demand).sum()) // 256)
    assert (sum(content * times for content, times in plan) == demand).all()
    assert told["gap"] <= 0.011 and told["tokens"] > 0.95 and told["pieces"] > 0.85
    assert 0.99 * volume - 1 <= told["bound"] <= sum(times for _, times in plan) <= 1.004 * volume + 1


def test_solution_covers_demand_and_bound_is_proved():
    lengths, demand = np.array([3, 5, 7, 11]), np.array([40, 30, 20, 10])
    contents, prices, best, bound, gap = fractional_solution(lengths, demand, 22, np.random.default_rng(3))
    covered = np.zeros(4)
    for on, k, amount in contents:
        assert (lengths[on] * k).sum() <= 22 and amount > 0
        covered[on] += k * amount
    short = np.maximum(demand - covered, 0)
    value = sum(c[2] for c in contents) + (short / (22 // lengths)).sum()
    assert abs(value / bound - 1 - gap) < 1e-9 and (prices * demand).sum() / best[-1] <= bound + 1e-9 <= value + 1e-6


def test_best_values_against_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(3):
        sizes, values = np.unique(rng.integers(1, 9, 4)), rng.random(4)
        values = values[: len(sizes)]
        best = best_values(values, sizes, 15)
        for room in range(16):
            assert abs(best[room] - max(np.dot(values, c) for c in np.ndindex(*(16,) * len(sizes)) if np.dot(sizes, c) <= room)) < 1e-9


def check(packed, sizes, caps):
    for cap_id, cap in caps.items():
        rows = [r for r in packed if r.capacity_id == cap_id]
        load, pieces = {}, {}
        for r in rows:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append(r)
        assert max(load.values()) <= cap and pieces.keys() == sizes.keys()
        for doc, own in pieces.items():
            own.sort(key=lambda r: r.piece_no)
            assert sum(r.n_tokens for r in own) == sizes[doc] and len(own) == max(1, -(-sizes[doc] // cap))
            assert all(r.n_tokens == cap for r in own[:-1]) and [r.from_token for r in own] == [k * cap for k in range(len(own))]
        yield 1 - sum(load.values()) / max(1, len(load) * cap)


def test_whole_table_is_packed_tightly(spark):
    docs, capacities = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "pack_capacities")
    encode = _encoding(TOKENIZER).encode_ordinary
    sizes = {r.doc_id: len(encode(r.text or "")) for r in docs.collect()}
    waste = list(check(pack_documents(docs, capacities).collect(), sizes, {r.capacity_id: r.max_tokens for r in capacities.collect()}))
    assert max(waste) < 0.012


def test_nulls_copies_long_texts_and_clashing_names(spark):
    rows = [(1, ""), (2, None), (3, "word " * 5000), (4, "a b c"), (5, "a b c"), (6, "a b c"), (4, "a b c"), (None, "lost")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("capacity_id", F.lit(9))
    caps = spark.createDataFrame([(1, 16), (1, 16), (2, None), (3, 0), (None, 5)], "capacity_id long, max_tokens long")
    packed = pack_documents(docs, caps).collect()
    encode = _encoding(TOKENIZER).encode_ordinary
    assert list(check(packed, {i: len(encode(t or "")) for i, t in rows if i}, {1: 16})) and {r.capacity_id for r in packed} == {1}
    assert pack_documents(docs.limit(0), caps).count() == 0 and pack_documents(docs, caps.limit(0)).count() == 0
