"""The ordered fold against a straightforward sequential replay, on every path it can take."""

import random

import pytest

from ledgerline.operators.balance import fold_movements

SCHEMA = ("seq long, product_id string, store_id string, event_id string, sale_id string, delta long, "
          "must_exist boolean")


def replay(rows, opening, used_events=(), used_sales=()):
    balance, events, sales = dict(opening), set(used_events), set(used_sales)
    results = {}
    for seq, product, store, event_id, sale_id, delta, must_exist in sorted(rows):
        key = (product, store)
        if (sale_id in sales) if must_exist else (event_id in events):
            status = "duplicate"
        elif must_exist and key not in balance:
            status = "product_not_found"
        elif balance.get(key, 0) + delta < 0:
            status = "insufficient_stock" if must_exist else "rejected"
        elif must_exist and event_id in events:
            status = "duplicate_event_id"
        else:
            status = "applied"
            balance[key] = balance.get(key, 0) + delta
            events.add(event_id)
            if must_exist:
                sales.add(sale_id)
        results[seq] = (status, balance.get(key))
    return results


def make_rows(rng, count, keys, id_pool, hot_share=0.0, sales_share=0.3):
    rows = []
    for seq in range(count):
        key = 0 if rng.random() < hot_share else rng.randrange(keys)
        is_sale = rng.random() < sales_share
        delta = -rng.randint(1, 30) if is_sale or rng.random() < 0.5 else rng.randint(1, 30)
        identity = rng.randrange(id_pool)
        rows.append((seq, f"P{key}", "S", f"E{identity}", f"X{rng.randrange(id_pool)}" if is_sale else None,
                     delta, is_sale))
    return rows


def check(spark, rows, opening, hot_rows, **kwargs):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    balances = spark.createDataFrame(
        [(p, s, q) for (p, s), q in opening.items()] or [("none", "none", 0)],
        "product_id string, store_id string, quantity long")
    ledger = fold_movements(frame, order=["seq"], balances=balances, hot_rows=hot_rows, **kwargs)
    got = {r["seq"]: (r["status"], r["quantity_after"]) for r in ledger.collect()}
    return got


@pytest.mark.parametrize("seed", [3])
@pytest.mark.parametrize(
    ("id_pool", "hot_rows"), [(10**9, 10**6), (10**9, 40), (120, 10**6), (120, 60)],
    ids=["plain", "hot", "contested", "hot-contested"],
)
def test_fold_equals_sequential_replay(spark, seed, id_pool, hot_rows):
    rng = random.Random(seed)
    rows = make_rows(rng, 300, 12, id_pool, hot_share=0.4)
    opening = {(f"P{k}", "S"): rng.randrange(50) for k in range(0, 12, 2)}
    expected = replay(rows, opening)
    got = check(spark, rows, opening, hot_rows)
    assert {s: v[0] for s, v in got.items()} == {s: v[0] for s, v in expected.items()}
    # A rejected first event reports zero; every other value equals the running balance.
    assert all(got[s][1] == v[1] or (v[0] == "rejected" and v[1] is None and got[s][1] == 0)
               for s, v in expected.items())


def test_one_key_holding_everything_spreads_over_segments(spark):
    rng = random.Random(7)
    rows = make_rows(rng, 900, 1, 10**9, sales_share=0.0)
    expected = replay(rows, {})
    assert {s: v[0] for s, v in check(spark, rows, {}, 90).items()} == {s: v[0] for s, v in expected.items()}


def test_segments_whose_start_no_trial_covers(spark):
    # Starts in the middle of the decision ladder: no rejection at all would be wrong, and so would a start of 0.
    rows = [(i, "P0", "S", f"E{i}", None, 50 if i == 0 else -7 if i % 3 else 5, False) for i in range(400)]
    expected = replay(rows, {})
    assert {s: v for s, v in check(spark, rows, {}, 50).items()} == expected


def test_ids_used_by_earlier_runs(spark):
    rows = [(0, "P", "S", "E0", None, 5, False), (1, "P", "S", "E1", "X1", -1, True),
            (2, "P", "S", "E2", "X2", -1, True), (3, "P", "S", "E3", "X3", -1, True)]
    used = {"event_id": spark.createDataFrame([("E0",), ("E3",)], "event_id string"),
            "sale_id": spark.createDataFrame([("X1",)], "sale_id string")}
    got = check(spark, rows, {("P", "S"): 9}, 10**6, used_ids=used)
    assert {s: v[0] for s, v in got.items()} == {0: "duplicate", 1: "duplicate", 2: "applied", 3: "duplicate_event_id"}


def test_empty_input(spark):
    assert check(spark, [], {}, 10) == {}


def test_an_order_that_is_not_total_fails(spark):
    rows = [(1, "A", "S", "E1", None, 5, False), (1, "A", "S", "E2", None, 5, False)]
    for hot_rows in (10, 1):
        with pytest.raises(Exception, match="order is not total"):
            check(spark, rows, {}, hot_rows)


def test_rows_of_several_keys_at_one_place(spark):
    rows = [(1, "B", "S", "E1", None, 5, False), (1, "A", "S", "E1", None, 5, False), (2, "A", "S", "E2", None, 1, False)]
    for shuffled in (rows, rows[::-1]):
        ledger = fold_movements(spark.createDataFrame(shuffled, SCHEMA), order=["seq"])
        got = sorted((r["seq"], r["product_id"], r["status"]) for r in ledger.collect())
        assert got == [(1, "A", "applied"), (1, "B", "duplicate"), (2, "A", "applied")]


@pytest.mark.parametrize("length", [2, 12])
def test_chains_of_contested_ids(spark, length):
    """Each id is first refused in one key, or used there, and then comes up in the next."""
    rows, seq = [], 0
    for i in range(length):
        rows.append((seq, f"K{i}", "S", f"E{i}", None, -5 if i % 3 == 0 else 5, False))
        rows.append((seq + 1, f"K{i + 1}", "S", f"E{i}", None, 7, False))
        rows.append((seq + 2, f"K{i}", "S", f"E{i + 1}", None, -3, False))
        seq += 3
    expected = replay(rows, {})
    for hot_rows in (10**6, 3):
        assert {s: v[0] for s, v in check(spark, rows, {}, hot_rows).items()} == {s: v[0] for s, v in expected.items()}


def test_ids_that_do_not_repeat_are_not_remembered(spark):
    from ledgerline.operators.kernels import BalanceKernel
    import numpy as np

    run = BalanceKernel().begin(None)
    columns = {"delta": np.arange(1000), "must_exist": np.zeros(1000, bool), "_special": np.zeros(1000, bool)}
    run.advance(columns, 0, 1000, BalanceKernel().room(1000))
    assert run.events == set() and run.state == sum(range(1000))


def balances_after(deltas, start):
    for d in deltas:
        if start < 0:
            start = d if d >= 0 else start
        elif start + d >= 0:
            start += d
    return start


@pytest.mark.parametrize("size", [1, 3, 30, 1_000_000])
def test_function_of_a_stretch_for_every_start(size):
    from ledgerline.operators.kernels import BalanceKernel, end_for
    import numpy as np

    rng = random.Random(size)
    for length in (1, 5, 60, 400):
        deltas = [rng.randint(-size, size) for _ in range(length)]
        function, limit = BalanceKernel().function(4 * size * length), BalanceKernel().limit()
        columns = {"delta": np.array(deltas), "must_exist": np.zeros(length, bool), "_special": np.zeros(length, bool)}
        cut = length // 3
        function.advance(columns, 0, cut)
        function.advance(columns, cut, length)
        limit.advance(columns, 0, length)
        pieces = function.pieces()
        starts = [-1, *range(40), *(rng.randint(0, 3 * size * length) for _ in range(60)), *(int(x) for x in pieces[0][:200])]
        starts = [s for s in starts if s <= 4 * size * length]
        assert [end_for(*pieces, s) for s in starts] == [balances_after(deltas, s) for s in starts]
        assert all(balances_after(deltas, s) <= max(s + limit.add, limit.floor) for s in starts)
        assert function.highest() == max(end_for(*pieces, s) for s in [*pieces[0], *(pieces[0][1:] - 1), 4 * size * length])


def test_function_of_alerts_for_every_anchor():
    from ledgerline.operators.kernels import DedupKernel, end_for
    import numpy as np

    rng = random.Random(4)
    times = sorted(rng.randint(0, 300) for _ in range(60))
    kernel = DedupKernel(25)
    function = kernel.function(0)
    function.advance({"at_micros": np.array(times)}, 0, 60)
    pieces = function.pieces()
    for start in [kernel.absent, *range(-30, 340)]:
        anchor = start
        for t in times:
            anchor = t if t - 25 > anchor else anchor
        assert end_for(*pieces, start) == anchor


def test_a_thousand_segments_take_two_passes(spark):
    """Every segment starts in the middle of the decision ladder of the one before; no round follows their number."""
    rows = [(i, "P0", "S", f"E{i % 9_000}", None, 50 if i == 0 else -7 if i % 3 else 5, False) for i in range(10_000)]
    expected = replay(rows, {})
    frame = spark.createDataFrame(rows, SCHEMA)
    from ledgerline.operators.kernels import BalanceKernel
    from ledgerline.operators.ordered_fold import SEGMENT, _Fold

    fold = _Fold(BalanceKernel(), ("product_id", "store_id"), ("seq",), None, 20)
    cold, hot = fold.split(fold.mark_repeated(frame), fold.heavy(frame))
    assert cold.isEmpty() and hot.select(SEGMENT).distinct().count() > 900
    got = {r["seq"]: (r["status"], r["quantity_after"]) for r in fold_movements(
        frame.where("seq < 9000"), order=["seq"], hot_rows=20).collect()}
    assert got == {i: expected[i] for i in range(9_000)}


def test_functions_that_are_put_out_in_parts(spark, monkeypatch):
    """Much is refused and quantities are large, so a function would have very many pieces."""
    from ledgerline.operators import kernels

    rng = random.Random(9)
    rows = [(i, f"P{i % 17 // 16}", "S", f"E{i}", None, rng.randint(-900, 500), False) for i in range(1_200)]
    expected = replay(rows, {})
    monkeypatch.setattr(kernels, "MOST_PIECES", 8)
    monkeypatch.setattr(kernels, "STEP", 16)
    got = check(spark, rows, {}, 100)
    assert {s: v[0] for s, v in got.items()} == {s: v[0] for s, v in expected.items()}


def test_repeated_ids_inside_a_segment_are_part_of_its_function(spark):
    # Whether E0 is used up by its first row depends on the balance that the segment starts with.
    rng = random.Random(11)
    rows = [(i, "P0", "S", f"E{i // 2}", f"X{i // 2}" if i % 8 < 2 else None, rng.randint(-9, 7), i % 8 < 2)
            for i in range(600)]
    expected = replay(rows, {("P0", "S"): 4})
    for hot_rows in (60, 10**6):
        got = check(spark, rows, {("P0", "S"): 4}, hot_rows)
        assert {s: v[0] for s, v in got.items()} == {s: v[0] for s, v in expected.items()}


def test_rounds_over_a_large_group_read_only_what_the_kernel_needs(spark, monkeypatch):
    """A group too large for one task is folded several times, but its other columns pass once, at the end."""
    from ledgerline.operators.ordered_fold import _Fold

    rng = random.Random(5)
    rows = make_rows(rng, 120, 6, 40, sales_share=0.0)
    seen, run_cold = [], _Fold.run_cold

    def noted(self, frame, *args, **kwargs):
        seen.append("payload" in frame.columns)
        return run_cold(self, frame, *args, **kwargs)

    monkeypatch.setattr(_Fold, "run_cold", noted)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "concat('text', seq) AS payload")
    ledger = fold_movements(frame, order=["seq"], hot_rows=30)
    expected = replay(rows, {})
    assert {r["seq"]: (r["payload"], r["status"]) for r in ledger.collect()} == {
        s: (f"text{s}", v[0]) for s, v in expected.items()}
    assert len(seen) > 2 and seen == [False] * (len(seen) - 1) + [True]


def test_ids_that_repeat_inside_their_keys_only_are_marked_where_the_rows_are(spark):
    rng = random.Random(21)
    rows = [(seq, f"P{k}", "S", f"E{k}-{rng.randrange(30)}", f"X{k}-{rng.randrange(25)}" if sale else None,
             -rng.randint(1, 9) if sale else rng.randint(-9, 9), sale)
            for seq in range(400) for k, sale in [(rng.randrange(5), rng.random() < 0.5)]]
    opening = {("P0", "S"): 20, ("P1", "S"): 5}
    expected = replay(rows, opening)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    balances = spark.createDataFrame([(*k, q) for k, q in opening.items()],
                                     "product_id string, store_id string, quantity long")
    ledger = fold_movements(frame, order=["seq"], balances=balances)
    assert {r["seq"]: r["status"] for r in ledger.collect()} == {s: v[0] for s, v in expected.items()}
    plan = ledger._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" in plan


def test_rows_taken_one_by_one_and_in_stretches_agree():
    from ledgerline.operators.kernels import BalanceKernel
    import numpy as np

    rng, kernel = random.Random(8), BalanceKernel()
    for start in (None, 0, 12, -4):
        size = 300
        again = [rng.random() < 0.4 for _ in range(size)]
        sale = np.array([rng.random() < 0.5 for _ in range(size)])
        ids = [np.array([f"{name}{rng.randrange(40)}" if a else None for a in again], object) for name in "EX"]
        columns = {"delta": np.array([rng.randint(-9, -1) if s else rng.randint(-9, 9) for s in sale]), "must_exist": sale,
                   "_again_event_id": ids[0], "_again_sale_id": ids[1], "_special": np.array(again),
                   "_blocked_event_id": np.array([a and rng.random() < 0.1 for a in again]),
                   "_blocked_sale_id": np.array([a and rng.random() < 0.1 for a in again])}
        one, other, each, mixed = kernel.begin(start), kernel.begin(start), kernel.room(size), kernel.room(size)
        one._each(columns, 0, size, each)
        for i in range(size):
            if again[i]:
                other._one(columns, i, mixed)
            else:
                other._stretch(columns["delta"], sale, i, i + 1, mixed)
        assert all((a == b).all() for a, b in zip(each, mixed))
        assert (one.state, one.events, one.sales) == (other.state, other.events, other.sales)
