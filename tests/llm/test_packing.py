"""Packing on the histogram equals placing piece by piece."""

import random
from collections import Counter, defaultdict

from aerolith.llm import packing


def piece_by_piece(lengths, sizes, overhead):
    bins, left = [], Counter(lengths)
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        if fit:
            room = min(b[0] for b in fit)
            b = next((b for b in fit if b[0] == room))
        else:
            size = packing.least_cost(n, left[n], sizes, overhead)
            b = [size, []]
            bins.append(b)
        b[0] -= n
        b[1].append(n)
        left[n] -= 1
    return bins


def brute_best_fit(lengths, sizes, overhead):
    """Best fit with the tie broken as the plan does: among bins of least room, the one made last with that room."""
    bins, left, clock = [], Counter(lengths), 0
    for n in sorted(lengths, reverse=True):
        clock += 1
        fit = [b for b in bins if b[0] >= n]
        b = max((b for b in fit if b[0] == min(x[0] for x in fit)), key=lambda b: b[2]) if fit else [packing.least_cost(n, left[n], sizes, overhead), [], 0]
        if not fit:
            bins.append(b)
        b[0] -= n
        b[1].append(n)
        b[2] = clock
        left[n] -= 1
    return Counter(tuple(sorted(b[1], reverse=True)) for b in bins)


def test_plan_of_distinct_lengths_is_that_of_brute_force():
    """Where no two pieces are alike, no tie is left open: bin for bin the same."""
    rng = random.Random(5)
    for _ in range(200):
        lengths = rng.sample(range(1, 65), rng.randint(0, 60))
        made = Counter(tuple(n for n, k in contents for _ in range(k)) for _, bins, contents in packing.plan(Counter(lengths), (16, 32, 64), 3) for _ in range(bins))
        assert made == brute_best_fit(lengths, (16, 32, 64), 3)


def test_plan_holds_everything_and_costs_no_more():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 10), 64]) for _ in range(rng.randint(0, 150))]
        made = packing.plan(Counter(lengths), (16, 32, 64), 3)
        assert sum((Counter({n: k * bins}) for _, bins, c in made for n, k in c), Counter()) == Counter(lengths)
        assert all(sum(n * k for n, k in c) <= size for size, _, c in made)
        assert all(size == min(s for s in (16, 32, 64) if s >= sum(n * k for n, k in c)) for size, _, c in made)
        cost = sum(size * bins for size, bins, _ in made)
        brute = sum(min(s for s in (16, 32, 64) if s >= sum(c)) for _, c in piece_by_piece(lengths, (16, 32, 64), 3))
        assert abs(cost - brute) <= 64  # they differ only in which of equally full bins is taken


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, None, 1, 7, 30, 64, 65, 200, 1000])) for i in range(400)] + [(3, 7), (None, 9)] + [(5, 9)] * 75
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(4), (16, 32, 64), 3, a_bucket=20).collect()
    assert Counter(x for _, n in rows for x in ([64] * (n // 64) + [n % 64] * (n % 64 > 0) if n else [0])) == Counter(r.n_tokens for r in out)
    bins = defaultdict(list)
    for r in out:
        if r.n_tokens:
            bins[r.bin_id].append(r)
        else:
            assert (r.bin_id, r.capacity) == (-1, 0)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert members[0].capacity == min(s for s in (16, 32, 64) if s >= at)
    assert sorted(bins) == list(range(len(bins)))
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
