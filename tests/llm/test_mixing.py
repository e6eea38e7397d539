import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from polycat.llm import mixing


def ideal(blocks, weights, slots):
    """What each source should have had placed before each slot: fluid, in fractions, phase after phase."""
    left, got, now, out = dict(blocks), dict.fromkeys(blocks, Fraction(0)), Fraction(0), []
    for t in range(slots + 1):
        while now < t:
            live = [s for s in left if got[s] < left[s]]
            if any(weights[s] > 0 for s in live):
                live = [s for s in live if weights[s] > 0]
                rate = {s: Fraction(weights[s]) for s in live}
            else:
                rate = dict.fromkeys(live, Fraction(1))
            total = sum(rate.values())
            step = min([t - now, *((left[s] - got[s]) * total / rate[s] for s in live)])
            for s in live:
                got[s] += step * rate[s] / total
            now += step
        out.append(dict(got))
    return out


def worst_drift(slots, weights):
    """How far the blocks placed of any source ever are from its share, over all slots to the last."""
    order = [s for _, s in sorted((t, s) for s, x in slots.items() for t in x)]
    shares, seen, worst = ideal({s: len(x) for s, x in slots.items()}, weights, len(order)), Counter(), Fraction(0)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, *(abs(seen[x] - shares[t][x]) for x in slots))
    return worst


def windows(blocks, weights):
    """(deadline, place of the source, block, release) of every block, from the ideal shares in fractions."""
    out = []
    for k, (n, w) in enumerate(zip(blocks, weights, strict=True)):
        at = [sum(min(v * Fraction(j, w), m) for m, v in zip(blocks, weights, strict=True)) for j in range(n + 1)]
        out += [(-(-at[j + 1] // 1), k, j, at[j] // 1) for j in range(n)]
    return out


def brute(blocks, weights):
    """Slot by slot: of the released blocks the one with the earliest deadline."""
    waiting, out = sorted(windows(blocks, weights)), {}
    for t in range(sum(blocks)):
        pick = next(x for x in waiting if x[3] <= t)
        assert t < pick[0]
        waiting.remove(pick)
        out[pick[1], pick[2]] = t
    return out


def scheduled(spark, blocks, weights):
    return {(r.k, r.block): r.slot for r in mixing.schedule(spark, list(zip(blocks, weights, strict=True))).collect()}


@pytest.mark.parametrize("length", [1, 7, 64])
def test_segments_are_those_of_one_schedule(spark, monkeypatch, length):
    """Earliest deadline first over all slots, whatever segments they are cut into."""
    monkeypatch.setattr(mixing, "SEGMENT", length)
    monkeypatch.setattr(mixing, "PER_SOURCE", 0)
    draw = random.Random(length)
    cases = [([5], [3]), ([4, 4, 4], [1, 1, 1]), ([1, 1, 1, 1, 1, 1], [1] * 6), ([30, 5, 5, 5, 5], [1 << 60, 1, 1, 1, 1]), ([60, 1, 3], [2, 1, 7])]
    for n in (2, 5, 12, 25):
        cases.append(([draw.randint(1, 14) for _ in range(n)], [draw.randint(1, 1 << draw.choice([3, 20, 60])) for _ in range(n)]))
    for blocks, weights in cases:
        assert scheduled(spark, blocks, weights) == brute(blocks, weights)


def test_every_source_stays_within_a_block_of_its_share_to_the_end(spark):
    """Random real weights and sizes, sources that run out one after the other; measured at every slot."""
    draw = random.Random(9)
    for n in (2, 3, 20, 60, 100):
        blocks = [draw.randint(1, 25) for _ in range(n)]
        real = [draw.choice([draw.random(), 10 ** draw.uniform(-4, 4), 1.0, 1 / 3]) for _ in range(n)]
        slots = defaultdict(list)
        for (k, _), t in sorted(scheduled(spark, blocks, mixing._integers(real, False)).items()):
            slots[k].append(t)
        assert sorted(t for x in slots.values() for t in x) == list(range(sum(blocks)))
        assert worst_drift(slots, dict(enumerate(real))) < 1


def of_rows(out):
    slots = defaultdict(list)
    for r in out:
        if r.mix_offset == 0:
            slots[r.source].append(r.mix_slot)
    return {s: sorted(x) for s, x in slots.items()}


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 1.0}, {"a": 0.0, "": 0.0}])
def test_mixture(spark, weights):
    rows = [(k, "a") for k in range(300)] + [(k, "b") for k in range(300, 420)] + [(k, None) for k in range(420, 433)] + [(None, "b"), (7, "a"), (7, "a"), (500, "")]
    docs = spark.createDataFrame([(d, s, "t", 1, 2) for d, s in rows], "doc_id long, source string, _s string, mix_slot int, _id int")
    out = mixing.mix(docs, weights, block=8).collect()
    assert out[0].asDict().keys() == {"doc_id", "source", "_s", "_id", "mix_slot", "mix_offset", "mix_position"}
    assert sorted(map(str, ((r.doc_id, r.source) for r in out))) == sorted(map(str, rows))
    assert sorted(r.mix_position for r in out) == list(range(len(rows)))
    out.sort(key=lambda r: r.mix_position)
    slots = defaultdict(list)
    for r in out:
        slots[r.mix_slot].append(r)
    assert sorted(slots) == list(range(len(slots)))
    assert all(len({r.source for r in s}) == 1 and [r.mix_offset for r in s] == list(range(len(s))) for s in slots.values())
    size = Counter(s for _, s in rows)
    mean = sum(n**0.5 for n in size.values()) / len(size)
    target = {s: (weights or {}).get(s, n**0.5 / mean) for s, n in size.items()}
    assert worst_drift(of_rows(out), target) < 1
    if weights and 0.0 in weights.values():
        last = [slots[k][0].source for k in range(len(slots))]
        assert set(last[-39:]) == {"a", ""} and not {"a", ""} & set(last[:-39])
    assert mixing.mix(docs.where("false")).count() == 0


def test_no_drift_over_many_periods_and_segments(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('s', id % 3) as source")
    slots = of_rows(mixing.mix(docs, {"s0": 1.0, "s1": 1.0, "s2": 1.0}, block=2).where("mix_offset = 0").collect())
    assert worst_drift(slots, dict.fromkeys(slots, 1.0)) < 1


def test_small_weights_are_not_raised(spark):
    weights = mixing._integers([9990.0] + [1.0] * 99, False)
    slots = sorted(t for (k, _), t in scheduled(spark, [3000] + [3] * 99, weights).items() if k == 0)
    share = Fraction(9990, 9990 + 99)
    assert all(abs(k - t * share) < 1 for k, t in enumerate(slots[:2900]))
    assert mixing._integers([1e-30, 1.0], False) == [1, 1 << 60]


def test_native(spark):
    """No Python worker, and no sort or exchange that gathers all blocks."""
    docs = spark.range(500).selectExpr("id as doc_id", "concat('s', id % 4) as source")
    plan = mixing.mix(docs)._jdf.queryExecution().toString() + mixing.schedule(spark, [(3, 1), (4, 2)])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "MapInPandas", "SinglePartition"))
