"""The partition join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kitescope.llm import jaccard_join as jj

BLANKS = " \t\n\x0b\f\r"


def plain_sets(texts, width=5):
    out = []
    for text in texts:
        words = [w for w in (text or "").translate({ord(b): " " for b in BLANKS} | {c: chr(c + 32) for c in range(65, 91)}).split(" ") if w]
        k = min(width, len(words))
        out.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set())
    return out


def plain_classes(rows, percent=80):
    sets = plain_sets([t for _, t in rows])
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))))


def classes(spark, rows, **more):
    table = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, key string")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.join_classes(table, **more).collect())


def corpus(seed, size):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    license_line = " ".join(f"Lic{i}" for i in range(30))
    rows = []
    for d in range(size):
        text = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 7, 9, 12, 20, 45, 90, 200]))]
        if rng.random() < .3:
            text += license_line.split()
        rows.append((d, " ".join(text)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                if copy:
                    at = rng.randrange(len(copy))
                    copy[at:at + 1] = rng.choice([[], ["new"], [copy[at], "more"]])
            rows.append((1000 + len(rows), (" ".join(copy)).upper()))
    return rows


@pytest.mark.parametrize("percent", [80, 60, 95])
def test_every_link_shares_a_key(percent):
    """The pigeonhole, pair by pair: sets at and above the threshold always meet, whatever the frequencies say."""
    rng = np.random.default_rng(percent)
    for trial in range(300):
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 2 ** 62, n).astype(np.uint64))
        y = x
        while True:
            changed = y[rng.random(len(y)) > .03]
            changed = np.unique(np.concatenate([changed, rng.integers(0, 2 ** 62, int(rng.integers(0, 2))).astype(np.uint64)]))
            both = len(np.intersect1d(x, changed))
            if not len(changed) or 100 * both < percent * (len(x) + len(changed) - both) or rng.random() < .05:
                break
            y = changed
        small, large = sorted([x, y], key=len)
        dear = np.where(rng.random(len(large)) < rng.random(), 10 ** 6, 1)
        keys, asked = jj.probe_keys(large, np.array([len(large)]), dear, percent)
        asked = asked.values.to_numpy()
        starts = jj.band_starts(100, percent)
        band = np.searchsorted(starts, len(small), "right") - 1
        mine = asked[asked >> 40 == band]
        held = jj.index_keys(small, np.array([len(small)]), mine, np.array([len(mine)]), percent)
        assert set(keys.values.to_pylist()) & set(held.values.to_pylist()), (len(small), len(large))
        if len(small) < len(large) or set(small) != set(large):
            met, *_ = jj.first_look(np.concatenate([small, large]), np.array([len(small), len(large)]), percent)
            assert list(met) == [0, 1], (len(small), len(large))
            parts = [jj.first_look(s, np.array([len(s)]), percent) for s in (small, large)]
            held, asked = [{k for k, r in zip(part[1].tolist(), part[3].tolist()) if r & bit} for part, bit in zip(parts, (1, 2))]
            assert held & asked


def test_allowances_add_up_and_avoid_frequent_segments():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2 ** 62, 200).astype(np.uint64))
    sizes = np.array([len(values)])
    starts = jj.band_starts(300)
    band = np.searchsorted(starts, sizes, "right") - 1
    cut = jj._Cut(values, sizes, np.array([0]), band, jj.segments_of(band, starts))
    need = jj.most_apart(2 * sizes) + 1
    frequency = np.where(cut.segment[cut.gid] < 34, 10 ** 5, 1)
    v = jj.allowances(cut, *jj.costs_by_frequency(cut, frequency), need)
    assert (v + 1).sum() == need[0] and v.min() == -1 and v.max() == 1
    assert (v[:34] == -1).all()


@pytest.mark.parametrize("seed,small", [(1, 16), (2, 1), (3, 0)])
def test_classes_match_all_pairs(spark, monkeypatch, seed, small):
    monkeypatch.setattr(jj, "SMALL", small)
    monkeypatch.setattr(jj, "RARE", 2)
    rows = corpus(seed, 70)
    assert classes(spark, rows, block_bytes=2000 if small == 0 else jj.BLOCK_BYTES) == plain_classes(rows)


def test_large_groups_of_near_copies_and_a_common_passage(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((d, " ".join(copy)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(500 + d, passage + " " + " ".join(f"q{d}-{i}" for i in range(rng.randint(0, 30)))) for d in range(80)]
    assert classes(spark, rows) == plain_classes(rows)
    assert classes(spark, rows, width=3, percent=60) == classes(spark, list(reversed(rows)), width=3, percent=60)


def test_join_of_odd_rows(spark):
    long = " ".join(f"v{i % 4001}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e f g"), (4, "A B C D E F G"), (None, "alone here"), (5, "one"), (6, "ONE"), (7, "one\x0btwo"),
            (8, long), (9, long + " tail"), (9, "one two"), (2, "a b c d e f g"), (10, "Été été"), (11, "été été")]
    assert classes(spark, rows) == plain_classes(rows)
    assert classes(spark, []) == []
