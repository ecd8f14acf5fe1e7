"""Conversation repair and whitening against plain Python and NumPy."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from kitescope.llm import conversation_repair as cr
from kitescope.llm import whitening as wh

BLANKS = " \t\n\x0b\f\r"
COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def brute(initials, faults, most_inserts=3):
    """The cheapest edits, then the first in ASCII order, among all sequences with few inserts."""
    n, best = len(initials), None
    for inserts in range(most_inserts + 1):
        for where in itertools.combinations_with_replacement(range(n + 1), inserts):
            for edits in itertools.product("KRD", repeat=n):
                if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits)):
                    continue
                text, slots = "", []
                for i in range(n + 1):
                    text += "I" * where.count(i)
                    slots += ["ua"] * where.count(i)
                    if i < n:
                        text += edits[i]
                        slots += {"K": [initials[i]], "R": ["ua"], "D": []}[edits[i]]
                cost = sum(COST[e] for e in text) + 3 * sum(f == "truncated" and e != "D" for f, e in zip(faults, edits))
                if best is not None and (cost, text) >= best:
                    continue
                if any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*slots)):
                    best = (cost, text)
    return best


def test_lightest_derivation_is_the_best_of_all_edit_sequences():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(0, 4)
        initials = [rng.choice("uuaas x")[:1] for _ in range(n)]
        faults = [rng.choice(["sound", "sound", "truncated", "blank", "duplicate"]) for _ in range(n)]
        assert cr.lightest(initials, faults, (0, 3), (0,))[0] == brute(initials, faults), (initials, faults)


def test_chained_blocks_give_the_same_edits_as_one_block():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(2, 12)
        roles = [rng.choice(["user", "assistant", "system", "tool", ""]) for _ in range(n)]
        faults = [rng.choice(["sound", "sound", "sound", "truncated", "blank", "duplicate"]) for _ in range(n)]
        cuts = sorted({0, n, *[rng.randint(1, n - 1) for _ in range(3)]})
        blocks = []
        for seq, (a, b) in enumerate(zip(cuts, cuts[1:])):
            block = cr._Block(1)
            for i in range(a, b):
                block.add(i, roles[i], f"t{i}", faults[i])
            blocks.append({"task": 0, "seq": seq, **block.summary(), "links": block.links()})
        answer, *pieces = cr._chained(1, iter(blocks))
        cost, edits = cr.lightest([r[:1] for r in roles], faults, (0, 3), (0,))[0]
        assert (answer["cost"], answer["audit"]) == (cost, edits)
        lines = []
        for piece, (a, b) in zip(pieces, zip(cuts, cuts[1:])):
            lines += cr.repaired_lines(piece["audit"], roles[a:b], [f"t{i}" for i in range(a, b)], piece["state"])
        assert lines == cr.repaired_lines(edits, roles, [f"t{i}" for i in range(n)])


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def plain_repair(original, rows):
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.strip(BLANKS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "sound")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        # Dynamic programming from the right over (row, state).
        best = {(len(mine), q): ((0, "") if q in (0, 3) else None) for q in range(4)}
        for i in range(len(mine), -1, -1):
            if i < len(mine):
                for q in range(4):
                    options = [(best[i + 1, q][0] + 4, "D" + best[i + 1, q][1])] if best[i + 1, q] else []
                    if faults[i] in ("sound", "truncated"):
                        for letter in "sua":
                            after = best.get((i + 1, cr._NEXT.get((q, letter))))
                            if after is None:
                                continue
                            extra = 3 * (faults[i] == "truncated")
                            if letter == initials[i]:
                                options.append((after[0] + extra, "K" + after[1]))
                            if letter != "s":
                                options.append((after[0] + 3 + extra, "R" + after[1]))
                    best[i, q] = min(options, default=None)
            for _ in range(4):
                for (q, letter), after in cr._NEXT.items():
                    if letter != "s" and best[i, after] is not None:
                        offer = (best[i, after][0] + 3, "I" + best[i, after][1])
                        best[i, q] = min(offer, best[i, q] or offer)
        cost, audit = best[0, 0]
        text = "\n".join(cr.repaired_lines(audit, [r[2] for r in mine], [r[3] for r in mine]))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def repaired(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, links string").withColumnRenamed("links", "Links")
    got = cr.repair_all(table, cr.damaged(table)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def sample(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "system", None, "tool", ""])
            text = rng.choice([None, "", " \n", "Yes.", "No", "Why?", "x" * rng.randint(1, 30) + rng.choice(". "), "Tail.\t\n"])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text, "a"))
    return rows


def test_repair_of_odd_conversations_matches_plain_python(spark):
    rows = sample(1, 80, 9)
    plain = [r[:4] for r in rows]
    assert repaired(spark, rows) == plain_repair(plain, plain_damage(plain))


def test_conversations_over_many_blocks_and_tasks(spark, monkeypatch):
    rows = sample(2, 6, 200)
    plain = [r[:4] for r in rows]
    want = plain_repair(plain, plain_damage(plain))
    monkeypatch.setattr(cr, "BLOCK", 7)
    assert repaired(spark, rows) == want


def test_repair_of_no_rows(spark):
    assert repaired(spark, []) == {}


# ---- whitening --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("rows,dims", [(300, 12), (20, 30), (200, 1), (90, 2)])
def test_solver_matches_eigh(rows, dims):
    rng = np.random.default_rng(rows)
    x = rng.standard_normal((rows, dims)) * np.logspace(0, -3, dims)
    x -= x.mean(axis=0)
    r = None
    for a in range(0, rows, 16):
        r = wh.reduced(r, x[a:a + 16])
    values, vectors = wh.principal_directions(r, 8)
    want, directions = np.linalg.eigh(x.T @ x)
    k = min(8, dims, rows - 1)
    assert len(values) == k
    np.testing.assert_allclose(values, want[::-1][:k], rtol=1e-10)
    np.testing.assert_allclose(np.abs(np.sum(vectors * directions[:, ::-1][:, :k], axis=0)), 1, atol=1e-9)


@pytest.mark.parametrize("x", [np.vstack([np.eye(9)] * 3), np.hstack([np.eye(6), np.eye(6), np.ones((6, 2))]), np.ones((4, 5)), np.zeros((1, 3))])
def test_solver_on_ties_and_missing_directions(x):
    x = x - x.mean(axis=0)
    values, vectors = wh.principal_directions(wh.reduced(None, x), 32)
    assert len(values) == np.linalg.matrix_rank(x)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)
    np.testing.assert_allclose(x.T @ (x @ vectors), vectors * values, atol=1e-9)


def test_dqds_is_accurate_for_tiny_values():
    a, b = np.array([1.0, 1e-4, 1e-8, 1e-12]), np.array([0.5, 0.5e-4, 0.5e-8])
    product = np.prod(a)  # the determinant has no rounding error to speak of
    assert abs(np.prod(np.sqrt(wh.dqds(a * a, b * b))) / product - 1) < 1e-12


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    clean = [(i, (rng.standard_normal(5) * [3, 2, 1, .5, .2]).tolist()) for i in range(400)]
    other = [(1000 + i, rng.standard_normal(2).tolist()) for i in range(40)]
    odd = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [float("inf")] * 5), (2004, []), (2005, [1.0, 2.0, 3.0])]
    rows = clean + clean[:3] + other + odd + [(None, clean[0][1])]
    table = spark.createDataFrame([(i, v, "e") for i, v in rows], "vec_id long, embedding array<double>, vector string")
    groups = wh.fit(table)
    got = wh.whiten(table, groups).toPandas()
    assert set(got["vec_id"].dropna().astype(int)) == {i for i, _ in clean + other}
    for part in (clean + clean[:3] + [(None, clean[0][1])], other):
        x = np.floor(64 * np.array([v for _, v in part])).astype(int) + wh.OFFSET
        n, s, d = len(x), x.sum(axis=0), x.shape[1]
        mean = s / n
        values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        want = (x - mean) @ vectors / np.sqrt(values)
        for component in range(1, d + 1):
            mine = got[(got["component"] == component) & (got["n"] == n)].groupby("vec_id").first()
            full = {i: w for (i, _), w in zip(part, want[:, component - 1]) if i is not None}
            pairs = np.array([(mine["whitened"][i], full[i]) for i in full])
            sign = np.sign(pairs[0, 0] * pairs[0, 1])
            np.testing.assert_allclose(pairs[:, 0], sign * pairs[:, 1], atol=1e-6)
            np.testing.assert_allclose(mine["explained"], values[component - 1] / values.sum(), rtol=1e-9)
            assert (mine["identity_error"] < 1e-6).all()
        exact = {i: int(((n * row - s) ** 2).sum()) for (i, _), row in zip(part, x)}
        deviations = got[got["n"] == n].dropna(subset=["vec_id"]).groupby("vec_id")["deviation"].first()
        assert {int(i): int(v) for i, v in deviations.items()} == {i: v for i, v in exact.items() if i is not None}
    one = wh.fit(table, components=2)
    assert wh.whiten(table, one).groupBy("component").count().count() == 2


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, None)]):
        table = spark.createDataFrame(rows, schema)
        assert wh.whiten(table, wh.fit(table)).count() == 0
    # Numbers beyond the range of a long deviation.
    table = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], schema)
    assert wh.whiten(table, wh.fit(table)).filter("deviation IS NULL").count() > 0


def test_models_go_to_the_tasks_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(d).tolist()) for i, d in enumerate([2, 3, 4] * 20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = wh.whiten(table, wh.fit(table)).toPandas()
    monkeypatch.setattr(wh, "MODEL_BYTES", 1)
    groups = wh.fit(table)
    assert len(groups) == 3
    parts = wh.whiten(table, groups).toPandas()
    key = ["vec_id", "component"]
    np.testing.assert_allclose(np.abs(whole.sort_values(key)["whitened"]), np.abs(parts.sort_values(key)["whitened"]), atol=1e-9)
