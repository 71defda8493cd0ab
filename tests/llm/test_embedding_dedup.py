import math

import numpy as np
import pytest

from noonward.llm import embedding_dedup as ed

ROWS = "vec_id long, embedding array<double>, label string"


def brute(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    usable = []
    for vec_id, vector, label in rows:
        good = vec_id is not None and label is not None and bool(vector) and all(x is not None and math.isfinite(x) for x in vector)
        usable.append(good and any(vector))
    n, near = [0] * len(rows), {r[0]: {r[0]} for r in rows}
    for i, (a, x, p) in enumerate(rows):
        for j, (b, y, q) in enumerate(rows[:i]):
            if usable[i] and usable[j] and p == q and len(x) == len(y):
                u, v = np.array(x) / max(map(abs, x)), np.array(y) / max(map(abs, y))
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for k, (vec_id, _, _) in enumerate(rows):
        seen, todo = set(), [vec_id]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += near[at]
        least = None if vec_id is None else min(seen)
        out.append((vec_id, n[k], least, least == vec_id))
    return sorted(out, key=str)


def found(spark, rows, s=ed.Settings(), schema=ROWS):
    return sorted(map(tuple, ed.near_vectors(spark.createDataFrame(rows, schema), s).collect()), key=str)


def families(seed, labels, dim=24, groups=10, members=12):
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = rng.standard_normal(dim)
        for _ in range(members):
            vector = base + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.2, 0.35])
            rows.append((len(rows) * 3, (vector * rng.uniform(0.1, 9)).tolist(), labels[g % len(labels)]))
    rng.shuffle(order := np.arange(len(rows)))
    return [rows[i] for i in order]


def test_against_all_pairs(spark):
    rows = families(1, ["a", "b"])
    assert found(spark, rows) == brute(rows)


def test_large_filters_are_compared_in_pairs_of_blocks(spark):
    rows = families(2, ["a"], groups=2, members=60) + [(1000 + i, [1.0] * 24, "a") for i in range(40)]
    assert found(spark, rows, ed.Settings(block=8, task_bytes=20_000)) == brute(rows)


def test_share_of_pairs_found_at_the_limit():
    """At exactly 0.93, where the fewest filters are shared."""
    rng = np.random.default_rng(5)
    for dim, vectors in [(64, 5_000), (64, 100_000), (200, 20_000)]:
        a = ed.unit_rows(rng.standard_normal((400, dim)))
        b = rng.standard_normal((400, dim))
        b = ed.unit_rows(b - (a * b).sum(axis=1, keepdims=True) * a)
        b = 0.93 * a + math.sqrt(1 - 0.93**2) * b
        codes = ed.codes_for(dim, vectors, ed.Settings())
        one, two = (set(zip(*(x.tolist() for x in codes.decode(v)))) for v in (a, b))
        assert len({row for row, _ in one & two}) >= 0.98 * 400
        differing = np.bitwise_count((codes.signs(a) ^ codes.signs(b)).view(np.uint64)).sum(axis=1)
        assert differing.max() <= ed.Settings().most_differing


def test_decoding_finds_exactly_the_filters_that_are_exceeded():
    codes = ed.codes_for(20, 50, ed.Settings(codes=2))
    unit = ed.unit_rows(np.random.default_rng(3).standard_normal((30, 20)))
    own = set(zip(*(x.tolist() for x in codes.decode(unit))))
    padded = unit.astype(np.float32)
    for c in range(2):
        turned = padded @ codes.turns[c]
        for i in range(codes.size):
            for j in range(codes.size):
                score = turned[:, :10] @ codes.halves[c, 0, i] + turned[:, 10:] @ codes.halves[c, 1, j]
                for row in np.flatnonzero(np.abs(score - codes.threshold) > 1e-5):
                    assert ((row, (c * codes.size + i) * codes.size + j) in own) == (score[row] >= codes.threshold)


def test_odd_rows(spark):
    one, nan, inf = [1.0, 0.0, 0.0], float("nan"), float("inf")
    rows = [
        (1, one, "a"), (2, one, None), (None, one, "a"), (3, None, "a"), (4, [], "a"), (5, [0.0, 0.0], "a"), (6, [1.0, None, 0.0], "a"),
        (7, [nan, 1.0, 0.0], "a"), (8, [inf, 0.0, 0.0], "a"), (9, [1e300, 1e299, 0.0], "a"), (10, [1e-300, 0.0, 0.0], "a"), (11, [-1.0, 0.0, 0.0], "a"),
        (12, [1.0, 0.0], "a"), (13, [2.0, 0.0], "a"), (14, [3.0], "a"), (15, [4.0], "a"), (16, one, "b"), (17, [1.0] * 5000, "a"), (18, [1.0] * 5000, "a"),
    ]
    want = [(v, n, c, True if v is None else k) for v, n, c, k in brute(rows)]
    assert found(spark, rows) == sorted(want, key=str)


def test_repeated_rows_and_one_id_with_several_vectors(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, x, "a"), (3, x, "a"), (5, x, "a"), (5, y, "a"), (9, y, "b"), (8, y, "a"), (7, z, "a")]
    assert found(spark, rows) == sorted(
        [(3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (5, 1, 3, False), (8, 1, 3, False), (9, 0, 9, True), (7, 0, 7, True)], key=str
    )


@pytest.mark.parametrize("kind", ["float", "double"])
def test_empty_table_other_types_and_clashing_names(spark, kind):
    schema = f"vec_id int, embedding array<{kind}>, label int, node string, bucket string, held int, HI string"
    assert ed.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, [1.0, float(i)], 1, "x", "y", 0, "z") for i in (0, 0, 9)]
    assert found(spark, rows, schema=schema) == [(0, 1, 0, True), (0, 1, 0, True), (9, 0, 9, True)]
