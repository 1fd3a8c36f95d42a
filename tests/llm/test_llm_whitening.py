"""Whitening against numpy's solver and exact whole numbers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import whitening
from quarry.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n long, d int, x string, component int"


def _plain(vectors, components=4):
    """Per row of usable vectors of one length: deviation and, per component, |whitened| and explained."""
    xs = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[c - s / n for c, s in zip(x, sums)] for x in fit])
    v = y.T @ y / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    rows = []
    for x in xs:
        centred = np.array([c - s / n for c, s in zip(x, sums)])
        rows.append((sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.abs(centred @ axes) / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(v)))
    return n, rows


def _of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    vectors[200:] = vectors[7]  # a third of the rows are copies
    rows = [(i, [float(c) for c in v], 1, 2, "z", 9) for i, v in enumerate(vectors)]
    rows += [(900, None, 0, 0, "", 0), (901, [1.0] * 11 + [None], 0, 0, "", 0), (902, [float("nan")] * 12, 0, 0, "", 0),
             (903, [float("inf")] + [0.0] * 11, 0, 0, "", 0), (904, [], 0, 0, "", 0)]
    got = _of(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    n, want = _plain(vectors)
    assert set(got) == set(range(300))
    for i, (deviation, white, explained) in enumerate(want):
        assert sorted(got[i]) == [1, 2, 3, 4]
        for k in range(4):
            r = got[i][k + 1]
            assert r["n"] == n == 200 and r["deviation"] == deviation
            assert abs(abs(r["whitened"]) - white[k]) < 1e-8 and abs(r["explained"] - explained[k]) < 1e-12
            assert r["identity_error"] < 1e-9


def test_driver_table(spark):
    sf = "/root/testdata/sf0.001"
    got = _of(QUERIES["op13_embedding_whitening"](spark, sf))
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, want = _plain([r["embedding"] for r in rows])
    assert len(got) == len(rows)
    for r, (deviation, white, _) in zip(rows, want):
        assert [got[r["vec_id"]][1]["n"], got[r["vec_id"]][1]["deviation"]] == [n, deviation]
        assert np.allclose([abs(got[r["vec_id"]][k]["whitened"]) for k in (1, 2, 3, 4)], white, atol=1e-7)


def test_special_rows(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))

    assert run([]).count() == 0
    assert run([(1, [1.0, 2.0]), (1, [1.0, 2.0])]).count() == 0  # one distinct vector: no variance
    # two spaces; null and repeated ids stay rows; a constant dimension gives no component
    got = run([(1, [0.0, 5.0]), (1, [1.0, 5.0]), (None, [1.0, 5.0]), (4, [3.0]), (5, [4.0])]).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"], round(abs(r["whitened"]), 9)) for r in got) == [
        ("1", 1, 2, 1.0), ("1", 1, 2, 1.0), ("4", 1, 2, 1.0), ("5", 1, 2, 1.0), ("None", 1, 2, 1.0)]
    # entries beyond 64 bits, and deviations beyond 64 bits
    got = run([(1, [1e300]), (2, [-1e300]), (3, [0.0])]).collect()
    assert len(got) == 3 and all(r["deviation"] is None or r["deviation"] < 1 << 63 for r in got)
    assert -0.0 == 0 and [r["deviation"] for r in run([(1, [-0.0, 1.0]), (2, [0.0, 2.0])]).collect()] == [256 ** 2, 256 ** 2]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(0, 5), st.integers(0, 10 ** 6))
def test_components_of_symmetric_matrices(d, kind, seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((d, d))
    q = np.linalg.qr(a)[0]
    v = [a @ a.T, np.eye(d), np.diag(np.arange(d) % 3 + 1.0), q @ np.diag([5.0] * min(3, d) + [1.0] * max(0, d - 3)) @ q.T,
         a[:, :2] @ a[:, :2].T, q @ np.diag(10.0 ** -np.arange(d)) @ q.T][kind]
    v = (v + v.T) / 2
    k = min(4, d)
    values, axes = whitening.leading_components(v, k)
    scale = np.abs(v).max()
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:k]).max() < 1e-12 * scale
    assert np.abs(v @ axes - axes * values).max() < 1e-12 * scale
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12


@pytest.mark.parametrize("scale", [1, 2 ** 20, 2 ** 31, 2 ** 45])
def test_exact_deviation(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale, (50, 3))
    space = whitening.Space(50, [int(s) for s in x.sum(axis=0)])
    for row, got in zip(x.tolist(), whitening._deviations(space, x)):
        want = sum((50 * a - s) ** 2 for a, s in zip(row, space.sums))
        assert got == (want if want < 1 << 63 else None)


def test_sturm_counts():
    rng = np.random.default_rng(2)
    d, b = rng.standard_normal(30), rng.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(b, 1) + np.diag(b, -1))
    shifts = np.linspace(-4, 4, 41)
    assert whitening.sturm_count(d, b, shifts).tolist() == [(values < s).sum() for s in shifts]
