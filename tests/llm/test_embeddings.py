"""Operators on embeddings against brute force, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest

from docplan.llm import code_links, subvectors, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, vec string, node int, cluster string, n string"


@pytest.fixture(scope="module")
def frame(spark):
    def of(rows, kind="float"):
        return spark.createDataFrame([(k, v, 1, "x", "y", 0, "c", "n") for k, v in rows], SCHEMA.replace("float", kind)).repartition(3)

    return of


def odd_rows(dims):
    """Rows that no operator can use as they are: null, empty, short, long, zero and not finite."""
    one = [0.5] * dims
    return [(900, None), (901, []), (902, one[:-1]), (903, one + [1.0]), (904, [0.0] * dims), (905, [None] + one[1:]),
            (906, [math.nan] + one[1:]), (907, [math.inf] + one[1:])]


def near_copies_of(rng, dims, groups, each, noise):
    base = rng.normal(size=(groups, dims))
    x = np.repeat(base, each, axis=0) + noise * rng.normal(size=(groups * each, dims))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def clusters_by_loops(rows, dims, scale, k, rounds):
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    for step in range(rounds + 1):
        told = []
        for i, x in kept:
            far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centres]
            told.append((i, far.index(min(far)), min(far), x))
        for c in range(len(centres) if step < rounds else 0):
            own = [x for _, j, _, x in told if j == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    total = sum(t[2] for t in told) if kept else 0
    return sorted((i if i is not None else -1, c, d, sum(t[2] for t in told if t[1] == c), total,
                   hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d, _ in told)


@pytest.mark.parametrize("width, chunk, spread", [(2, 7, 1), (3, 50, 1), (8, 4096, 1), (4, 64, 60000)])
def test_clusters_equal_loops(frame, width, chunk, spread):
    rng = np.random.default_rng(width)
    x = near_copies_of(rng, 8, 5, 12, 0.3) * spread
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + odd_rows(8) + [(3, x[3].tolist()), (3, x[3].tolist()), (4, x[9].tolist()), (None, x[1].tolist())]
    got = subvectors.clustered(frame(rows), dims=8, clusters=6, width=width, chunk=chunk)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == clusters_by_loops(rows, 8, 64, 6, 3)


def test_few_and_no_vectors(frame):
    few = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [0.9, -0.2])]
    got = sorted(tuple(r) for r in subvectors.clustered(frame(few), dims=2).collect())
    assert got == clusters_by_loops(few, 2, 64, 16, 3)
    assert subvectors.clustered(frame([]), dims=2).count() == 0
    assert subvectors.clustered(frame(odd_rows(4)), dims=64).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        subvectors.clustered(frame([(1, [1e30])]), dims=1).collect()


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(0)
    for top in (3, 1 << 20, 1 << 25):
        x = rng.integers(-top, top, (200, 3))
        entries, codes = subvectors.encode(x)
        assert (entries[codes] == x).all() and len(entries) == len(np.unique(x, axis=0))


def test_counts_of_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20):
        a = rng.normal(size=(n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*(values + 1e-6), *(values - 1e-6), 0.0]:
            assert whitening.above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[9, 4, 2, 1, 0.5, 0], [5, 5, 5, 1, 0, 0], [3, 3 - 1e-9, 1, 1, 1, 1], [1e8, 1, 1e-3, 0, 0, 0], [2, 0, 0, 0, 0, 0]])
def test_leading_values_are_certified(values):
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(6, 6)))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.leading(a, 4)
    assert np.allclose(got, [v for v in values[:4] if v > 0], rtol=1e-9, atol=1e-6 * max(values) * 1e-6)
    v = np.array(vectors)
    assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-12)
    assert np.allclose(a @ v.T, v.T * got, atol=1e-9 * max(values))


def test_whitening_equals_numpy(frame):
    rng = np.random.default_rng(3)
    x = (near_copies_of(rng, 6, 4, 20, 0.4) + np.float32(1000)) * np.linspace(1, 2, 6, dtype=np.float32)
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + [r for r in odd_rows(6) if r[0] != 904]
    rows += [(5, x[5].tolist()), (5, x[5].tolist()), (None, x[7].tolist())]
    got = whitening.whitened(frame(rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    whole = np.floor(256 * x.astype(np.float64)) + 0.0
    fit = np.unique(whole, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    mean = s / n
    e, v = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    e, v = e[::-1], v[:, ::-1]
    found = got.collect()
    assert len(found) == 4 * (len(x) + 3)
    own = dict(enumerate(whole)) | {None: whole[7]}
    sign = {}
    for r in found:
        j = r["component"] - 1
        want = (own[r["vec_id"]] - mean) @ v[:, j] / math.sqrt(e[j])
        sign.setdefault(j, math.copysign(1, want * r["whitened"]) if abs(want) > 1e-3 else None)
        assert abs(abs(want) - abs(r["whitened"])) < 1e-6
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(own[r["vec_id"]], s))
        assert abs(r["explained"] / (e[j] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_of_few_directions(frame):
    line = [(k, [k * 0.1, 0.0, k * 0.2]) for k in range(5)]
    got = whitening.whitened(frame(line, "double")).collect()
    assert {r["component"] for r in got} <= {1, 2, 3} and max(r["identity_error"] for r in got) < 1e-4
    assert whitening.whitened(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(frame([])).count() == 0 and whitening.whitened(frame([(1, None), (2, [])])).count() == 0


def links_by_loops(rows, threshold):
    found, group = {}, list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    unit = []
    for _, v in rows:
        fine = v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if fine else None)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                found[a] = found.get(a, 0) + 1
                group[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i if i is not None else -1), found.get(k, 0), least.get(root(k))) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("cell", [2048, 40])
def test_links_equal_brute_force(frame, cell, monkeypatch):
    monkeypatch.setattr(code_links, "TILE", 16)
    rng = np.random.default_rng(5)
    x = np.concatenate([near_copies_of(rng, 16, 1, 150, 0.15), near_copies_of(rng, 16, 20, 6, 0.3), near_copies_of(rng, 16, 150, 1, 0)])
    rows = [(int(k) + 10, v.tolist()) for k, v in enumerate(x)] + odd_rows(16)
    rows += [(k, x[0].tolist()) for k in range(500, 540)] + [(None, x[200].tolist()), (7, (x[3] * 100).tolist()), (8, [1.0]), (9, [2.0]), (3, [-1.0])]
    got = code_links.links(frame(rows), cell=cell)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = got.collect()
    told = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert told == links_by_loops(rows, 0.9)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert code_links.links(frame([])).count() == 0


@pytest.mark.parametrize("dims, depth", [(16, 1), (64, 1), (64, 2)])
def test_threshold_pairs_meet_and_pass(dims, depth):
    """Recall at the threshold itself: pairs of cosine 0.9 share a cell and are not rejected by estimates."""
    rng = np.random.default_rng(dims + depth)
    x = code_links.directions(rng.normal(size=(4000, dims)))
    e = rng.normal(size=x.shape)
    e = code_links.directions(e - (e * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + math.sqrt(1 - 0.81) * e
    tables = code_links.tables_for(dims, depth, 0.9, code_links.MISS)
    a, b = code_links.cells(x, tables, depth), code_links.cells(y, tables, depth)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist())]) >= 0.99
    packed, factor = code_links.codes(x)
    guess = np.array([code_links.estimates(packed[k : k + 1], factor[k : k + 1], y[k : k + 1])[0, 0] for k in range(len(x))])
    assert (guess >= code_links.least_estimate(factor, dims, 0.9)).mean() >= 0.9995
    assert abs(guess.mean() - 0.9) < 0.01  # unbiased


def test_estimates_reject_strangers():
    x = code_links.directions(np.random.default_rng(6).normal(size=(400, 64)))
    packed, factor = code_links.codes(x)
    passed = code_links.estimates(packed, factor, x) >= code_links.least_estimate(factor, 64, 0.9)[:, None]
    assert passed.diagonal().all() and (passed.sum() - 400) / 400**2 < 0.001
