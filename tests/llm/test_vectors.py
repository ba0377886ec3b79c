"""The operators on embeddings against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from ribospark.llm import vector_codes, whitening
from ribospark.llm.queries import op11_whitening, op13_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, id string, code string"


def _rows(n=400, d=8, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = [float(np.float32(t)) for t in rng.normal(0, 0.2, d)]
        if i % 10 == 3:
            v = [0.25] * d  # a common vector
        if i == 17:
            v = None
        elif i == 18:
            v[2] = None
        elif i == 19:
            v[1] = float("nan")
        elif i == 20:
            v[0] = float("-inf")
        out.append((i if i != 30 else None, v, [None, 1, 2][i % 3], "clash", 1, "clash", "clash"))
    return out + [out[5], out[5]]


def _sound(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def _plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(r[0], [math.floor(1024 * c) for c in r[1]], r[2]) for r in _sound(rows)]
    width = len(kept[0][1]) // parts
    cut = lambda x: [tuple(x[p * width : (p + 1) * width]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x)[p] for _, x, _ in first] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, x, _ in kept:
                own.setdefault(near(cut(x)[p], books[p])[1], []).append(cut(x)[p])
            for i, vs in own.items():
                books[p][i] = tuple(sum(c) // len(vs) for c in zip(*vs))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(v, books[p]) for p, v in enumerate(cut(x))] for _, x, _ in kept]
    sums = {}
    for (_, _, label), f in zip(kept, found):
        sums[label] = sums.get(label, 0) + sum(e for e, _ in f)
    return sorted(((i if i is not None else -1), "".join(f"{k:02x}" for _, k in f), sum(e for e, _ in f), sums[label], sha) for (i, _, label), f in zip(kept, found))


def _got(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_vector_codes(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _got(vector_codes.encode_vectors(df)) == _plain_codes(rows)
    few = rows[:9]
    assert _got(vector_codes.encode_vectors(spark.createDataFrame(few, SCHEMA))) == _plain_codes(few)  # fewer rows than entries
    assert vector_codes.encode_vectors(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.encode_vectors(df, parts=3)


def test_large_components(spark):
    rows = [(i, [(-1.0) ** i * 2.0 ** (20 + i % 21), 3.5, 0.0, i / 7], i % 2, "", 1, "", "") for i in range(60)]
    rows.append((60, [2.0**42, 1.0, 1.0, 1.0], 0, "", 1, "", ""))  # too large
    got = _got(vector_codes.encode_vectors(spark.createDataFrame(rows, SCHEMA), entries=16))
    want = _plain_codes([(r[0], [float(np.float32(c)) for c in r[1]], *r[2:]) for r in rows[:-1]], entries=16)
    assert got == [(i, c, e if e < 2**63 else None, s if s < 2**63 else None, h) for i, c, e, s, h in want]


@pytest.mark.parametrize("d", [1, 3, 16])
def test_vantage_tree_equals_all_distances(d):
    rng = np.random.default_rng(d)
    for spread in (3, 200, 10**7):
        entries = rng.integers(-spread, spread, (256, d))
        entries[40:60] = entries[3]  # equal entries
        points = np.concatenate([rng.integers(-spread, spread, (500, d)), entries[::3]])
        index, best = vector_codes.VantageTree(entries).nearest(points)
        squares = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()


def test_vector_codes_query(spark):
    import duckdb

    rows = duckdb.sql("SELECT vec_id, embedding, label FROM '/root/testdata/sf0.001/embeddings.parquet'").fetchall()
    small = [r for r in rows if r[0] < 60]
    df = spark.createDataFrame(small, "vec_id long, embedding array<float>, label int")
    assert _got(vector_codes.encode_vectors(df)) == _plain_codes(small)
    got = op13_vector_codes(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(_sound(rows)) and len({r["codebooks_sha256"] for r in got}) == 1


def _plain_whitening(rows, components=16):
    kept = [(r[0], tuple(math.floor(64 * c) + 1_000_000 for c in r[1])) for r in _sound(rows)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    exact = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], object)
    cov = (exact.T @ exact).astype(np.float64) / float(n) ** 3
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in kept:
        d = [n * c - s for c, s in zip(x, sums)]
        out[i if i is not None else -1] = (n, sum(v * v for v in d), np.array(d, float) / n @ vectors / np.sqrt(values))
    return out, values / np.trace(cov)


def test_whitening(spark):
    rows = _rows(n=600, d=21)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want, explained = _plain_whitening(rows)
    for tile, block in ((32, 2048), (5, 64)):
        got = whitening.whiten_vectors(df, tile=tile, row_block=block).collect()
        assert len(got) == 16 * len(_sound(rows))
        signs = {}
        for r in sorted(got, key=lambda r: r["component"]):
            n, deviation, white = want[r["vec_id"] if r["vec_id"] is not None else -1]
            k = r["component"] - 1
            assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9
            assert abs(r["explained"] / explained[k] - 1) < 1e-9
            if k not in signs and abs(white[k]) > 0.1:
                signs[k] = 1 if r["whitened"] * white[k] > 0 else -1
            if k in signs:
                assert abs(signs[k] * r["whitened"] - white[k]) < 1e-6
        assert len(signs) == 16


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.501, 0.251]), (3, [0.1])], "vec_id long, embedding array<double>")
    got = whitening.whiten_vectors(one).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 and r["n"] == 1 for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 2.0**40 * (i % 2)]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten_vectors(line).collect()
    assert [r["component"] for r in got if r["vec_id"] == 1] == [1, 2, 3] and got[0]["n"] == 9 and all(r["deviation"] is None for r in got)
    assert whitening.whiten_vectors(one.limit(0)).collect() == []


def test_whitening_query(spark):
    got = op11_whitening(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    assert got.count() == 16 * len(_sound([tuple(r) for r in rows])) and got.agg({"identity_error": "max"}).collect()[0][0] < 1e-4
