import numpy as np
import pytest

from statelace.llm import embedding


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string, home string, l string")


def brute(rows):
    ok = [v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v) and lab is not None for _, v, lab in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98
    c = np.arange(n)
    for _ in range(n):
        c = np.array([min([c[i], *c[link[i]]]) for i in range(n)])
    return [(rows[i][0], int(link[i].sum()), rows[c[i]][0], int(c[i]) == i) for i in range(n)]


@pytest.mark.parametrize(("per_cell", "chunk"), [(256, 4096), (4, 4096), (4, 10)])
def test_against_brute_force(spark, per_cell, chunk):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        c = r.normal(size=6)
        for _ in range(r.integers(1, 8)):
            v = c / np.linalg.norm(c) + r.normal(size=6) * 0.08
            rows.append((len(rows), (v * r.uniform(0.5, 3)).tolist(), int(r.integers(0, 2))))
    for v in (None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1.0, 2.0], [2.0, 4.0], rows[0][1], rows[0][1]):
        rows.append((len(rows), v, 0))
    rows.append((len(rows), rows[0][1], None))
    got = embedding.near_vectors(table(spark, [(*x, "a", "b", "c") for x in rows]), per_cell=per_cell, chunk=chunk)
    assert sorted(tuple(x) for x in got.select("vec_id", "n_links", "component_id", "kept").collect()) == brute(rows)


def test_many_copies_and_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1, "", "", "") for i in range(300)]
    got = embedding.near_vectors(table(spark, rows)).collect()
    assert {(x["n_links"], x["component_id"]) for x in got} == {(299, 0)} and sum(x["kept"] for x in got) == 1
    assert embedding.near_vectors(table(spark, [])).count() == 0


def test_the_border_and_planted_links(spark):
    """Pairs at exactly the threshold link, whatever block they meet in; planted links among 3,000 vectors are all found."""
    rows = [(0, [3.0, 4.0], 0), (1, [4.0, 3.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 5.0], 0)]  # cosine of the first two: 24 / 25
    for cosine, links in ((0.96, 1), (0.96 + 1e-15, 0)):
        got = {x["vec_id"]: x for x in embedding.near_vectors(table(spark, [(*x, "", "", "") for x in rows]), cosine=cosine).collect()}
        assert got[0]["n_links"] == got[1]["n_links"] == links and got[1]["component_id"] == (0 if links else 1)
    r = np.random.default_rng(5)
    base = r.normal(size=(3000, 16))
    base[1000:1600] = base[:600] + r.normal(size=(600, 16)) * r.uniform(0.01, 0.3, size=(600, 1))
    rows = [(i, v.tolist(), i % 2, "", "", "") for i, v in enumerate(base)]
    x = base.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.98) & (np.arange(3000)[:, None] % 2 == np.arange(3000) % 2)
    np.fill_diagonal(link, False)
    assert link.sum() > 500
    got = {y["vec_id"]: y["n_links"] for y in embedding.near_vectors(table(spark, rows), per_cell=20).collect()}
    assert got == dict(enumerate(link.sum(axis=1).tolist()))
