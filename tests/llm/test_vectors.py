"""Cosine links against all pairs."""

import math

import numpy as np

from vouch.llm import vectors


def brute(rows, cosine=0.95):
    ok = [(i, v, np.array(x, float)) for i, (v, x) in enumerate(rows) if v is not None and x
          and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    links, root = {i: 0 for i in range(len(rows))}, {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, _, x) in enumerate(ok):
        for j, _, y in ok[:k]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return sorted(((v, links[i], least.get(find(i)), v is not None and v == least.get(find(i)))
                   for i, (v, _) in enumerate(rows)), key=repr)


def made(seed=1, n=120, dims=20):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    near = base[:40] + rng.normal(size=(40, dims)) * np.linspace(0.05, 0.5, 40)[:, None]
    chain = [base[0]]
    for _ in range(30):
        chain.append(chain[-1] + rng.normal(size=dims) * 0.2)
    x = np.concatenate([base, near, base[:5], base[:5] * 3.0, np.array(chain)])
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(
        rng.permutation(len(x)), x)]


def test_all_pairs_and_odd_rows(spark):
    rows = made()
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, []), (902, [0.0] * 20), (903, [nan] * 20), (904, [inf] * 20),
             (905, [None] + [1.0] * 19), (906, rows[0][1]), (906, rows[0][1]), (None, rows[0][1]),
             (907, [1.0, 0.0]), (908, [2.0, 0.01]), (909, [-1.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows],
                               "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, vectors.vector_links(df).collect()), key=repr)
    assert got == brute(rows)
    assert vectors.vector_links(df.where("false")).count() == 0


def test_dense_cluster_in_tiles(monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(4)
    x = np.concatenate([1 + rng.normal(size=(70, 12)) * 0.2, rng.normal(size=(60, 12))])
    keys = np.arange(130) * 10
    copies = rng.integers(1, 4, 130)
    u = vectors.unit(x)
    cos = u @ u.T >= 0.95
    np.fill_diagonal(cos, False)
    for second in (None, rng.random(130) < 0.5):
        hit, links, _ = vectors.compare(keys, copies, x, second, vectors.axes(u), 0.95)
        seen = cos if second is None else cos & (second[:, None] != second[None, :])
        want = seen @ copies
        assert dict(zip(hit.tolist(), links.tolist())) == {
            int(k): int(w) for k, w in zip(keys, want) if w}
