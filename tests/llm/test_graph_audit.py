import numpy as np

from contestra.llm import graph_dedup


def brute(x, threshold=0.93):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    return near


def agrees(out, near):
    top = list(range(len(near)))
    for _ in top:
        new = [min([top[i], *(top[j] for j in np.nonzero(near[i])[0])]) for i in range(len(top))]
        if new == top:
            break
        top = new
    return {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == {i: (int(near[i].sum()), top[i]) for i in range(len(near))}


def test_tight_groups_link_across(spark):
    r = np.random.default_rng(2)
    a, b, c = np.eye(16)[:3]
    centres = [a, 0.95 * a + np.sqrt(1 - 0.95**2) * b, c]
    x = np.vstack([m + 0.002 * r.standard_normal((n, 16)) for m, n in zip(centres, (80, 80, 300))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    near = brute(x)
    assert near[:80, 80:160].all()
    assert agrees(graph_dedup.near_vectors(table), near)


def test_audit_mends_links_across_shards(spark):
    x = np.random.default_rng(3).standard_normal((400, 5)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    near = brute(x)
    plain = graph_dedup.near_vectors(table, per_shard=5)
    assert sum(r.n_links for r in plain.collect()) < near.sum() and graph_dedup.short_labels(table, plain) == {1}
    assert agrees(graph_dedup.audited_vectors(table, per_shard=5), near)
