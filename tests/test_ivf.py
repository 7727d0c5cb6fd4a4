"""The index search holds its recall against the exact scan, on the given vectors and on vectors that do cluster."""

import numpy as np
import pytest

from marlstone.operators import ivf
from marlstone.plans import registry

SF = "/root/testdata/sf0.01"


def exact(ids, m, every, k=10):
    out = {}
    for i, name in enumerate(ids):
        if int(name[4:]) % every == 0:
            s = np.round(m @ m[i], 6)
            out[name] = [ids[j] for j in np.lexsort((np.array(ids), -s))[:k]]
    return out


def vectors(spark, path):
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    return [f"doc:{r['vec_id']}" for r in rows], np.array([r["embedding"] for r in rows], np.float64)


def recall(got, want):
    found = {(r["query_id"], r["id"]) for r in got}
    return sum((q, x) in found for q, l in want.items() for x in l) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Eighty tight groups whose signatures tell the group's members apart from all others."""
    path = str(tmp_path_factory.mktemp("clustered"))
    rng = np.random.default_rng(3)
    m = rng.normal(size=(80, 64)).repeat(10, 0) + 0.3 * rng.normal(size=(800, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_funnel_recall_on_the_given_vectors(spark):
    want = exact(*vectors(spark, SF), 20)
    got = registry.queries()["vec_funnel"](spark, SF).collect()
    assert {r["query_id"] for r in got} == set(want)
    assert recall(got, want) >= 0.9
    hundred = registry.queries()["vec_exact_topk"](spark, SF).collect()
    both = {(r["query_id"], r["id"]) for r in got}
    assert sum((r["query_id"], r["id"]) in both for r in hundred) >= 0.9 * len(hundred)


def test_a_partial_probe_is_chosen_where_it_reaches_the_gate(spark, clustered):
    points = registry.queries()["ivf_calibrate"](spark, clustered).collect()
    (chosen,) = [p for p in points if p["chosen"]]
    assert chosen["recall"] >= 0.98 and chosen["nprobe"] < max(p["nprobe"] for p in points) == ivf.nlist(800)
    assert all(p["recall"] < 0.98 for p in points if p["nprobe"] < chosen["nprobe"])
    assert recall(registry.queries()["vec_funnel"](spark, clustered).collect(), exact(*vectors(spark, clustered), 20)) >= 0.9


def test_calibration_counts_what_the_funnel_returns(spark, clustered):
    ix = ivf.index(spark, clustered)
    (q,) = ivf.blocks(ix, 20, 80)
    want = {(r["query_id"], r["id"]) for r in ivf.best(ix, q, 10).collect()}
    hits = ivf._hits(ix, q, 10, [1, 2, len(ix.centres)])
    for o, p, column in ((0, 1, 0), (1, 2, 1), (0, len(ix.centres), 2)):
        got = ivf.top(ivf.best(ix, q, 10 * ivf.OVERSAMPLES[o], p), 10, ivf.F.desc("score"), "id").collect()
        assert hits[o][column] == len(want & {(r["query_id"], r["id"]) for r in got})


def test_kmeans_has_nlist_clusters_and_each_vector_its_nearest(spark):
    ids, m = vectors(spark, SF)
    _, centres = ivf.build(ivf.view(spark, SF, "vectors"))
    assert len(centres) == ivf.nlist(len(ids)) == 22
    got = {r["id"]: r["cluster_id"] for r in registry.queries()["ivf_assign"](spark, SF).collect()}
    assert got == dict(zip(ids, (m @ centres.T).argmax(1).tolist()))


def test_near_duplicates_are_found_across_labels(spark, tmp_path):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 64))
    m[150:200] = m[:50] + 0.05 * rng.normal(size=(50, 64))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    spark.createDataFrame([(i, v, i // 100) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ivf.near_dup(spark, str(tmp_path), size=64).collect()
    s = m.astype(np.float64) @ m.astype(np.float64).T
    want = {(f"doc:{i}", f"doc:{j}") for i in range(300) for j in range(300) if s[i, j] > 0.95 and f"doc:{i}" < f"doc:{j}"}
    assert len(want) == 50 and all(abs(int(x[4:]) // 100 - int(y[4:]) // 100) == 1 for x, y in want)
    assert len(got) == 50 and {tuple(r) for r in got} == want
