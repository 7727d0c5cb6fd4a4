"""The cluster index over vectors: k-means, calibration against the exact answer, and the funnel that uses it.

Passes run over Arrow batches. Query vectors meet all rows in blocks whose size
follows what is kept for a query, so neither a task nor the driver holds more
than a block; centres are at most 16384 (``nlist``).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.search import centroids, nlist, top
from marlstone.sources.catalog import view
from marlstone.sources.store import collected, state, written

GATE = 0.98  # recall at 10 that a point of the calibration must reach
OVERSAMPLES, PROBES = (4, 8, 16, 32, 64), (1, 2, 4, 8, 16, 32, 64, 128, 256)
EVERY, MIN_QUERIES = 20, 30
CELLS = 1 << 22  # of a matrix that a task holds at once


class Index(NamedTuple):
    rows: DataFrame  # id, n, vec, cluster_id
    centres: np.ndarray


class Queries(NamedTuple):
    ids: list
    vecs: np.ndarray


def _matrix(col) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the lowest number on ties."""
    step = max(1, CELLS // len(centres))
    return np.concatenate([(m[i : i + step] @ centres.T).argmax(1) for i in range(0, len(m), step)])


def _starts(v: DataFrame, k: int, total: int) -> np.ndarray:
    """Vectors at the places i * total // k in the order of n; places are counted part by part, not in one task."""
    spark = v.sparkSession
    parts = written(v.select("n").repartitionByRange("n").withColumn("part", F.spark_partition_id()), "parts")
    place, want = 0, []
    places = [i * total // k for i in range(k)]
    for r in sorted(parts.groupBy("part").count().collect(), key=lambda r: r["part"]):
        want += [(r["part"], p - place + 1, i) for i, p in enumerate(places) if place <= p < place + r["count"]]
        place += r["count"]
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("n")))
    at = ranked.join(F.broadcast(spark.createDataFrame(want, "part int, r int, i int")), ["part", "r"]).select("n", "i")
    rows = v.select("n", "vec").join(F.broadcast(at), "n").select("i", "vec").collect()
    return np.array([r["vec"] for r in sorted(rows, key=lambda r: r["i"])], np.float64)


def _add(batches):
    sums: dict = {}
    for b in batches:
        for c, s, n in zip(*(x.to_pylist() for x in b.columns)):
            s, (t, m) = np.frombuffer(s, np.float64), sums.get(c, (0.0, 0))
            sums[c] = (t + s, m + n)
    for c, (s, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.asarray(s, np.float64).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["c", "s", "n"])


def build(v: DataFrame, k: int | None = None, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Centres of spherical k-means before and after the last round: ``nlist`` clusters unless ``k`` is given,
    starts at even strides, an empty cluster keeps its centre, and it ends when no vector moves."""
    sc = v.sparkSession.sparkContext
    total = v.count()
    k = min(k or nlist(total), total)
    last, centres = None, _starts(v, k, total)
    for _ in range(rounds):
        shared = sc.broadcast((last, centres))

        def sums(batches, shared=shared):
            old, new = shared.value
            s, n, moved = np.zeros(new.shape), np.zeros(len(new), np.int64), 0
            for b in batches:
                if b.num_rows:
                    m = _matrix(b.column(0))
                    at = _nearest(m, new)
                    np.add.at(s, at, m)
                    n += np.bincount(at, minlength=len(new))
                    moved += b.num_rows if old is None else int((at != _nearest(m, old)).sum())
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *some.tolist()], pa.int32()), pa.array([b"", *(s[c].tobytes() for c in some)], pa.binary()), pa.array([moved, *n[some].tolist()], pa.int64())], ["c", "s", "n"])

        kind = "c int, s binary, n long"
        rows = v.select("vec").mapInArrow(sums, kind).repartition("c").mapInArrow(_add, kind).collect()
        last, centres = centres, centres.copy()
        for r in rows:
            if r["c"] >= 0:
                mean = np.frombuffer(r["s"], np.float64)
                centres[r["c"]] = mean / (np.sqrt(mean @ mean) or 1.0)
        if not sum(r["n"] for r in rows if r["c"] < 0):
            break
    return last, centres


def assigned(v: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, n, vec and the number of the nearest centre."""
    shared = v.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for b in batches:
            if b.num_rows:
                at = _nearest(_matrix(b.column(2)), shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], ["id", "n", "vec", "cluster_id"])

    v = v.select("id", "n", "vec")
    kind = v.schema["vec"].dataType.simpleString()
    return v.mapInArrow(run, f"id string, n long, vec {kind}, cluster_id int")


def kmeans(spark, sf_dir: str) -> DataFrame:
    """The clusters of the last round."""
    v = view(spark, sf_dir, "vectors")
    return assigned(v, build(v)[0]).select("id", "cluster_id")


def assign(spark, sf_dir: str) -> DataFrame:
    """The cluster of each vector by the final centres."""
    return index(spark, sf_dir).rows.select("id", "cluster_id")


def assign_given(spark, sf_dir: str) -> DataFrame:
    """id and label: the given cluster whose centroid is nearest."""
    v = view(spark, sf_dir, "vectors")
    rows = sorted(collected(centroids(v)), key=lambda r: r["cluster_id"])
    names = F.array(*[F.lit(r["cluster_id"]) for r in rows])
    return assigned(v, np.array([r["vec"] for r in rows], np.float64)).select("id", F.get(names, F.col("cluster_id")).alias("label"))


def index(spark, sf_dir: str) -> Index:
    v = view(spark, sf_dir, "vectors")
    centres = build(v)[1]
    return Index(written(assigned(v, centres), "assigned"), centres)


def blocks(ix: Index, every: int, keep: int):
    """The query vectors (n divisible by ``every``) in blocks of which a task keeps up to CELLS / 4 rows."""
    q = ix.rows.where(F.col("n") % every == 0).select("id", "n", "vec")
    size = max(1, CELLS // 4 // max(keep, len(ix.centres)))
    parts = -(-q.count() // size)
    for part in range(parts):
        t = q.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == part).select("id", "vec").toArrow().combine_chunks()
        if t.num_rows:
            yield Queries(t.column(0).to_pylist(), np.concatenate([_matrix(c) for c in t.column(1).chunks]))


def _slices(batches, queries: int):
    """ids in order, vectors and clusters of some rows at a time."""
    step = max(1, CELLS // 4 // queries)
    for b in batches:
        for i in range(0, b.num_rows, step):
            s = b.slice(i, step)
            ids = np.array([x.encode() for x in s.column(0).to_pylist()])
            o = np.argsort(ids)
            yield ids[o], _matrix(s.column(2))[o], s.column(3).to_numpy(zero_copy_only=False)[o]


def _bits(m: np.ndarray) -> np.ndarray:
    return np.where(m >= 0, 1, -1).astype(np.float32)


def _hamming(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    return ((q.shape[1] - _bits(q) @ _bits(m).T) / 2).astype(np.int64)


def _micro(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Products in millionths: what scores rounded to six places compare by."""
    return np.rint(q @ m.T * 1e6).astype(np.int64)


def _ranks(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Place of each centre among the probes of each query, lowest number first on ties."""
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(len(centres))[None, :], 1)
    return out


def best(ix: Index, q: Queries, keep: int, probes: int | None = None, by_signature: bool = False) -> DataFrame:
    """query_id, id, key, h, cluster_id, score of the ``keep`` first rows of each query: by score (or signature) over all
    rows, or by signature over the rows of the clusters probed; id on ties."""
    out = None if probes is None else _ranks(q.vecs, ix.centres) >= probes
    shared = ix.rows.sparkSession.sparkContext.broadcast((q, out))
    never = np.iinfo(np.int64).max

    def run(batches):
        q, out = shared.value
        held = None
        for ids, m, cluster in _slices(batches, len(q.ids)):
            micro, h = _micro(q.vecs, m), _hamming(q.vecs, m)
            key = (h if by_signature else -micro) if out is None else np.where(out[:, cluster], never >> 21, h)
            at = (key << 20) + np.arange(len(ids))  # rows are in the order of ids
            n = min(keep, len(ids))
            at = np.argpartition(at, n - 1, axis=1)[:, :n]
            take = lambda x: np.take_along_axis(x, at, 1)
            new = [take(key), ids[at], take(h), cluster[at], take(micro)]
            held = new if held is None else [np.concatenate(x, 1) for x in zip(held, new)]
            if held[0].shape[1] > keep:
                o = np.lexsort((held[1], held[0]), axis=1)[:, :keep]
                held = [np.take_along_axis(x, o, 1) for x in held]
        if held is not None:
            row, col = np.nonzero(held[0] < never >> 21)
            key, ids, h, cluster, micro = (x[row, col] for x in held)
            for i in range(0, len(row), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q.ids[r] for r in row[s]], pa.string()), pa.array([x.decode() for x in ids[s]], pa.string()), pa.array(key[s]), pa.array(h[s]), pa.array(cluster[s].astype(np.int32)), pa.array(micro[s] / 1e6)],
                    ["query_id", "id", "key", "h", "cluster_id", "score"])

    found = ix.rows.mapInArrow(run, "query_id string, id string, key long, h long, cluster_id int, score double")
    return top(found, keep, "key", "id")


def _hits(ix: Index, q: Queries, k: int, ladder) -> np.ndarray:
    """How many of the exact first k rows the funnel returns at each oversample (rows) and number of probes (columns).

    A row of the exact answer is returned when its cluster is probed and fewer than k * oversample rows of probed
    clusters come before it by signature; those are counted in one pass, by the first probe that reaches them.
    """
    reach = np.searchsorted(np.array(ladder), _ranks(q.vecs, ix.centres), "right")  # first place of the ladder that probes a cluster
    at = {x: i for i, x in enumerate(q.ids)}
    exact = [[] for _ in q.ids]
    for r in best(ix, q, k).collect():
        exact[at[r["query_id"]]].append((r["h"], r["id"].encode(), r["cluster_id"]))
    width, steps = max(map(len, exact)), len(ladder)
    exact = [sorted(e) for e in exact]
    h = np.array([[x[0] for x in e] for e in exact])
    ids = np.array([[x[1] for x in e] for e in exact])
    own = np.take_along_axis(reach, np.array([[x[2] for x in e] for e in exact]), 1)
    shared = ix.rows.sparkSession.sparkContext.broadcast((q.vecs, reach, h, ids))
    shape = (len(q.ids), steps, width + 1)

    def run(batches):
        vecs, reach, h, ids = shared.value
        total = np.zeros(int(np.prod(shape)), np.int64)
        base = (np.arange(shape[0]) * steps)[:, None]
        for mine, m, cluster in _slices(batches, len(vecs)):
            key = (_hamming(vecs, m) << 20) + np.arange(len(mine))
            edge = (h << 20) + np.searchsorted(mine, ids.ravel()).reshape(ids.shape)
            passed = np.zeros(key.shape, np.int64)  # how many rows of the answer come at or before this one
            for j in range(width):
                passed += key >= edge[:, j : j + 1]
            total += np.bincount(((base + reach[:, cluster]) * (width + 1) + passed).ravel(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    counts = np.zeros(int(np.prod(shape)), np.int64)
    for r in ix.rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    before = counts.reshape(shape).cumsum(1).cumsum(2)[:, :, :width]  # by probes, rows before each row of the answer
    probed = own[:, None, :] <= np.arange(steps)[None, :, None]
    return np.array([(probed & (before < k * o)).sum((0, 2)) for o in OVERSAMPLES])


def measure(ix: Index, k: int = 10) -> tuple[list, tuple | None]:
    """Points (nprobe, oversample, recall), and the smallest partial probe that reaches the gate, if any does.

    Oversample comes first, at a full probe: the smallest that reaches the gate, else the largest.
    """
    size = len(ix.centres)
    ladder = [p for p in PROBES if p < size] + [size]
    every = max(1, min(EVERY, ix.rows.count() // MIN_QUERIES))
    hits, wanted = 0, 0
    for q in blocks(ix, every, k * (len(ladder) + 1)):
        hits = hits + _hits(ix, q, k, ladder)
        wanted += len(q.ids)
    recall = hits / (wanted * min(k, ix.rows.count()))
    o = next((i for i, r in enumerate(recall[:, -1]) if r >= GATE), len(OVERSAMPLES) - 1)
    points = [(p, OVERSAMPLES[o], float(r)) for p, r in zip(ladder, recall[o])]
    return points, next(((p, o) for p, o, r in points if r >= GATE and p < size), None)


class Built(NamedTuple):
    index: Index
    points: list  # nprobe, oversample, recall
    chosen: tuple | None


_built: dict = {}


def built(spark, sf_dir: str) -> Built:
    """The index of a folder's vectors with its calibration, built when it is first asked for and after they change."""
    key, now = (spark.sparkContext.applicationId, sf_dir), state(spark, f"{sf_dir}/embeddings.parquet")
    if key not in _built or _built[key][0] != now:
        ix = index(spark, sf_dir)
        _built[key] = now, Built(ix, *measure(ix))
    return _built[key][1]


def calibrate(spark, sf_dir: str) -> DataFrame:
    """Recall at 10 of the funnel for each number of probes, and which one is chosen; without one, search is exact."""
    points, chosen = measure(index(spark, sf_dir))
    return spark.createDataFrame([(p, o, r, (p, o) == chosen) for p, o, r in points], "nprobe int, oversample int, recall double, chosen boolean")


def funnel(spark, sf_dir: str, k: int = 10) -> DataFrame:
    """Probe the nearest clusters, keep the nearest by signature, rescore exactly: as calibrated, or the exact scan."""
    ix, _, chosen = built(spark, sf_dir)
    probes, oversample = chosen or (None, 1)
    out = None
    for q in blocks(ix, EVERY, k * oversample):
        found = written(top(best(ix, q, k * oversample, probes), k, F.desc("score"), "id").select("query_id", "id", "score"), "nearest")
        out = found if out is None else out.unionByName(found)
    return out


def all_rows(spark, sf_dir: str) -> Index:
    """The vectors as one cluster, for scans that need no index."""
    v = view(spark, sf_dir, "vectors")
    return Index(v.select("id", "n", "vec", F.lit(0).alias("cluster_id")), np.zeros((1, 1)))


def scan(spark, sf_dir: str, k: int, by_signature: bool = False) -> DataFrame:
    """query_id, id, score and distance of the first ``k`` rows for every EVERY-th vector, by score or by signature, over all rows."""
    ix, out = all_rows(spark, sf_dir), None
    for q in blocks(ix, EVERY, k):
        found = best(ix, q, k, None, by_signature).select("query_id", "id", "score", F.col("h").cast("int").alias("distance"))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id string, id string, score double, distance int") if out is None else out


def nearest(v: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score and rank0 of the ``k`` rows of ``v`` (id, n, vec) with the highest score for each query (query_id, vec), a block of queries at a time."""
    ix = Index(v.select("id", "n", "vec", F.lit(0).alias("cluster_id")), np.zeros((1, 1)))
    size, out = max(1, CELLS // 4 // k), None
    total = collected(queries.agg(F.count(F.lit(1)).alias("n")))[0]["n"]
    parts = -(-total // size)
    for part in range(parts):
        rows = collected(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).select("query_id", "vec"))
        if rows:
            found = best(ix, Queries([r["query_id"] for r in rows], np.array([r["vec"] for r in rows], np.float64)), k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return v.sparkSession.createDataFrame([], "query_id string, id string, score double, rank0 int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.select("query_id", "id", "score", (F.row_number().over(order) - 1).alias("rank0"))


def measured(spark, sf_dir: str) -> DataFrame:
    """query_id, id, cosine and distance of every EVERY-th vector with all rows, a block of queries at a time.

    A row of the table leaves its task with its values for all queries of the block, and is unfolded where it is read on.
    """
    ix, out = all_rows(spark, sf_dir), None
    for q in blocks(ix, EVERY, 1 << 10):
        shared = spark.sparkContext.broadcast(q)

        def run(batches, shared=shared):
            q = shared.value
            size = np.sqrt((q.vecs**2).sum(1))
            for ids, m, _ in _slices(batches, len(q.ids)):
                both = np.sqrt((m**2).sum(1))[:, None] * size[None, :]
                cosine = np.divide(m @ q.vecs.T, both, out=np.zeros(both.shape), where=both > 0)
                ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(q.ids))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (cosine, _hamming(m, q.vecs).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([i.decode() for i in ids], pa.string()), *lists], ["id", "cosines", "distances"])

        names = F.broadcast(spark.createDataFrame(list(enumerate(q.ids)), "q int, query_id string"))
        found = ix.rows.mapInArrow(run, "id string, cosines array<double>, distances array<int>").select("id", "distances", F.posexplode("cosines").alias("q", "cosine"))
        found = found.join(names, "q").select("query_id", "id", "cosine", F.get("distances", "q").alias("distance"))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id string, id string, cosine double, distance int") if out is None else out


def probes(spark, sf_dir: str, most: int = 4) -> DataFrame:
    """query_id and probe: the ``most`` given clusters whose centroids are nearest to every EVERY-th vector."""
    v = view(spark, sf_dir, "vectors")
    rows = sorted(collected(centroids(v)), key=lambda r: r["cluster_id"])
    shared = spark.sparkContext.broadcast((np.array([r["cluster_id"] for r in rows], np.int32), np.array([r["vec"] for r in rows], np.float64)))

    def run(batches):
        names, centres = shared.value
        for b in batches:
            if b.num_rows:
                order = np.argsort(-(_matrix(b.column(1)) @ centres.T), axis=1, kind="stable")[:, :most]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))), pa.array(names[order].ravel())], ["query_id", "probe"])

    return v.where(F.col("n") % EVERY == 0).select("id", "vec").mapInArrow(run, "query_id string, probe int")


def with_copies(v: DataFrame) -> DataFrame:
    """Vectors and, for every tenth, one that is nearly the same."""
    near = v.where("n % 10 = 0").select(F.concat("id", F.lit(":copy")).alias("id"), "n", F.transform("vec", lambda x: (x + 0.001).cast("float")).alias("vec"))
    return v.select("id", "n", "vec").unionByName(near)


def near_dup(spark, sf_dir: str, least: float = 0.95, size: int = 1 << 13, planted: bool = False) -> DataFrame:
    """Pairs of all rows with a cosine above ``least``, whatever their labels: blocks of rows meet all rows, in slices. ``planted`` adds near copies."""
    v = view(spark, sf_dir, "vectors").select("id", "n", "vec")
    v = with_copies(v) if planted else v
    parts = max(1, -(-v.count() // size))
    out = None
    for part in range(parts):
        t = v.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == part).select("id", "vec").toArrow()
        vecs = np.concatenate([_matrix(c) for c in t.column(1).chunks if len(c)]) if t.num_rows else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast((np.array(t.column(0).to_pylist(), object), vecs))

        def run(batches, shared=shared):
            others, vecs = shared.value
            step = max(1, CELLS // 4 // max(1, len(others)))
            for b in batches:
                for i in range(0, b.num_rows if len(others) else 0, step):
                    s = b.slice(i, step)
                    row, col = np.nonzero(_matrix(s.column(1)) @ vecs.T > least)
                    ids, found = np.array(s.column(0).to_pylist(), object)[row], others[col]
                    once = ids < found
                    yield pa.RecordBatch.from_arrays([pa.array(ids[once], pa.string()), pa.array(found[once], pa.string())], ["id", "other"])

        pairs = written(v.select("id", "vec").mapInArrow(run, "id string, other string"), "near-dup")
        out = pairs if out is None else out.unionByName(pairs)
    return out
