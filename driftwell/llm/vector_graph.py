"""Near-duplicate vectors of equal label by robust-pruned flat graphs and range-expanding greedy search.

* Equal vectors of a label are one node with a count.
* Centroids, at most ``MOST_CENTROIDS`` in all, are fitted on a bounded sample of the large labels. Every node goes to
  the shards of its two nearest centroids, so shards overlap; a cluster above ``SHARD`` nodes is cut into shards by
  hash, each of which all nodes of the cluster search.
* In each shard a node's neighbours are chosen by robust pruning: the nearest candidate stays, and those it covers by
  the factor ``ALPHA`` go. A node's lists from overlapping shards are united.
* Every node searches its shards' graphs from their medoids: the beam greedily nears the query, then every node found
  within the widened range is expanded until no new one turns up.
* Pairs found are verified in double precision and counted in the first cluster that both have. Within a shard they
  are merged into classes at once, so that links to pass on number no more than nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected, groups

SHARD, MOST_CENTROIDS, SAMPLE = 1024, 4096, 20_000
ALPHA, DEGREE, BEAM, WIDER = 1.2, 32, 32, 1.5


def centroids(x: np.ndarray, k: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def robust_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """(n, degree) neighbour places, -1 where a list is shorter; x: unit rows."""
    n = len(x)
    far = np.maximum(0, 2 - 2 * (x @ x.T))  # squared distances
    alive = ~np.eye(n, dtype=bool)
    out = np.full((n, degree), -1, np.int32)
    for j in range(min(degree, n - 1)):
        masked = np.where(alive, far, np.inf)
        pick = masked.argmin(axis=1)
        some = np.isfinite(masked[np.arange(n), pick])
        if not some.any():
            break
        out[some, j] = pick[some]
        alive &= ~(alpha * alpha * far[pick] <= far)
        alive[np.arange(n), pick] = False
    return out


def range_search(q: np.ndarray, x: np.ndarray, adj: np.ndarray, starts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) places of similarity least or more that the greedy search meets; float32 unit rows."""
    nq, n = len(q), len(x)
    wide = 1 - (1 - least) * WIDER * WIDER
    seen, pending = np.zeros((nq, n), bool), np.zeros((nq, n), bool)
    sims = np.full((nq, n), -2.0, np.float32)
    rows = np.arange(nq)

    def visit(who: np.ndarray, nodes: np.ndarray) -> None:
        ok = nodes >= 0
        ok[ok] = ~seen[np.broadcast_to(who[:, None], nodes.shape)[ok], nodes[ok]]
        w, v = np.broadcast_to(who[:, None], nodes.shape)[ok], nodes[ok]
        for at in range(0, len(w), 100_000):
            a, b = w[at : at + 100_000], v[at : at + 100_000]
            sims[a, b] = np.einsum("ij,ij->i", q[a], x[b])
        seen[w, v] = True
        pending[w, v] = True

    visit(rows, np.broadcast_to(starts, (nq, len(starts))).copy())
    active = rows
    for _ in range(4 * BEAM):  # near the query: the best unexpanded node of the beam
        s = sims[active]
        beam = -np.partition(-s, BEAM - 1, axis=1)[:, BEAM - 1] if n > BEAM else np.full(len(active), -2.0, np.float32)
        s = np.where(pending[active], s, -3)
        best = s.argmax(axis=1)
        going = s[np.arange(len(active)), best] >= np.maximum(beam, -2.0)
        active, best = active[going], best[going]
        if not len(active):
            break
        pending[active, best] = False
        visit(active, adj[best])
    pending &= sims >= wide
    while True:  # expand all that is in range
        active = np.flatnonzero(pending.any(axis=1))
        if not len(active):
            break
        best = pending[active].argmax(axis=1)
        pending[active, best] = False
        visit(active, adj[best])
        pending[active] &= sims[active] >= wide
    return np.nonzero(sims >= least - 1e-4)


def _rows(column) -> np.ndarray:
    n = len(column)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _assign(shared):
    def run(batches):
        known = shared.value
        for batch in batches:
            labels = batch.column("shape").to_pylist()
            c1, c2 = np.zeros(len(labels), np.int32), np.full(len(labels), -1, np.int32)
            vectors = batch.column("vec")
            for label in {x for x in labels if x in known}:
                at = np.array([i for i, x in enumerate(labels) if x == label])
                v = _unit(_rows(pa.chunked_array([vectors.take(pa.array(at))])))
                near = np.argsort(-(v @ known[label].T), axis=1)[:, :2]
                c1[at], c2[at] = near.min(axis=1), near.max(axis=1)
            yield pa.record_batch([batch.column("node"), batch.column("shape"), pa.array(c1), pa.array(c2)], ["node", "shape", "c1", "c2"])

    return run


def _build(batches):
    for t in groups(batches, ["shape", "cluster", "part"]):
        node = t.column("node").to_numpy()
        adj = robust_graph(_unit(_rows(t.column("vec"))).astype(np.float32))
        size = (adj >= 0).sum(axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(node[adj[adj >= 0]]))
        yield pa.record_batch({"node": t.column("node").combine_chunks(), "near": lists})


def medoids(x: np.ndarray, more: int = 3) -> np.ndarray:
    """The node nearest to the mean, then the nodes farthest from those chosen."""
    out = [int((x @ x.mean(axis=0)).argmax())]
    close = x @ x[out[0]]
    for _ in range(min(more, len(x) - 1)):
        out.append(int(close.argmin()))
        close = np.maximum(close, x @ x[out[-1]])
    return np.array(sorted(set(out)))


def _search(least: float, batch_rows: int = 512):
    def run(batches):
        shard = None

        def finish(s):
            """Links of the shard's classes, a row for each node that has one."""
            own, first = s["label"], s["first"]
            q = [k for k in first if s["node"][own[first[k]]] != k]
            u = q + s["node"][np.flatnonzero(own != np.arange(len(own)))].tolist()
            v = [int(s["node"][own[first[k]]]) for k in q] + s["node"][own[own != np.arange(len(own))]].tolist()
            return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array([0] * len(u), pa.int64())})

        for t in groups(batches, ["shape", "cluster", "part", "role", "piece"]):
            key = tuple(t.column(k)[0].as_py() for k in ("shape", "cluster", "part"))
            vec, node, c = _unit(_rows(t.column("vec"))), t.column("node").to_numpy(), np.stack([t.column("c1").to_numpy(), t.column("c2").to_numpy()], axis=1)
            if t.column("role")[0].as_py() == 0:
                if shard:
                    yield finish(shard)
                order = np.argsort(node)
                place = lambda ids, known=node[order], order=order: np.where(known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids, order[np.minimum(np.searchsorted(known, ids), len(known) - 1)], -1)
                lists = [place(np.array(x or [], np.int64)) for x in t.column("near").to_pylist()]
                adj = np.full((len(node), max(1, *map(len, lists)) if lists else 1), -1, np.int32)
                for i, x in enumerate(lists):
                    adj[i, : len(x)] = x
                x32 = vec.astype(np.float32)
                shard = {"key": key, "node": node, "vec": vec, "x": x32, "adj": adj, "c": c, "copies": t.column("copies").to_numpy(), "starts": medoids(x32), "label": np.arange(len(node)), "first": {}}
                continue
            if not shard or shard["key"] != key:
                continue
            for at in range(0, len(node), batch_rows):
                ids, v, cc = node[at : at + batch_rows], vec[at : at + batch_rows], c[at : at + batch_rows]
                a, b = range_search(v.astype(np.float32), shard["x"], shard["adj"], shard["starts"], least)
                ok = ids[a] != shard["node"][b]
                a, b = a[ok], b[ok]
                sure = np.concatenate([np.einsum("ij,ij->i", v[a[i : i + 50_000]], shard["vec"][b[i : i + 50_000]]) for i in range(0, len(a), 50_000)]) >= least if len(a) else np.zeros(0, bool)
                a, b = a[sure], b[sure]
                low = (cc[a, :1] == shard["c"][b]).any(axis=1)  # the first cluster that both have
                mine = np.where(low, cc[a, 0], cc[a, 1]) == key[1]
                counts = np.bincount(a[mine], shard["copies"][b[mine]], len(ids)).astype(np.int64)
                some = np.flatnonzero(counts)
                yield pa.record_batch({"u": pa.array(ids[some]), "v": pa.array([None] * len(some), pa.int64()), "n": pa.array(counts[some])})
                for i, group in zip(np.unique(a), np.split(b, np.flatnonzero(np.diff(a)) + 1), strict=True) if len(a) else ():
                    labels = np.unique(shard["label"][group])
                    if len(labels) > 1:
                        shard["label"][np.isin(shard["label"], labels)] = labels[0]
                    shard["first"][int(ids[i])] = int(group[0])
        if shard:
            yield finish(shard)

    return run


def near_duplicate_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """One row per vector: id (as vec_id), n_links, component_id (smallest id reachable), kept.

    Vectors link within an equal non-null label (and equal length) at cosine ``least`` or more. Null, empty, zero
    vectors, and such with null or non-finite components, link with nothing. Equal vectors link with each other.
    Rows with a null id count as links of others, have a null component and are kept. Repeated ids: each row is a
    vector of its own. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & sound, F.lit(False))
    base = base.withColumn("node", F.when(sound, F.xxhash64("label", "vec")))
    base = scratch.table(base, "base")
    shape = F.concat_ws(":", F.size("vec").cast("string"), "label")
    nodes = base.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    nodes = scratch.table(nodes.withColumn("shape", shape).drop("label"), "nodes")

    large = nodes.groupBy("shape").count().where(F.col("count") > SHARD).orderBy(F.desc("count"), "shape").limit(MOST_CENTROIDS // 2).collect()
    total = sum(r["count"] for r in large)
    known = {}
    if large:
        per = max(1, total // min(MOST_CENTROIDS, max(2, total // (SHARD // 2))))
        sample = nodes.join(F.broadcast(spark.createDataFrame([(r["shape"],) for r in large], "shape string")), "shape").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("shape", "vec").collect()
        by: dict[str, list] = {}
        for r in sample:
            by.setdefault(r["shape"], []).append(r["vec"])
        known = {r["shape"]: centroids(_unit(np.array(by[r["shape"]])), max(2, r["count"] // per)) for r in large if len(by.get(r["shape"], ())) > 1}
    homes = scratch.table(nodes.select("node", "shape", "vec").mapInArrow(_assign(spark.sparkContext.broadcast(known)), "node long, shape string, c1 int, c2 int"), "homes")
    member = homes.select("node", "shape", "c1", "c2", F.explode(F.array_compact(F.array("c1", F.when(F.col("c2") >= 0, F.col("c2"))))).alias("cluster"))
    size = member.groupBy("shape", "cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    member = member.join(size, ["shape", "cluster"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(9)), F.col("parts")).cast("int"))
    member = scratch.table(member, "member")
    full = member.join(nodes.select("node", "vec", "copies"), "node")
    keys = ["shape", "cluster", "part"]
    built = full.select("node", *keys, "vec").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_build, "node long, near array<long>")
    union = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # at most two lists a node
    index = full.join(union, "node", "left").select(*keys, F.lit(0).alias("role"), F.lit(0).alias("piece"), "node", "vec", "copies", "c1", "c2", "near")
    asked = full.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select(*keys, F.lit(1).alias("role"), F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("parts") / 2)).cast("int").alias("piece"), "node", "vec", "copies", "c1", "c2", F.lit(None).cast("array<long>").alias("near"))
    work = index.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "role", "piece")
    found = scratch.table(work.mapInArrow(_search(least), "u long, v long, n long"), "found")
    links = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    classes = connected(found.where("v is not null").select("u", "v"), scratch, "class")
    of = nodes.select("node", "copies", "rep").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    lowest = of.groupBy("class").agg(F.min("rep").alias("component_id"))
    of = of.join(lowest, "class").join(links.select(F.col("u").alias("node"), "n"), "node", "left")
    of = of.select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = base.select("vec_id", "node").join(of, "node", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit_recall(vectors: DataFrame, result: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93, sample: int = 200) -> float:
    """Links reported, over links that brute force finds, for a bounded sample of vectors against all rows."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec is not null and label is not null")
    asked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    shared = rows.sparkSession.sparkContext.broadcast((asked["vec_id"].to_numpy(), asked["label"].tolist(), [np.array(v, float) for v in asked["vec"]]))

    def run(batches):
        ids, labels, vs = shared.value
        for batch in batches:
            total = np.zeros(len(ids), np.int64)
            for i, label, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                w = np.array(v, float)
                if not len(w) or not np.isfinite(w).all() or not w.any():
                    continue
                for k in range(len(ids)):
                    if labels[k] == label and ids[k] != i and len(vs[k]) == len(w) and np.isfinite(vs[k]).all() and vs[k].any():
                        total[k] += w @ vs[k] >= least * np.linalg.norm(w) * np.linalg.norm(vs[k])
            yield pa.record_batch({"vec_id": pa.array(ids), "n": pa.array(total)})

    truth = rows.mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    got = truth.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("m")).first()
    return got["m"] / got["n"] if got["n"] else 1.0
