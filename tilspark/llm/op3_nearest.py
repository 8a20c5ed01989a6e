"""Nearest neighbours over balanced posting lists: exact, the lists only save work.

*Fit.*  Centroids come from hierarchical balanced k-means over a sample of at most ``sample`` vectors
(chosen by hash; the bound is a parameter).  There are at most ``max_lists`` of them, so they and
their neighbour graph are of bounded size and are broadcast.
*Index.*  Every vector goes to the lists of all centroids nearly as near as its nearest one (a ratio
of distances), which replicates boundary vectors; a list that is larger than ``list_rows`` is dealt
into as many parts by hash.
*Search.*  A query walks the centroid graph greedily with a beam, and probes the lists whose
distance ratio to the nearest is under a limit, but never fewer than ``least_probes``: a query on a
centroid has no distance to take a ratio of.  Candidates are measured exactly, in double
precision on the original vectors; each list part keeps a query's ``k`` best, and a second
aggregation the best of all parts.
*Proof.*  The k-th distance found so far is a bound: a list whose centroid is farther than the bound
and the list's radius together holds no better answer.  A query goes to the blocks of all other lists
that it has not probed, each vector standing in the block of its nearest centroid only.  Where vectors
are in clusters few lists are left; where they are not, all are, and the work is that of all pairs,
dealt over blocks of at most ``block_bytes``.

Equal vectors are searched once: they are one class (by a 128-bit digest), held in the index with
their smallest ids (a query's answer can hold no more than ``k`` + 1 of them), so a vector that a
third of all rows share is one entry and one query.  Repeated rows of one id count once; ties go to
the smaller id; a vector of any length is read whole; other columns are ignored.  Vectors that are null or zero, hold null or non-finite components or
have another length than most take no part.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .scratch import table


@dataclass(frozen=True)
class Index:
    k: int = 10
    sample: int = 20_000
    list_size: int = 256  # rows of a list, as long as there are fewer than max_lists
    max_lists: int = 8192
    spread: float = 1.15  # a vector joins lists up to so many times its nearest distance
    replicas: int = 4
    probe_ratio: float = 1.5  # a query probes lists up to so many times its nearest distance
    least_probes: int = 64  # whatever the ratio
    probes: int = 96
    beam: int = 128
    degree: int = 24
    list_rows: int = 4096
    block_bytes: int = 3 << 25  # vectors that a task of the proof holds at once
    seed: int = 5


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def keyed_vectors(rows: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """``key, vector, ids``: the usable vectors with a 128-bit digest; equal ones of a batch are one row
    with their k + 1 smallest ids."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = A.small_batches(rows).where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("id"), v.alias("vector"))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            vector = A.column(batch, "vector")
            off = vector.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(vector.values.to_numpy(zero_copy_only=False))).cast("B")
            groups: dict[bytes, list[int]] = {}
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                groups.setdefault(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest(), []).append(i)
            ids = A.column(batch, "id").to_numpy()
            few = [sorted(set(ids[g].tolist()))[: k + 1] if len(g) > 1 else [int(ids[g[0]])] for g in groups.values()]
            first = vector.take(pa.array([g[0] for g in groups.values()]))
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), first, pa.array(few, pa.list_(pa.int64()))], ["key", "vector", "ids"])

    return rows.mapInArrow(A.trimmed(run), "key binary, vector array<double>, ids array<bigint>")


def classes_of(rows: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """``key, cid, vector, ids``: each distinct vector with its smallest id and its k + 1 smallest ids.

    Vectors are shuffled once, by digest; a class comes as at most one row from each batch, and its
    rows are merged as they pass.
    """

    def run(batches):
        held = None

        def out(table_, last):
            """The classes of all rows, but for the last one if it may go on."""
            keys = A.column(table_, "key").to_pylist()
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            ids = A.column(table_, "ids")
            merged = [ids[a].as_py() if b - a == 1 else sorted(set(x for i in range(a, b) for x in ids[i].as_py()))[: k + 1] for a, b in zip(cut[:-1], cut[1:])]
            first = table_.take(pa.array(cut[:-1]))
            done = pa.RecordBatch.from_arrays([A.column(first, "key"), A.column(first, "vector"), pa.array(merged, pa.list_(pa.int64()))], ["key", "vector", "ids"])
            return (done, None) if last else (done.slice(0, len(done) - 1), done.slice(len(done) - 1))

        def shaped(done):
            return pa.RecordBatch.from_arrays([A.column(done, "key"), pa.array([x[0] for x in A.column(done, "ids").to_pylist()], pa.int64()), A.column(done, "vector"), A.column(done, "ids")], ["key", "cid", "vector", "ids"])

        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch.cast(held.schema)])
            done, held = out(batch, False)
            if len(done):
                yield shaped(done)
        if held is not None and len(held):
            yield shaped(held)

    p = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed_vectors(rows, k, id_col, vector_col).repartition(p, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(A.trimmed(run), "key binary, cid bigint, vector array<double>, ids array<bigint>")


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def balanced_centroids(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Splits the largest part in up to eight of about equal size until there are enough."""
    parts = [x]
    while len(parts) < lists:
        k = max(range(len(parts)), key=lambda i: len(parts[i]))
        p = parts.pop(k)
        n = min(8, lists - len(parts), len(p))
        if n < 2:
            parts.append(p)
            break
        c = p[rng.choice(len(p), n, replace=False)]
        for _ in range(6):
            d = _near(p, c)
            # a penalty for what a centre already holds keeps the parts even
            load = np.zeros(n)
            own = d.argmin(1)
            weight = d.mean() / max(1, len(p) / n)
            for _ in range(3):
                load = np.bincount(own, minlength=n)
                own = (d + weight * load[None, :]).argmin(1)
            c = np.stack([p[own == i].mean(0) if (own == i).any() else p[rng.integers(len(p))] for i in range(n)])
        own = _near(p, c).argmin(1)
        found = [p[own == i] for i in range(n) if (own == i).any()]
        if len(found) < 2:
            found = [p[: len(p) // 2], p[len(p) // 2 :]]
        parts.extend(found)
    return np.stack([p.mean(0) for p in parts])


class CentroidGraph:
    """Nearest-neighbour graph over centroids, searched greedily with a beam."""

    def __init__(self, c: np.ndarray, degree: int):
        self.c = c
        n = len(c)
        self.links = np.zeros((n, min(degree, max(1, n - 1))), np.int64)
        for a in range(0, n, 512):
            d = _near(c[a : a + 512], c)
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            self.links[a : a + 512] = np.argsort(d, axis=1)[:, : self.links.shape[1]] if n > 1 else 0
        # entry points far from each other
        entry = [0]
        best = _near(c, c[:1])[:, 0]
        while len(entry) < min(n, max(8, int(n**0.5))):
            entry.append(int(best.argmax()))
            best = np.minimum(best, _near(c, c[entry[-1] : entry[-1] + 1])[:, 0])
        self.entry = np.array(entry)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and distances of the (about) beam nearest centroids, nearest first."""
        d = np.sqrt(((self.c[self.entry] - q) ** 2).sum(1))
        seen = np.zeros(len(self.c), bool)
        ids = self.entry[np.argsort(d)[:beam]]
        seen[ids] = True
        dist = np.sort(d)[:beam]
        opened = np.zeros(len(ids), bool)
        while not opened.all():
            k = np.flatnonzero(~opened)[:8]
            opened[k] = True
            new = np.unique(self.links[ids[k]].ravel())
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                nd = np.sqrt(((self.c[new] - q) ** 2).sum(1))
                ids, dist, opened = np.concatenate([ids, new]), np.concatenate([dist, nd]), np.concatenate([opened, np.zeros(len(new), bool)])
                order = np.argsort(dist, kind="stable")[:beam]
                ids, dist, opened = ids[order], dist[order], opened[order]
        return ids, dist


def fit(vectors: DataFrame, index: Index) -> np.ndarray:
    """Centroids from a sample that is bounded by ``index.sample``."""
    n = vectors.count()
    if not n:
        return np.zeros((0, 1))
    share = min(1.0, 1.2 * index.sample / n)
    cut = int(share * 2**32)
    rows = vectors.where(F.pmod(F.xxhash64(F.lit(index.seed), "cid"), F.lit(2**32)) < cut).select("vector").limit(index.sample).toPandas()["vector"]
    dims = [len(v) for v in rows]
    if not dims:
        return np.zeros((0, 1))
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    x = np.stack([v for v in rows if len(v) == dim]).astype(np.float64)
    lists = int(min(index.max_lists, max(1, n // index.list_size), max(1, len(x) // 2)))
    return balanced_centroids(x, lists, np.random.default_rng(index.seed))


def _matrix(arr: pa.Array) -> np.ndarray:
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1)


def _open_lists(x: np.ndarray, bound: np.ndarray, c: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which lists (of centres ``c``) may hold a vector within its bound of each row of x."""
    norm = np.sqrt((x * x).sum(1).max()) + np.sqrt((c * c).sum(1).max())
    # a distance near zero is known to the root of the precision only
    return np.sqrt(_near(x, c)) - radius[None, :] <= bound[:, None] + 1e-6 * norm


def _within(x: np.ndarray, bound: np.ndarray, mat: np.ndarray, cid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, the k nearest of mat within each row's bound and their distances.  Products choose
    generously, differences decide; mat is looked at in pieces, and a row's bound shrinks to its k-th
    distance so far."""
    bound = bound.copy()
    norm = (x * x).sum(1)
    r, c, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(mat), 4096):
        piece = mat[at : at + 4096]
        rough = _near(x, piece)
        limit = bound * bound
        if not np.isfinite(limit).all():
            limit = np.minimum(limit, np.partition(rough, min(k, len(piece)) - 1, axis=1)[:, min(k, len(piece)) - 1])
        pr, pc = np.nonzero(rough <= (limit + 1e-10 * (norm + (piece * piece).sum(1).max() + np.where(np.isfinite(limit), limit, 0)))[:, None])
        if not len(pr):
            continue
        diff = piece[pc] - x[pr]
        r, c, d = np.concatenate([r, pr]), np.concatenate([c, pc + at]), np.concatenate([d, np.sqrt((diff * diff).sum(1))])
        order = np.lexsort((cid[c], d, r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        last = place == k - 1
        bound[r[last]] = np.minimum(bound[r[last]], d[last])
        keep = place < k
        r, c, d = r[keep], c[keep], d[keep]
    return r, c, d


def _proved(found: DataFrame, asked: DataFrame, postings: DataFrame, graph, index: Index) -> DataFrame:
    """``query, cid, ids, score`` of what the lists that a query has not probed hold within its k-th
    distance so far."""
    spark = found.sparkSession
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    home = postings.where("far is not null")
    sizes = home.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("r")).orderBy("list").collect()  # at most max_lists rows
    lists, dim = len(graph.value.c), graph.value.c.shape[1]
    rows = sum(s["n"] for s in sizes)
    most = max(1, min(index.block_bytes // (8 * dim), max(2048, -(-rows // (2 * spark.sparkContext.defaultParallelism)))))
    # a block is some whole lists, a list beyond a block's size some blocks
    radius, first, pieces, block, fill = np.full(lists, -np.inf), np.zeros(lists, np.int32), np.ones(lists, np.int32), 0, 0
    for s in sizes:
        at, n = s["list"], s["n"]
        if fill and fill + n > most:
            block, fill = block + 1, 0
        radius[at], first[at], pieces[at] = s["r"], block, -(-n // most)
        fill += n
        if pieces[at] > 1:
            block, fill = block + int(pieces[at]), 0
    plan = spark.sparkContext.broadcast((radius, first, pieces))

    # the smallest distance within which there are k + 1 ids: one of them may be the query's own
    w = Window.partitionBy("query").orderBy("score", "cid").rowsBetween(Window.unboundedPreceding, 0)
    bounds = found.withColumn("held", F.sum(F.size("ids")).over(w)).where(F.col("held") > index.k).groupBy("query").agg(F.min("score").alias("bound"))
    bounded = asked.join(bounds, F.col("cid") == F.col("query"), "left").select("cid", "vector", "lists", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def route(batches):
        c = graph.value.c
        radius, first, pieces = plan.value
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                x = _matrix(A.column(part, "vector"))
                open_ = _open_lists(x, A.column(part, "bound").to_numpy(), c, radius)
                probed = A.column(part, "lists")
                open_[np.repeat(np.arange(len(part)), np.diff(probed.offsets.to_numpy())), probed.flatten().to_numpy()] = False
                r, at = np.nonzero(open_)
                to = np.repeat(first[at], pieces[at]) + (np.arange(pieces[at].sum()) - np.repeat(np.cumsum(pieces[at]) - pieces[at], pieces[at]))
                each = np.unique(np.stack([np.repeat(r, pieces[at]), to]), axis=1)
                near = _near(x, c).argmin(1).astype(np.int32)
                for j in range(0, each.shape[1], 4096):
                    rr, bb = each[0, j : j + 4096], each[1, j : j + 4096]
                    taken = part.take(pa.array(rr))
                    yield pa.RecordBatch.from_arrays([pa.array(bb.astype(np.int32)), pa.array(near[rr]), A.column(taken, "cid"), A.column(taken, "vector"), A.column(taken, "bound")], ["block", "list", "cid", "vector", "bound"])

    vector = "vector array<double>"
    routed = table(bounded.mapInArrow(A.trimmed(route), f"block int, list int, cid bigint, {vector}, bound double"), "routed")
    if routed.isEmpty():
        return found.limit(0).select("query", "cid", "ids", "score")
    info = spark.createDataFrame([(s["list"], int(first[s["list"]]), int(pieces[s["list"]])) for s in sizes], "list int, first int, pieces int")
    own = home.join(F.broadcast(info), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int"))
    blocks = routed.select("block").distinct()  # those that are asked
    own = own.join(F.broadcast(blocks), "block", "left_semi")

    def measure(batches):
        c = graph.value.c
        radius = plan.value[0]
        key = None
        for batch in batches:
            block, kind, at, cid = (A.column(batch, x).to_numpy(zero_copy_only=False) for x in ("block", "kind", "list", "cid"))
            vec = _matrix(A.column(batch, "vector"))
            cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(vec)]):
                if a == b:
                    continue
                if block[a] != key:
                    key, x, lists_, cids, ids, mat = block[a], [], [], [], [], None
                if kind[a] == 0:
                    x.append(vec[a:b].copy())
                    lists_.append(at[a:b].copy())
                    cids.append(cid[a:b].copy())
                    ids.append(A.column(batch, "ids").slice(a, b - a))
                    continue
                if mat is None:
                    mat, all_lists, all_cids, all_ids = np.concatenate(x), np.concatenate(lists_), np.concatenate(cids), pa.concat_arrays(ids)
                    x, ids = [], []
                    here, where = np.unique(all_lists, return_inverse=True)
                for i in range(a, b, 256):
                    q, bound = vec[i : min(b, i + 256)], A.column(batch, "bound").slice(i, min(b, i + 256) - i).to_numpy(zero_copy_only=False)
                    some = _open_lists(q, bound, c[here], radius[here]).any(0)
                    rows_ = None if some.all() else np.flatnonzero(some[where])
                    r, m, d = _within(q, bound, mat if rows_ is None else mat[rows_], all_cids if rows_ is None else all_cids[rows_], index.k + 1)
                    m = m if rows_ is None else rows_[m]
                    yield pa.RecordBatch.from_arrays([pa.array(cid[i + r]), pa.array(all_cids[m]), all_ids.take(pa.array(m)), pa.array(d)], ["query", "cid", "ids", "score"])

    none, zero = F.expr("cast(array() as array<bigint>)").alias("ids"), F.lit(0.0).alias("bound")
    both = own.select("block", F.lit(0).alias("kind"), "list", "cid", "vector", "ids", zero).unionByName(routed.select("block", F.lit(1).alias("kind"), "list", "cid", "vector", none, "bound"))
    # queries of one list are neighbours, so that the lists they leave open are few
    dealt = both.repartition(p, "block").sortWithinPartitions("block", "kind", "list")
    return dealt.mapInArrow(A.trimmed(measure), "query bigint, cid bigint, ids array<bigint>, score double")


def nearest(rows: DataFrame, queries: DataFrame, index: Index = Index(), *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row of ``queries`` against all of ``rows``."""
    spark = rows.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    all_classes = table(classes_of(rows, index.k, id_col, vector_col), "vectors")
    centroids = fit(all_classes.select("cid", "vector"), index)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    dim = centroids.shape[1]
    all_classes = all_classes.where(F.size("vector") == dim)
    graph = spark.sparkContext.broadcast(CentroidGraph(centroids, index.degree))

    def assign(batches):
        g = graph.value
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                x = _matrix(A.column(part, "vector"))
                d = np.sqrt(_near(x, g.c))
                m = min(index.replicas, d.shape[1])
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                nd = np.take_along_axis(d, near, 1)
                keep = nd <= index.spread * nd.min(1, keepdims=True) + 1e-12
                r, c = np.nonzero(keep)
                taken = part.take(pa.array(r))
                # the distance to the nearest centroid, in one of a vector's rows
                far = pa.array(nd[r, c], mask=c != nd.argmin(1)[r])
                yield pa.RecordBatch.from_arrays([pa.array(near[r, c].astype(np.int32)), A.column(taken, "cid"), A.column(taken, "vector"), A.column(taken, "ids"), far], ["list", "cid", "vector", "ids", "far"])

    vector = "vector array<double>"
    postings = table(all_classes.mapInArrow(A.trimmed(assign), f"list int, cid bigint, {vector}, ids array<bigint>, far double"), "postings")
    parts = postings.groupBy("list").agg(F.ceil(F.count("*") / index.list_rows).cast("int").alias("parts"))  # at most max_lists rows

    wanted = keyed_vectors(queries, 2**31, id_col, vector_col).where(F.size("vector") == dim).select("key", "vector", F.explode("ids").alias("query_id"))
    known = wanted.join(all_classes.select("key", "cid"), "key", "left")  # digests meet, not vectors
    wanted = table(known.select("query_id", "vector", F.coalesce("cid", -F.col("query_id") - 1).alias("cid")), "queries")
    asked = wanted.groupBy("cid").agg(F.first("vector").alias("vector"))

    def route(batches):
        g = graph.value
        for batch in batches:
            x = _matrix(A.column(batch, "vector"))
            lists = []
            for q in x:
                ids, d = g.search(q, index.beam)
                ids, d = ids[: index.probes], d[: index.probes]
                lists.append(ids[(d <= index.probe_ratio * d[0] + 1e-12) | (np.arange(len(d)) < index.least_probes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([A.column(batch, "cid"), A.column(batch, "vector"), pa.array(lists, pa.list_(pa.int32()))], ["cid", "vector", "lists"])

    asked = table(asked.mapInArrow(A.trimmed(route), f"cid bigint, {vector}, lists array<int>"), "asked")
    held = postings.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def candidates(some):
        routed = some.select(F.explode("lists").alias("list"), "cid", "vector").join(F.broadcast(parts), "list")
        routed = routed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = held.select("list", "part", F.lit(0).alias("kind"), "cid", "vector", "ids").unionByName(routed.select("list", "part", F.lit(1).alias("kind"), "cid", "vector", F.expr("cast(array() as array<bigint>)").alias("ids")))
        dealt = both.repartition(p, "list", "part").sortWithinPartitions("list", "part", "kind")
        return dealt.mapInArrow(A.trimmed(measure), "query bigint, cid bigint, ids array<bigint>, score double")

    def top_of(x, mat, cid):
        """Rows of x, their k + 1 nearest of mat (one may be the query's own class) and the distances.
        Products choose generously, differences decide."""
        m = min(index.k + 1, len(mat))
        rough = _near(x, mat)
        slack = 1e-10 * ((x * x).sum(1) + (mat * mat).sum(1).max())
        limit = np.partition(rough, m - 1, axis=1)[:, m - 1] + slack
        r, c = np.nonzero(rough <= limit[:, None])
        diff = mat[c] - x[r]
        d = np.sqrt((diff * diff).sum(1))
        order = np.lexsort((cid[c], d, r))
        r, c, d = r[order], c[order], d[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < m
        return r[keep], c[keep], d[keep]

    def measure(batches):
        key, x, cid, ids = None, [], [], []
        mat = None
        for batch in batches:
            cols = [A.column(batch, c).to_numpy(zero_copy_only=False) for c in ("list", "part", "kind", "cid")]
            vec = _matrix(A.column(batch, "vector"))
            held_ids = A.column(batch, "ids")
            cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(vec)]):
                if a == b:
                    continue
                here = (cols[0][a], cols[1][a])
                if here != key:
                    key, x, cid, ids, mat = here, [], [], [], None
                if cols[2][a] == 0:
                    x.append(vec[a:b].copy())
                    cid.append(cols[3][a:b].copy())
                    ids.append(held_ids.slice(a, b - a))
                    mat = None
                    continue
                if not x:
                    continue
                if mat is None:
                    mat, all_cid, all_ids = np.concatenate(x), np.concatenate(cid), pa.concat_arrays(ids)
                for i in range(a, b, 256):
                    r, c, d = top_of(vec[i : min(b, i + 256)], mat, all_cid)
                    yield pa.RecordBatch.from_arrays([pa.array(cols[3][i + r]), pa.array(all_cid[c]), all_ids.take(pa.array(c)), pa.array(d)], ["query", "cid", "ids", "score"])

    def best(found):  # classes of each query's class
        found = found.groupBy("query", "cid").agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
        return found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "cid"))).where(F.col("r") <= index.k + 1).drop("r")

    found = table(best(candidates(asked)), "found")
    found = best(_proved(found, asked, postings, graph, index).unionByName(found))
    answers = found.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("best"))
    each = wanted.select("query_id", "cid").join(answers, F.col("cid") == F.col("query")).select("query_id", F.explode("best").alias("b"))
    each = each.select("query_id", F.col("b.score").alias("score"), F.explode("b.ids").alias("vec_id")).where("vec_id <> query_id")
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= index.k)
    return each.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


SQL = None  # tests compare with brute force
