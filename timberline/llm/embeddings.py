"""Embedding near-duplicates: product quantisation over inverted lists, exact cosine rerank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import connected_components, materialize, read_table

COSINE = 0.98
#: Vectors that fit the index at most; vectors of a cell aimed at; lists at most, and cells of a list; parts of a vector and
#: codewords of each.
SAMPLE, LIST, LISTS, PARTS, WORDS = 8192, 256, 512, 8, 64
#: Rows of a list that meet in one task, a side.
SIDE = 4096


def _kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of x by Lloyd's rounds from distinct rows; fewer where there are fewer."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c**2).sum(axis=1)).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(near, x[:, j], len(c)) / np.maximum(n, 1), c[:, j])
    return c


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)


def _near(x: np.ndarray, c: np.ndarray, apart: np.ndarray, limit: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each row's nearest centre, and all centres the plane halfway to which is no farther from the row than ``limit``."""
    d = _far(x, c)
    own = d.argmin(axis=1)
    off = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart[own])
    off[np.arange(len(x)), own] = 0
    rows, cells = np.nonzero(off <= limit)
    return own, np.split(cells, np.cumsum(np.bincount(rows, minlength=len(x)))[:-1])


def _gaps(c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_far(c, c), 1e-30))


@dataclass
class Index:
    """Inverted lists by their centres, each cut into cells by what a vector leaves beyond its list's centre: the cells' centres
    are the same in all lists, so LISTS + LISTS centres make LISTS * LISTS cells. For each part of a vector its bounds, and the
    codewords of what the cell's centre leaves."""

    centres: np.ndarray
    cells: np.ndarray
    bounds: list[tuple[int, int]]
    books: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Index:
        """lists: about how many cells there shall be in all."""
        most = max(1, min(LISTS, len(x) // 8))
        centres = _kmeans(x, min(lists, most))
        r = x - centres[_far(x, centres).argmin(axis=1)]
        k = min(-(-lists // len(centres)), most)
        cells = _kmeans(r, k) if k > 1 else np.zeros((1, x.shape[1]))
        r = r - cells[_far(r, cells).argmin(axis=1)]
        edges = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        bounds = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        return cls(centres, cells, bounds, [_kmeans(r[:, a:b], WORDS) for a, b in bounds])

    def places(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray], list[list[int]], list[list[np.ndarray]]]:
        """Of each row: its list; the lists it visits, its own among them; in each of these its cell; and the cells it probes there.

        Two vectors within ``reach`` of each other in two lists lie on both sides of the plane halfway between the lists'
        centres, so one of them is within half of reach of it and visits the other's list, in any dimension. In a list both
        are in it is the same with their cells.
        """
        limit = reach / 2 + 1e-6
        home, lists = _near(x, self.centres, _gaps(self.centres), limit)
        rows = np.repeat(np.arange(len(x)), [len(v) for v in lists])
        own, probed = _near(x[rows] - self.centres[np.concatenate(lists)], self.cells, _gaps(self.cells), limit)
        ends = np.cumsum([len(v) for v in lists])
        return home, lists, [own[e - len(v) : e].tolist() for e, v in zip(ends, lists)], [probed[e - len(v) : e] for e, v in zip(ends, lists)]

    def codes(self, x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codewords of what a centre leaves of each row, and the error they leave."""
        r = x - centre
        codes, left = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, ((a, b), book) in enumerate(zip(self.bounds, self.books)):
            e = _far(r[:, a:b], book)
            codes[:, m] = e.argmin(axis=1)
            left += np.maximum(e.min(axis=1), 0)
        return codes, np.sqrt(left)

    def distances(self, queries: np.ndarray, centre: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to a cell's coded members, by sums of table entries."""
        r = queries - centre
        out = np.zeros((len(queries), len(codes)))
        for m, ((a, b), book) in enumerate(zip(self.bounds, self.books)):
            out += _far(r[:, a:b], book)[:, codes[:, m]]
        return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components, for edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _known(vectors: DataFrame) -> DataFrame:
    """vec_id, label, e (floats as they are, else doubles), dim and same (a hash of 128 bits, equal for equal vectors) of the vectors
    that can be linked."""
    floats = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    good = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = vectors.select("vec_id", "label", F.col("embedding").cast("array<float>" if floats else "array<double>").alias("e")).where("label is not null and e is not null and vec_id is not null").where(F.coalesce(good, F.lit(False)) & F.exists("e", lambda x: x != 0))
    return known.withColumns({"dim": F.size("e"), "same": F.struct(F.xxhash64("e").alias("a"), F.xxhash64(F.lit(1), "e").alias("b"))})


def near_links(known: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(n, edges) of known(vec_id, label, e, dim, copies): n(vec_id, n_links), the number of vectors (copies counted) linked with
    each, but for its own copies; edges(a, b), whose components are those of all links.

    The index is fitted on at most SAMPLE vectors; every row is indexed. Cells are kept apart by label and by number of
    components, and grow in number with the largest label. A row is a member of its cell in every list it visits, and a query in
    the cells it probes there; table look-ups leave the pairs which the members' quantisation errors can't exclude, and those
    are compared exactly. Pairs are counted where they meet, and once only. Large cells are cut into squares of SIDE
    rows a side, so no task holds a cell; a square emits a row for each of its vectors that has links, never a pair.
    """
    spark = known.sparkSession
    stats = known.groupBy("label", "dim").agg(F.count("*").alias("n"))
    dims = {r["dim"]: r["most"] for r in stats.groupBy("dim").agg(F.max("n").alias("most")).collect()}
    reach = float(np.sqrt(2 - 2 * cosine))
    models = {}
    for dim, most in dims.items():
        rows = known.where(F.col("dim") == dim).select("vec_id", "e").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow()
        x = np.array(rows.column("e").to_pylist(), dtype=float)
        models[dim] = Index.fit(_unit(x), max(1, most // LIST))
    shared = spark.sparkContext.broadcast(models)  # 2 * LISTS and WORDS rows a dimension
    known = known.select("vec_id", "label", "dim", "copies", "e")

    def assign(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                dims, es = some.column(2).to_numpy(), some.column(4)
                got = [np.empty(len(dims), dtype=object) for _ in range(4)]
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    found = shared.value[dim].places(_unit(np.stack([es[int(i)].values.to_numpy(zero_copy_only=False) for i in rows])), reach)
                    for column, values in zip(got, found):
                        for i, v in zip(rows, values):
                            column[i] = v
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array(list(c), k) for c, k in zip(got, (pa.int32(), ints, ints, pa.list_(ints)))]], [*some.schema.names, "home", "lists", "own", "cells"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema)
    placed = materialize(known.mapInArrow(assign, schema + ", home int, lists array<int>, own array<int>, cells array<array<int>>"), "pq-placed")
    key = ["label", "dim", "list", "cell"]
    visits = placed.select("*", F.posexplode("lists").alias("p", "list")).withColumns({"own": F.get("own", "p"), "cells": F.get("cells", "p")})
    stops = visits.withColumn("cell", F.explode("cells")).drop("p")
    sizes = stops.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / SIDE).cast("int").alias("sides"))
    stops = stops.join(sizes, key).withColumn("side", F.pmod(F.xxhash64("vec_id"), F.col("sides")).cast("int"))
    every = F.sequence(F.lit(0), F.col("sides") - 1)
    as_member = F.when(F.col("own") == F.col("cell"), F.transform(every, lambda j: F.struct(F.col("side").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    as_query = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("side").alias("j")))
    squares = stops.withColumn("at", F.explode(F.array_union(as_member, as_query))).withColumns({"i": F.col("at.i"), "j": F.col("at.j")}).drop("at", "sides")

    def square(frame: pd.DataFrame) -> pd.DataFrame:
        model, here, cell = shared.value[int(frame["dim"].iloc[0])], int(frame["list"].iloc[0]), int(frame["cell"].iloc[0])
        ids, side, own, home, copies = (frame[k].to_numpy() for k in ("vec_id", "side", "own", "home", "copies"))
        ms, qs = np.flatnonzero((own == cell) & (side == frame["i"].iloc[0])), np.flatnonzero(side == frame["j"].iloc[0])
        n, firsts, seconds = np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(ms) and len(qs):
            u = _unit(np.stack(frame["e"].to_numpy()))
            visited, probed = frame["lists"].to_numpy(), frame["cells"].to_numpy()
            centre = model.centres[here] + model.cells[cell]
            codes, err = model.codes(u[ms], centre)
            limit = (reach + err) ** 2 + 1e-9

        def counts(q: int, m: int) -> bool:
            """Whether a pair of two lists or cells counts here, not where its rows meet with their parts exchanged."""
            if home[q] != home[m]:
                host, guest = (q, m) if home[q] == here else (m, q)
                if home[guest] < here and home[guest] in visited[host]:
                    return False
            return own[q] == cell or not (own[q] < cell and own[q] in probed[m])

        def candidates():
            """Pairs of a query and a member that the tables can't exclude, one of them of this list at least. A guest that is a
            member meets the list's own as a member only."""
            at_home, guests = qs[home[qs] == here], qs[(home[qs] != here) & (own[qs] != cell)]
            for queries, members in ((at_home, np.arange(len(ms))), (guests, np.flatnonzero(home[ms] == here))):
                step = max(1, 2_000_000 // max(1, len(members)))
                for at in range(0, len(queries) if len(members) else 0, step):
                    part = queries[at : at + step]
                    q, m = np.nonzero(model.distances(u[part], centre, codes[members]) <= limit[members])
                    q, m = part[q], ms[members[m]]
                    good = np.where((own[q] == cell) & (home[m] == here), ids[q] < ids[m], q != m)
                    yield q[good], m[good]

        for q, m in candidates() if len(ms) and len(qs) else ():
            for s in range(0, len(q), 100_000):
                a, b = q[s : s + 100_000], m[s : s + 100_000]
                hit = (u[a] * u[b]).sum(axis=1) >= cosine
                a, b = a[hit], b[hit]
                plain = (home[a] == home[b]) & (own[a] == cell)
                plain[~plain] = [counts(x, y) for x, y in zip(a[~plain], b[~plain])]
                a, b = a[plain], b[plain]
                np.add.at(n, a, copies[b])
                np.add.at(n, b, copies[a])
                firsts.append(a)
                seconds.append(b)
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        root = ids[order][_roots(len(ids), rank[a], rank[b])][rank]
        return pd.DataFrame({"vec_id": ids[n > 0], "n": n[n > 0], "root": root[n > 0]})

    found = materialize(squares.groupBy(*key, "i", "j").applyInPandas(square, "vec_id bigint, n bigint, root bigint"), "pq-found")
    return found.groupBy("vec_id").agg(F.sum("n").alias("n_links")), found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def embedding_components(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector.

    Vectors that are null, zero or hold null or non-finite components, and those without label, are alone, as are
    vectors of different length. Rows with one vec_id are one vector, that of the least components; a null vec_id is linked with
    nothing; extra columns are ignored; an empty table gives none. Equal vectors of a label are one to the index, so that a
    group of copies costs neither its square nor a list: they are linked with each other and share their links.
    """
    known = _known(vectors).groupBy("vec_id").agg(F.min(F.struct("label", "e", "dim", "same")).alias("v")).select("vec_id", "v.*")
    known = materialize(known, "pq-known")
    alike = ["label", "dim", "same"]
    groups = materialize(known.groupBy(*alike).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "pq-groups")
    first = groups.select(F.col("rep").alias("vec_id"), "copies")
    n, edges = near_links(known.drop("same").join(first, "vec_id"), cosine)
    roots = connected_components(edges, "pq-cc")
    groups = groups.withColumnRenamed("rep", "vec_id").join(n, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    groups = groups.select(*alike, (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    linked = known.select("vec_id", *alike).join(groups, alike).select("vec_id", "n_links", "component_id")
    out = vectors.select("vec_id").join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embeddings(spark, sf_dir):
    """Every vector's links and component."""
    return embedding_components(read_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
