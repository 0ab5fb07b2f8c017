"""Nearest neighbours by inner product: a neighbour graph by NN-descent, searched greedily."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.blocks import batch_map
from loomwright.session import stored

EDGE = "u long, v long, s double"


def doubles(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors kept as bytes of doubles, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray) or not len(column):
        return np.zeros((0, 1))
    _, places, content = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(content[int(bounds[0]): int(bounds[-1])], np.float64).reshape(len(column), -1)


def edges(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "s": pa.array(s, pa.float64())})


def best_of(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest scores of every row, in no order."""
    if scores.shape[1] <= most:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(-scores, most - 1, axis=1)[:, :most]


def top(rows: DataFrame, by: str, other: str, most: int) -> DataFrame:
    """The rows with the largest ``s`` for each ``by``; tasks keep no more than ``most`` before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.col("s").desc(), F.col(other))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


@dataclass(frozen=True)
class NeighbourGraph:
    """Approximate nearest neighbours by largest inner product.

    Vectors that are NULL, zero, or hold a NULL or non-finite component take no part, nor do those of a length other
    than the most common one. Equal vectors are one node of the graph, with the ``most`` + 1 smallest of their ids: no
    answer needs more of them. For the graph, vectors get one more component that makes all as long as the longest,
    so that near means a large inner product.

    1. Start: ``starts`` times nodes meet in cells by the signs of random projections, split to at most about
       ``cell`` nodes, and keep the nearest of their cell. Nodes left with fewer than ``degree`` neighbours (far from the
       others, or in small groups) meet among themselves in cells of fewer projections, and each meets one of the cells
       into which a hash deals all nodes, so that every node gets neighbours.
    2. ``rounds`` of NN-descent: every node joins its neighbours, forwards and backwards (at most 2 ``degree``, the
       nearest), and proposes them to each other; a node takes proposals nearer than its worst neighbour and keeps
       ``degree``.
    3. Search: a query starts at its own neighbours and at ``entries`` nodes chosen by a hash; in ``steps`` joins the
       ``wide`` nearest nodes not yet expanded hand over their neighbours; the ``pool`` nearest are kept. A query left with
       fewer than ``most`` rows, though the table has more, is compared with all nodes, block by block.

    Every vector is in the graph; degree, pool and steps are the parameters of its accuracy. Scores are inner products
    of the original vectors in double precision. Ids that repeat are one row each (NULL ids take no part). An empty
    table gives an empty one.
    """

    most: int = 20
    degree: int = 32
    starts: int = 4
    rounds: int = 4
    cell: int = 400
    proposals: int = 16
    pool: int = 300
    wide: int = 48
    steps: int = 4
    entries: int = 64
    block: int = 1000
    key: str = "vec_id"
    vector: str = "embedding"
    seed: int = 5

    def nodes(self, table: DataFrame) -> DataFrame:
        """node (least id), vector as bytes, squared length, and the smallest ids of its equals."""
        raw = table.select(F.col(self.key).alias("id"), F.col(self.vector).cast("array<double>").alias("x"))
        sound = raw.where(
            "id is not null and x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) != double('infinity')) "
            "and exists(x, c -> c != 0)").withColumn("size", F.size("x"))
        sizes = sound.groupBy("size").count().orderBy(F.col("count").desc(), "size").first()
        sound = sound.where(F.col("size") == (sizes[0] if sizes else -1)).select("id", F.transform("x", lambda c: c + F.lit(0.0)).alias("x")).distinct()
        order = Window.partitionBy("x").orderBy("id")
        few = sound.withColumn("n", F.row_number().over(order)).where(F.col("n") <= self.most + 1)
        grouped = few.groupBy("x").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("members"))

        def packed(batch: pa.RecordBatch) -> dict:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            return {"node": batch.column(1), "members": batch.column(2), "x": pa.array([r.tobytes() for r in x], pa.binary()),
                    "length": pa.array((x * x).sum(1))}

        return stored(batch_map(grouped.select("x", "node", "members"), "node long, members array<long>, x binary, length double", packed), "nodes")

    def start(self, points: DataFrame, count: int, width: int) -> DataFrame:
        """Edges within cells of random projections, and of hash-dealt cells for nodes that get too few there."""
        found = self._meet_in_cells(self._projected(points, count, width))
        graph = self._best(found)
        held = graph.groupBy("u").agg(F.count("*").alias("held"))
        thin = stored(points.join(held.withColumnRenamed("u", "node"), "node", "left")
                      .where(F.coalesce("held", F.lit(0)) < min(self.degree, count - 1)).select("node", "x"), "thin")
        few = thin.count()
        if not few:
            return graph
        among = self._meet_in_cells(self._projected(thin, few, width))
        # cells of a few times the degree are large enough for every node, whatever the hash does
        dealt = F.pmod(F.xxhash64(F.lit("dealt"), "node"), F.lit(max(1, count // (8 * self.degree))))
        wanted = thin.select(F.col("node").alias("u"))
        cells = points.withColumn("code", dealt).join(thin.select(dealt.alias("code")).distinct(), "code", "left_semi").withColumn("way", F.lit(0))
        across = self._meet_in_cells(cells.withColumn("part", F.lit(0))).join(wanted, "u", "left_semi")
        return self._best(graph.drop("fresh").unionByName(among).unionByName(across))

    def _projected(self, points: DataFrame, count: int, width: int) -> DataFrame:
        """(node, x, way, code, part): the cells of every node, by the signs of random projections."""
        bits = max(0, int(np.ceil(np.log2(max(1, count / (self.cell / 2))))))
        planes = np.random.default_rng(self.seed).normal(size=(self.starts, bits, width))

        def codes(batch: pa.RecordBatch) -> dict:
            x = doubles(batch.column(1))
            code = [(((x @ p.T) > 0) @ (1 << np.arange(bits, dtype=np.int64))).tolist() if bits else [0] * len(x) for p in planes]
            return {"node": batch.column(0), "x": batch.column(1), "code": pa.array([*zip(*code, strict=True)], pa.list_(pa.int64()))}

        coded = batch_map(points.select("node", "x"), "node long, x binary, code array<long>", codes)
        placed = stored(coded.select("node", "x", F.posexplode("code").alias("way", "code")), "projections")
        sizes = placed.groupBy("way", "code").count()
        return placed.join(sizes, ["way", "code"]).withColumn(
            "part", F.pmod(F.xxhash64("node", "way"), F.ceil(F.col("count") / F.lit(self.cell)).cast("long")))

    def _meet_in_cells(self, cells: DataFrame) -> DataFrame:
        """The ``degree`` nearest of every node in its cells."""
        degree = self.degree

        def near(table: pa.Table) -> pa.Table:
            ids, x = table.column("node").to_numpy(), doubles(table.column("x"))
            scores = x @ x.T
            np.fill_diagonal(scores, -np.inf)
            place = best_of(scores, degree)
            u, v, s = np.repeat(ids, place.shape[1]), ids[place].ravel(), np.take_along_axis(scores, place, 1).ravel()
            real = np.isfinite(s)
            return edges(u[real], v[real], s[real])

        return cells.select("node", "x", "way", "code", "part").groupBy("way", "code", "part").applyInArrow(near, EDGE)

    def _best(self, proposals: DataFrame) -> DataFrame:
        """The nearest proposals of every node; ``fresh`` marks those that are not of the graph before."""
        fresh = F.min("fresh") if "fresh" in proposals.columns else F.lit(True)
        return stored(top(proposals.groupBy("u", "v").agg(F.max("s").alias("s"), fresh.alias("fresh")), "u", "v", self.degree), "graph")

    def both_ways(self, graph: DataFrame) -> DataFrame:
        """(u, v, s, fresh): the nearest of each node's neighbours and of those whose neighbour it is."""
        turned = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "fresh")
        both = graph.unionByName(turned).groupBy("u", "v").agg(F.max("s").alias("s"), F.max("fresh").alias("fresh"))
        return top(both, "u", "v", 2 * self.degree)

    def descend(self, graph: DataFrame, points: DataFrame, count: int) -> DataFrame:
        """One round: neighbours of a node meet there and propose each other, but for pairs that have met before."""
        worst = graph.groupBy("u").agg(F.min("s").alias("worst"), F.count("*").alias("held"))
        # a node with fewer neighbours takes any
        state = points.select("node", "x").join(
            worst.select(F.col("u").alias("node"), F.when(F.col("held") >= self.degree, F.col("worst")).otherwise(F.lit(-1e300)).alias("worst")), "node", "left")
        rows = (self.both_ways(graph).select(F.col("u").alias("at"), F.col("v").alias("node"), "fresh").join(state, "node")
                .withColumn("part", F.pmod(F.xxhash64("at"), F.lit(max(1, count // 128)))))
        most = self.proposals

        def meet(table: pa.Table) -> pa.Table:
            at = table.column("at").to_numpy()
            order = np.argsort(at, kind="stable")
            ids, worst = table.column("node").to_numpy()[order], table.column("worst").to_numpy(zero_copy_only=False)[order]
            worst = np.where(np.isnan(worst), -1e300, worst)
            x, fresh = doubles(table.column("x"))[order], table.column("fresh").to_numpy(zero_copy_only=False)[order]
            cuts = np.flatnonzero(np.diff(at[order], prepend=at[order][0] - 1, append=at[order][-1] + 1))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if not fresh[a:b].any():
                    continue
                scores = x[a:b] @ x[a:b].T
                np.fill_diagonal(scores, -np.inf)
                scores[~(fresh[a:b, None] | fresh[a:b])] = -np.inf
                place = best_of(scores, most)
                s = np.take_along_axis(scores, place, 1)
                own, col = np.nonzero(s > worst[a:b, None])
                out.append((ids[a:b][own], ids[a:b][place[own, col]], s[own, col]))
            if not out:
                return edges(ids[:0], ids[:0], worst[:0])
            return edges(*(np.concatenate(c) for c in zip(*out, strict=True)))

        found = rows.groupBy("part").applyInArrow(meet, EDGE)
        return self._best(graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))))

    def graph(self, nodes: DataFrame) -> DataFrame:
        """(u, v, s): up to ``degree`` neighbours of every node."""
        count, longest = nodes.agg(F.count("*"), F.max("length")).first()
        longest = longest or 0.0

        def lifted(batch: pa.RecordBatch) -> dict:
            x = doubles(batch.column(1))
            extra = np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
            return {"node": batch.column(0), "x": pa.array([r.tobytes() for r in np.column_stack([x, extra])], pa.binary())}

        points = stored(batch_map(nodes.select("node", "x"), "node long, x binary", lifted), "points")
        some = points.select(F.octet_length("x")).first()
        graph = self.start(points, count, some[0] // 8 if some else 1)
        for _ in range(self.rounds):
            graph = self.descend(graph, points, count)
        return graph

    def search(self, queries: DataFrame, nodes: DataFrame, graph: DataFrame) -> DataFrame:
        """(u, v, s): the ``pool`` nearest nodes found for every query node u, itself among them."""
        near = stored(self.both_ways(graph).select(F.col("u").alias("v"), F.col("v").alias("w")), "neighbours")
        vectors = nodes.select("node", "x")
        own = stored(queries.join(vectors, "node").select(F.col("node").alias("u"), F.col("x").alias("q")), "queries")

        def scored(pairs: DataFrame) -> DataFrame:
            rows = pairs.join(vectors.withColumnRenamed("node", "v"), "v").join(own, "u")

            def product(batch: pa.RecordBatch) -> dict:
                return {"u": batch.column(0), "v": batch.column(1),
                        "s": pa.array(np.einsum("ij,ij->i", doubles(batch.column(2)), doubles(batch.column(3))))}

            return batch_map(rows.select("u", "v", "q", "x"), EDGE, product)

        first = own.select("u").join(near.withColumnRenamed("v", "u").withColumnRenamed("w", "v"), "u").select("u", "v")
        begun = scored(first.unionByName(own.select("u", F.col("u").alias("v"))).distinct()).unionByName(self._entered(own, vectors))
        held = stored(begun.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("open", F.col("u") != F.col("v")), "found")
        for _ in range(self.steps):
            fresh = top(held.where("open"), "u", "v", self.wide).select("u", "v")
            reached = fresh.join(near, "v").select("u", F.col("w").alias("v")).distinct().join(held.select("u", "v"), ["u", "v"], "left_anti")
            opened = held.join(fresh.withColumn("now", F.lit(True)), ["u", "v"], "left").select("u", "v", "s", (F.col("open") & F.col("now").isNull()).alias("open"))
            held = stored(top(opened.unionByName(scored(reached).withColumn("open", F.lit(True))), "u", "v", self.pool), "found")
        return self._completed(held.select("u", "v", "s"), own, nodes)

    def _entered(self, own: DataFrame, vectors: DataFrame) -> DataFrame:
        """(u, v, s) of every query with the entry nodes; these are few, and go to the tasks."""
        chosen = vectors.orderBy(F.xxhash64(F.lit("entry"), "node"), "node").limit(self.entries).collect()
        ids = np.array([r.node for r in chosen], np.int64)
        x = np.array([np.frombuffer(r.x, np.float64) for r in chosen])

        def products(batch: pa.RecordBatch) -> dict:
            s = doubles(batch.column(1)) @ x.T if batch.num_rows else np.zeros((0, len(ids)))
            return {"u": pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), len(ids)), pa.int64()),
                    "v": pa.array(np.tile(ids, batch.num_rows), pa.int64()), "s": pa.array(s.ravel(), pa.float64())}

        return batch_map(own.select("u", "q"), EDGE, products)

    def _completed(self, found: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
        """The nodes found; queries whose nodes do not have enough ids get the nearest of all nodes instead."""
        sizes = nodes.select(F.col("node").alias("v"), F.size("members").alias("ids"))
        count, total = sizes.agg(F.count("*"), F.sum("ids")).first()
        enough = found.join(sizes, "v").groupBy("u").agg(F.sum("ids").alias("ids")).where(F.col("ids") >= min(self.most + 1, total or 0)).select("u")
        short = stored(own.join(enough, "u", "left_anti"), "short")
        few = short.count()
        if not few:
            return found
        most = self.most + 1

        def blocks(rows: DataFrame, name: str, vector: str, size: int) -> DataFrame:
            part = F.pmod(F.xxhash64(name), F.lit(max(1, -(-size // self.block))))
            listed = F.collect_list(F.struct(F.col(name).alias("id"), F.col(vector).alias("x")))
            return rows.groupBy(part.alias("part")).agg(listed.alias(vector)).select(vector)

        def nearest(batch: pa.RecordBatch) -> dict:
            u, v, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for q, x in zip(batch.column(0), batch.column(1), strict=True):
                (a, left), (b, right) = ((c.field("id").to_numpy(), doubles(c.field("x"))) for c in (q.values, x.values))
                scores = left @ right.T
                place = best_of(scores, most)
                u.append(np.repeat(a, place.shape[1]))
                v.append(b[place].ravel())
                s.append(np.take_along_axis(scores, place, 1).ravel())
            return {"u": pa.array(np.concatenate(u)), "v": pa.array(np.concatenate(v)), "s": pa.array(np.concatenate(s))}

        pairs = blocks(short, "u", "q", few).crossJoin(blocks(nodes.select("node", "x"), "node", "x", count))
        whole = top(batch_map(pairs, EDGE, nearest), "u", "v", most)
        return found.join(short.select("u"), "u", "left_anti").unionByName(whole)

    def __call__(self, table: DataFrame, every: int) -> DataFrame:
        """query_id, rank, id and score of the nearest rows of every row whose id is divisible by ``every``."""
        nodes = self.nodes(table)
        graph = self.graph(nodes)
        # every id of the table that is a query, with its node
        asked = nodes.select("node", F.explode("members").alias("id"))
        wanted = self._queries(table, nodes, every)
        found = self.search(wanted.select("node").distinct(), nodes, graph)
        near = found.join(asked.select(F.col("node").alias("v"), "id"), "v").select(F.col("u").alias("node"), "id", F.col("s"))
        near = top(near, "node", "id", self.most + 1)
        rows = wanted.join(near, "node").where("query_id != id")
        order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "id")
        return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.most)
                .select("query_id", F.col("rank").cast("int"), F.col("id").alias(self.key), F.col("s").alias("score")))

    def _queries(self, table: DataFrame, nodes: DataFrame, every: int) -> DataFrame:
        """(query_id, node) of the rows asked for."""
        def packed(batch: pa.RecordBatch) -> dict:
            x = [np.array(r, np.float64) + 0.0 for r in batch.column(1).to_pylist()]
            return {"query_id": batch.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary())}

        raw = table.where(F.col(self.key) % every == 0).select(F.col(self.key).cast("long").alias("query_id"), F.col(self.vector).cast("array<double>").alias("x"))
        sound = raw.where("x is not null and forall(x, c -> c is not null)").distinct()
        return batch_map(sound, "query_id long, x binary", packed).join(nodes.select("node", "x"), "x").select("query_id", "node")
