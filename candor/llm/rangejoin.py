"""Embedding near-duplicates by an exact metric range join.

Unit vectors of one label with cosine ``c`` or more lie within ``r = sqrt(2 - 2c)`` of each other.
Pivots, a hash sample of one for each CELL vectors of a label, partition its vectors by the nearest
pivot. By the triangle inequality a vector within r of a member of a cell is at most the cell's radius
plus r from its pivot, and at most 2r farther from it than from its own pivot; vectors for which both
hold are replicated into the cell. So every partner of a cell's own members is in the cell, and cells
are joined independently: own members against all, in blocks of bounded size, so a vector moves once
for each BLOCK vectors that it is compared with. Blocks give counts and a spanning forest of their
links, not the links, and components come from the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.components import connected_components
from candor.llm.scratch import Scratch
from candor.llm.vectors import matrix, unit, usable
from candor.llm.workers import bound_batches, release, trimmed

#: Vectors for each pivot, about. Pivots and the cells' sizes and radii are all that executors get besides rows.
CELL = 16_384
#: Members on each side of a block, and rows of it that are compared at once.
BLOCK, STRIPE = 16_384, 256
#: Distances come from inner products; their rounding error is below this.
_SLACK = 1e-6


def _pivots(vectors: DataFrame) -> dict:
    """(label, width) to its pivots' unit vectors: of labels of more than CELL vectors a hash sample of one for each CELL."""
    sizes = vectors.groupBy("label", "width").agg(F.count("*").alias("n")).filter(F.col("n") > CELL)
    wanted = sizes.select(F.col("label").alias("l"), F.col("width").alias("w"), F.ceil(F.col("n") / CELL).alias("k"), (F.lit(4.0) * F.ceil(F.col("n") / CELL) / F.col("n")).alias("share"))
    place = F.xxhash64("vec_id").bitwiseAND(F.lit(2**63 - 1)) / F.lit(2.0**63)
    few = vectors.join(F.broadcast(wanted), (F.col("label") == F.col("l")) & (F.col("width") == F.col("w"))).filter(place < F.col("share"))
    turn = F.row_number().over(Window.partitionBy("label", "width").orderBy(F.xxhash64("vec_id"), "vec_id"))
    chosen: dict = {}
    for row in few.withColumn("turn", turn).filter("turn <= k").select("label", "width", "embedding").orderBy("label", "width", "turn").collect():
        chosen.setdefault((row["label"], row["width"]), []).append(row["embedding"])
    return {key: unit(np.array(rows, np.float64)) for key, rows in chosen.items() if len(rows) > 1}


def _gaps(x: np.ndarray, pivots: np.ndarray):
    """(rows, distances to all pivots) of some unit vectors at a time."""
    step = max(1, (1 << 22) // len(pivots))
    for lo in range(0, len(x), step):
        yield slice(lo, min(len(x), lo + step)), np.sqrt(np.maximum(0.0, 2 - 2 * (x[lo : lo + step] @ pivots.T)))


def _by_pivots(batch: pa.RecordBatch, pivots: dict):
    """(rows, unit vectors, pivots) of the rows of a batch (label, embedding, ..., width) whose label has pivots."""
    labels, widths = np.array(batch.column(0).to_pylist(), object), np.asarray(batch.column(batch.num_columns - 1))
    for label, width in {(x, w) for x, w in zip(labels, widths.tolist(), strict=True)} & set(pivots):
        rows = np.flatnonzero((labels == label) & (widths == width))
        yield rows, unit(matrix(batch.column(1).take(pa.array(rows)))), pivots[label, width]


class Forest:
    """Components of 0..n-1 under links that come in arrays; each is known by its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]


def range_join(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93
) -> DataFrame:
    """id, n_links, component_id and kept for every row.

    Rows link when their labels are equal and not null and their cosine in double precision is at
    least ``cosine``. Vectors that are null, zero, or hold null or non-finite components, vectors of
    another length, and rows without id or label link with nothing: n_links 0 and their own id as
    component. Rows of one id count as vectors of their own, but are one node of the components.
    component_id is the smallest id reachable by links; kept tells whether it is the row's id. An
    empty table gives an empty table; further columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "rangejoin")
    kind = vectors.schema[id_col].dataType.simpleString()
    label_kind = vectors.schema[label_col].dataType.simpleString()
    ours = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    good = ours.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    # equal vectors of a label are one, with a multiplicity
    good = good.withColumn("h", F.xxhash64("embedding"))
    groups = good.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    groups = scratch.save(groups.withColumn("width", F.size("embedding")), "groups")
    pivots = _pivots(groups)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    shared = spark.sparkContext.broadcast(pivots)
    ordered = groups.select("label", "embedding", "vec_id", "n", "width")
    vector_kind = dict(groups.dtypes)["embedding"]

    def home(batches):
        for b in batches:
            cell, gap = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for rows, x, p in _by_pivots(b, shared.value):
                for part, d in _gaps(x, p):
                    cell[rows[part]], gap[rows[part]] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), pa.array(cell), pa.array(gap)], ["label", "width", "cell", "gap"])

    cells = ordered.mapInArrow(trimmed(home), f"label {label_kind}, width int, cell int, gap double")
    cells = scratch.save(cells.groupBy("label", "width", "cell").agg(F.count("*").alias("own"), F.max("gap").alias("radius")), "cells")
    radii: dict = {}
    many = cells.filter(F.col("cell") > 0).select("label", "width").distinct()  # only cells of labels with pivots come to the driver
    for row in cells.join(F.broadcast(many), ["label", "width"]).collect():
        radii.setdefault((row["label"], row["width"]), {})[row["cell"]] = row["radius"]
    bounds = {key: np.array([radii.get(key, {}).get(c, -np.inf) for c in range(len(p))]) for key, p in pivots.items()}
    edges = spark.sparkContext.broadcast(bounds)

    def replicate(batches):
        """Rows of every cell that may hold a partner of a vector, its own among them."""
        for b in batches:
            found, to, mine = [np.arange(b.num_rows)], [np.zeros(b.num_rows, np.int64)], [np.ones(b.num_rows, bool)]
            labels, widths = np.array(b.column(0).to_pylist(), object), np.asarray(b.column(4))
            for rows, x, p in _by_pivots(b, shared.value):
                radius = edges.value[labels[rows[0]], int(widths[rows[0]])]
                found[0] = np.setdiff1d(found[0], rows)
                for part, d in _gaps(x, p):
                    near = d.min(1)[:, None]
                    inside = (d <= radius + reach + _SLACK) & (d <= near + 2 * reach + _SLACK)
                    own = d.argmin(1)
                    inside[np.arange(len(d)), own] = True
                    i, c = np.nonzero(inside)
                    found.append(rows[part][i])
                    to.append(c)
                    mine.append(own[i] == c)
            to[0], mine[0] = to[0][: len(found[0])], mine[0][: len(found[0])]
            rows = pa.array(np.concatenate(found))
            columns = [b.column(i).take(rows) for i in (0, 4, 2, 3, 1)]
            yield pa.RecordBatch.from_arrays(
                [columns[0], columns[1], pa.array(np.concatenate(to).astype(np.int32)), columns[2], columns[3], columns[4], pa.array(np.concatenate(mine))],
                ["label", "width", "to", "vec_id", "n", "embedding", "mine"],
            )

    each = ordered.mapInArrow(trimmed(replicate), f"label {label_kind}, width int, to int, vec_id {kind}, n bigint, embedding {vector_kind}, mine boolean")
    # how many blocks a cell has on each side; vectors themselves move only once that is known
    size = each.groupBy("label", "width", "to").agg(F.sum(F.col("mine").cast("int")).alias("own"), F.count("*").alias("all"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    size = scratch.save(size.filter("own > 0").select("label", "width", "to", blocks("own").alias("ni"), blocks("all").alias("nj")), "blocks")
    placed = each.join(size, ["label", "width", "to"])
    at = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    steps = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell_of = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    left = F.when(F.col("mine"), F.transform(steps("nj"), lambda j: cell_of(at("ni"), j, True)))
    right = F.transform(steps("ni"), lambda i: cell_of(i, at("nj"), False))
    placed = placed.withColumn("cell", F.explode(F.when(F.col("mine"), F.concat(left, right)).otherwise(right)))
    placed = placed.select("label", "width", "to", "vec_id", "n", "embedding", "cell.*")

    def compare(table: pa.Table) -> pa.Table:
        side, times = np.asarray(table["left"]), np.asarray(table["n"])
        ids, node = np.unique(table["vec_id"].to_numpy(), return_inverse=True)
        x = unit(matrix(table["embedding"]))
        rows, cols = np.flatnonzero(side), np.flatnonzero(~side)
        forest, links = Forest(len(ids)), np.zeros(len(rows), np.int64)
        for lo in range(0, len(rows) if len(cols) else 0, STRIPE):
            some = rows[lo : lo + STRIPE]
            near = x[some] @ x[cols].T >= cosine
            links[lo : lo + STRIPE] = near @ times[cols]
            i, j = np.nonzero(near)
            forest.add(node[some[i]], node[cols[j]])
        hooked = np.flatnonzero(forest.parent != np.arange(len(ids)))
        a = np.concatenate([node[rows], hooked])
        b = np.concatenate([node[rows], forest.parent[hooked]])
        n = np.concatenate([links, np.zeros(len(hooked), np.int64)])
        id_type = table["vec_id"].type
        release()
        return pa.table({"a": pa.array(ids[a], id_type), "b": pa.array(ids[b], id_type), "n": pa.array(n)})

    found = placed.groupBy("label", "width", "to", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}, n bigint")
    found = scratch.save(found, "found")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    links = scratch.save(links, "links")
    named = groups.select("label", "h", "embedding", F.col("vec_id").alias("rep"))
    member = good.join(named, ["label", "h", "embedding"]).select("vec_id", "h", "label", "rep")
    member = scratch.save(member, "member")
    edges = found.filter("a <> b").select("a", "b").unionByName(member.filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    roots = connected_components(scratch, edges)
    counts = member.join(links, "rep").select("vec_id", F.col("h"), F.col("label"), (F.col("n") - 1).alias("n_links"))
    counts = counts.distinct()
    rows = ours.withColumn("h", F.when(usable(F.col("embedding")), F.xxhash64("embedding")))
    out = rows.select("vec_id", "label", "h").join(counts, ["vec_id", "label", "h"], "left")
    out = out.join(roots.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        F.col("vec_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


ORACLE = """
WITH g AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
w AS (WITH RECURSIVE r(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
  SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN w ON v = vec_id LEFT JOIN n ON a = vec_id
"""
