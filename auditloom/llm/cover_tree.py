"""Near-duplicate vectors by cover trees: nested levels with halving radii, traversed two at a time, exact at a threshold."""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, ArrayType, IntegralType, LongType, StructField, StructType

from auditloom.llm.components import components
from auditloom.llm.store import stored

SLACK = 1e-6  # of a distance: bounds within it of the threshold decide nothing, the dot product does
VECTORS = pa.list_(pa.float64())


@dataclass(frozen=True)
class TreeSettings:
    """cosine: least similarity of a link. leaf: about how many vectors one task holds of a node. fan: most children that
    a node gets at a time. levels: rounds in which the nodes above the leaves are split."""

    cosine: float = 0.98
    leaf: int = 4096
    fan: int = 64
    levels: int = 12


# ---- trees within a task ----


def distance(cosines: np.ndarray) -> np.ndarray:
    """Of unit vectors, from their cosines."""
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


@dataclass
class Node:
    """members: rows of the vectors; radius: the furthest of them from the centre (one of them)."""

    centre: int
    members: np.ndarray
    radius: float
    children: "list[Node] | None" = None


class Tree:
    """A cover tree over unit vectors. Nodes are split when they are first asked for their children: by a net at half the
    radius that holds the node's own centre, so that levels nest and every member is covered."""

    def __init__(self, vectors: np.ndarray, fan: int):
        self.vectors, self.fan = vectors, fan
        self.root = Node(0, np.arange(len(vectors)), float(distance(vectors @ vectors[0]).max()))

    def split(self, node: Node) -> "list[Node]":
        """The children; none, if the net needs more than `fan` of them or a quarter of the members."""
        if node.children is None:
            node.children = []
            most = min(self.fan, len(node.members) // 4)
            rows = self.vectors[node.members]
            centres = [int(np.flatnonzero(node.members == node.centre)[0])]
            near = distance(rows @ rows[centres[0]])
            owner = np.zeros(len(rows), np.int64)
            while near.max() > node.radius / 2 and len(centres) <= most:
                centres.append(int(near.argmax()))
                far = distance(rows @ rows[centres[-1]])
                closer = far < near
                near[closer], owner[closer] = far[closer], len(centres) - 1
            if 1 < len(centres) <= most:
                for k, centre in enumerate(centres):
                    ours = np.flatnonzero(owner == k)
                    node.children.append(Node(int(node.members[centre]), node.members[ours], float(near[ours].max())))
        return node.children


class Links:
    """How many others each vector is linked with, and links enough to span what is linked."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.n = np.zeros(len(weights), np.int64)
        self.edges: list[np.ndarray] = []

    def all_of(self, p: np.ndarray, q: np.ndarray, same: bool) -> None:
        """Every vector of p with every one of q."""
        if same:
            self.n[p] += self.weights[p].sum() - self.weights[p]
        else:
            self.n[p] += self.weights[q].sum()
            self.n[q] += self.weights[p].sum()
        both = np.union1d(p, q)
        self.edges.append(np.stack([np.full(len(both), both[0]), both]))

    def some_of(self, p: np.ndarray, q: np.ndarray, hits: np.ndarray, mirrored: bool) -> None:
        """The pairs of p and q that hits marks; mirrored: the other direction is counted, too."""
        left, right = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
        if not len(left):
            return
        hits = hits[np.ix_(left, right)]
        p, q = p[left], q[right]
        self.n[p] += hits @ self.weights[q]
        if mirrored:
            self.n[q] += self.weights[p] @ hits
        if np.count_nonzero(hits) <= 4 * sum(hits.shape):
            a, b = np.nonzero(hits)
            self.edges.append(np.stack([p[a], q[b]]))
            return
        # a star for each component: every row of hits is looked at once
        rows, columns = np.ones(len(p), bool), np.ones(len(q), bool)
        while rows.any():
            front = np.array([rows.argmax()])
            root = p[front[0]]
            while len(front):
                rows[front] = False
                reached = np.flatnonzero(hits[front].any(0) & columns)
                columns[reached] = False
                self.edges.append(np.stack([np.full(len(reached), root), q[reached]]))
                front = np.flatnonzero(hits[:, reached].any(1) & rows)
                self.edges.append(np.stack([np.full(len(front), root), p[front]]))


def dual_traversal(one: Tree, other: Tree, offset: int, links: Links, cosine: float) -> None:
    """All pairs of the two trees' vectors with at least that cosine, each once; offset: added to the other's rows.

    A pair of nodes goes when even their nearest members are too far apart by the covering radii, is taken whole when even
    the furthest are near enough, and else is expanded, until one of the two has no children: then dot products decide.
    """
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    stack = [(one.root, other.root)]
    step = 1024
    while stack:
        p, q = stack.pop()
        same = p is q
        apart = 0.0 if same else float(distance(one.vectors[p.centre] @ other.vectors[q.centre]))
        if apart > limit + p.radius + q.radius + SLACK:
            continue
        if apart + p.radius + q.radius < limit - SLACK:
            links.all_of(p.members, q.members + offset, same)
            continue
        small = len(p.members) * len(q.members) <= 64 * 64
        left, right = (one.split(p), other.split(q)) if not small else ([], [])
        if not left and not right:
            for low in range(0, len(p.members), step):
                rows = p.members[low : low + step]
                hits = one.vectors[rows] @ other.vectors[q.members].T >= cosine
                if same:
                    hits[np.arange(len(rows)), np.arange(low, low + len(rows))] = False
                links.some_of(rows, q.members + offset, hits, not same)
            continue
        left, right = left or [p], right or [q]
        pairs = distance(one.vectors[[c.centre for c in left]] @ other.vectors[[c.centre for c in right]].T)
        reach = limit + np.array([c.radius for c in left])[:, None] + np.array([c.radius for c in right]) + SLACK
        a, b = np.nonzero(pairs <= reach)
        stack += [(left[i], right[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True) if not same or i <= j]


# ---- vectors as rows ----


def unit(vector: list | np.ndarray) -> np.ndarray | None:
    """The vector as doubles of length 1; None if it is empty, zero, or holds a null or a value that isn't finite."""
    x = np.array([math.nan if v is None else v for v in vector], np.float64)
    most = np.abs(x).max() if len(x) else 0.0
    if not (math.isfinite(most) and most > 0):
        return None
    x = x / most
    return x / math.sqrt(x @ x)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [unit(v.values.to_numpy(zero_copy_only=False) if v.values.null_count == 0 else v.as_py()) if v.is_valid else None for v in batch.column(2)]
        keys = [None if v is None or not label.is_valid else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v, label in zip(vectors, batch.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(vectors, VECTORS)], ["vec_id", "label", "key", "v"])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, key (of equal unit vectors), v; key is null where a vector can't be linked."""
    ours = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    shape = StructType([ours.schema["vec_id"], ours.schema["label"], StructField("key", BinaryType()), StructField("v", ArrayType(DoubleType()))])
    return ours.mapInArrow(_prepare, shape)


# ---- nodes above the leaves ----


def _net(fan: int):
    """Children of a node: a net at half its scale over its centre and sampled members, the centre first."""

    def net(rows: pa.Table) -> pa.Table:
        node, wanted, half = rows.column("node")[0].as_py(), rows.column("wanted")[0].as_py(), rows.column("scale")[0].as_py() / 2
        vectors = np.concatenate([matrix(rows.column("centre"))[:1], matrix(rows.column("v"))])
        chosen = [0]
        near = distance(vectors @ vectors[0])
        while len(chosen) < max(2, min(fan, wanted)) and near.max() > half:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distance(vectors @ vectors[chosen[-1]]))
        names = [f"{node}.{k}" for k in range(len(chosen))]
        return pa.table({"parent": [node] * len(chosen), "child": names, "centre": pa.array(list(vectors[chosen]), VECTORS), "scale": [half] * len(chosen)})

    return net


def _assign(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Each point with the nearest of its node's centres, and how far it is."""
    names = centres.column("child").to_pylist()
    order = np.argsort(np.array(names))
    middle = matrix(centres.column("centre"))[order]
    cosines = matrix(points.column("v")) @ middle.T if points.num_rows else np.zeros((0, len(names)))
    best = cosines.argmax(1)
    child = pa.array([names[order[k]] for k in best.tolist()], pa.string())
    apart = pa.array(distance(cosines[np.arange(len(best)), best]))
    return pa.table({"gid": points.column("gid"), "weight": points.column("weight"), "v": points.column("v"), "node": child, "apart": apart})


POINTS = "gid long, weight long, v array<double>, node string, apart double"


def blocks_of(points: DataFrame, settings: TreeSettings) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(points with their last node, all nodes, steps): nodes of more than `leaf` vectors are split level by level.

    Children's centres come from a bounded sample of the node (at most `fan` members, those with the least hashes); all
    members go to the nearest centre and radii are measured over all of them, so that bounds hold whatever was sampled.
    The scale at which a node's net is taken halves with each level, so splitting goes on however close the members are.
    Nodes hold node, centre, scale, radius, n; steps list (parent, child) of each level.
    """

    def nodes_of(points: DataFrame, centres: DataFrame) -> DataFrame:
        sizes = points.groupBy("node").agg(F.count("*").alias("n"), F.max("apart").alias("radius"))
        return sizes.join(centres, "node")

    # the whole sphere lies within 2 of anything; any member can be the first centre
    points = stored(points.withColumn("apart", F.lit(2.0)), "tree-points")
    first = points.groupBy("node").agg(F.min_by("v", "gid").alias("centre")).withColumn("scale", F.lit(2.0))
    now = stored(nodes_of(points, first), "tree-nodes")
    all_nodes, steps = now, []
    for _ in range(settings.levels):
        large = now.where(F.col("n") > settings.leaf).select("node", F.ceil(F.col("n") * 2 / settings.leaf).alias("wanted"))
        if large.isEmpty():
            break
        members = points.join(large, "node")
        order = Window.partitionBy("node").orderBy(F.xxhash64("gid"), "gid")
        sample = members.select("node", "gid", "v", "wanted").withColumn("k", F.row_number().over(order)).where(F.col("k") <= settings.fan)
        sample = sample.join(now.select("node", "centre", F.least("radius", "scale").alias("scale")), "node")
        children = stored(sample.groupBy("node").applyInArrow(_net(settings.fan), "parent string, child string, centre array<double>, scale double"), "tree-children")
        # a large node is dealt to as many groups as tasks of `leaf` vectors need, each with the node's centres
        dealt = members.withColumn("deal", F.pmod(F.xxhash64("gid"), F.col("wanted")))
        deals = large.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wanted") - 1)).alias("deal"))
        centres = children.withColumnRenamed("parent", "node").join(deals, "node")
        moved = dealt.groupBy("node", "deal").cogroup(centres.groupBy("node", "deal")).applyInArrow(_assign, POINTS)
        stay = points.join(large, "node", "left_anti").select("gid", "weight", "v", "node", "apart")
        points = stored(moved.unionByName(stay), "tree-points")
        made = points.join(children.select(F.col("child").alias("node")), "node", "left_semi")
        now = stored(nodes_of(made, children.select(F.col("child").alias("node"), "centre", "scale")), "tree-nodes")
        steps.append(children.select("parent", "child").join(now.select(F.col("node").alias("child")), "child"))
        all_nodes = all_nodes.unionByName(now)
    return points, all_nodes, steps


def node_pairs(nodes: DataFrame, roots: DataFrame, steps: list[DataFrame], cosine: float) -> DataFrame:
    """Pairs (p, q) of last nodes that may hold links, p = q included: the dual traversal of the levels above the leaves."""
    limit = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    ball = nodes.select("node", "centre", "radius")
    pairs = roots.select(F.col("node").alias("p"), F.col("node").alias("q"))

    def deeper(pairs: DataFrame, side: str, step: DataFrame) -> DataFrame:
        return pairs.join(step.select(F.col("parent").alias(side), F.col("child").alias(f"{side}_child")), side, "left")

    for step in steps:
        wide = deeper(deeper(pairs, "p", step), "q", step).select(
            (F.col("p") == F.col("q")).alias("same"), F.coalesce("p_child", "p").alias("p"), F.coalesce("q_child", "q").alias("q")
        )
        wide = wide.where(~F.col("same") | (F.col("p") <= F.col("q")))
        for side in ("p", "q"):
            wide = wide.join(ball.select(F.col("node").alias(side), F.col("centre").alias(f"{side}_centre"), F.col("radius").alias(f"{side}_radius")), side)
        cosines = F.aggregate(F.zip_with("p_centre", "q_centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosines))
        near = (F.col("p") == F.col("q")) | (apart <= limit + F.col("p_radius") + F.col("q_radius"))
        pairs = stored(wide.where(near).select("p", "q"), "tree-pairs")
    return pairs


def _leaf_pair(settings: TreeSettings):
    def link(rows: pa.Table) -> pa.Table:
        sides = rows.column("side").to_numpy()
        vectors, gid = matrix(rows.column("v")), rows.column("gid").to_numpy()
        left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides == 1)
        if not len(left) or not (len(right) or (sides == 2).any()):
            return pa.table({"u": pa.array([], pa.int64()), "w": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        order = np.concatenate([left, right])
        links = Links(rows.column("weight").to_numpy()[order])
        gid = gid[order]
        one = Tree(vectors[left], settings.fan)
        other = Tree(vectors[right], settings.fan) if len(right) else one
        dual_traversal(one, other, len(left) if len(right) else 0, links, settings.cosine)
        some = np.flatnonzero(links.n)
        edges = gid[np.concatenate(links.edges, axis=1)] if links.edges else np.zeros((2, 0), np.int64)
        edges = np.unique(np.sort(edges, axis=0), axis=1)
        edges = edges[:, edges[0] != edges[1]]
        n = np.concatenate([links.n[some], np.zeros(edges.shape[1], np.int64)])
        u, w = np.concatenate([gid[some], edges[0]]), np.concatenate([np.zeros(len(some), np.int64), edges[1]])
        return pa.table({"u": u, "w": pa.array(w, mask=np.arange(len(w)) < len(some)), "n": n})

    return link


def near_vectors(vectors: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per input row.

    vectors: vec_id (an integer type, else TypeError), embedding (an array of numbers), label (any type that groups);
    further columns are ignored. Two vectors of one label and length are linked if their cosine in double precision is at
    least settings.cosine. n_links: rows linked with it, itself not counted; component_id: the least vec_id that links
    reach (its own, without links); kept: vec_id is component_id. Null labels, null, empty and zero vectors and such with
    a null or a value that isn't finite link with nothing. Rows count one by one: equal rows are linked, and those with
    the least vec_id are all kept. Null ids are passed over for component_id, and kept only where no id is.

    Equal vectors are one point with a weight. Points of a label form a cover tree: above the leaves its levels are split
    and its node pairs pruned as tables, so nodes may be of any number and size; a leaf is dealt by hash where it can't
    be split. Each pair of leaves that the bounds leave is one task's work, on two trees of its own (see dual_traversal):
    it sends counts per vector and links that span what it linked, not the pairs.
    """
    if not isinstance(vectors.schema["vec_id"].dataType, IntegralType):
        raise TypeError("vec_id must be of an integer type")
    rows = stored(prepared(vectors), "vectors")
    alike = rows.where("key IS NOT NULL").groupBy("label", F.size("v").alias("dim"), "key")
    alike = alike.agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.any_value("v").alias("v"))
    alike = stored(alike.withColumn("gid", F.monotonically_increasing_id()), "vectors-alike")
    roots = stored(alike.select("label", "dim").distinct().withColumn("node", F.monotonically_increasing_id().cast("string")), "tree-roots")
    points, nodes, steps = blocks_of(alike.join(roots, ["label", "dim"]).select("gid", "weight", "v", "node"), settings)
    pairs = node_pairs(nodes, roots, steps, settings.cosine)

    # leaves that stayed large are dealt to parts; a pair of nodes becomes pairs of their parts
    parts = nodes.select("node", F.ceil(F.col("n") / (2 * settings.leaf)).alias("parts"))
    sides = pairs.join(parts.withColumnsRenamed({"node": "p", "parts": "p_parts"}), "p").join(parts.withColumnsRenamed({"node": "q", "parts": "q_parts"}), "q")
    numbers = [F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("p_parts", "q_parts")]
    sides = sides.withColumn("i", F.explode(numbers[0])).withColumn("j", F.explode(numbers[1])).where("p != q OR i <= j")
    sides = stored(sides.select("p", "q", "i", "j").withColumn("pair", F.monotonically_increasing_id()), "tree-leaf-pairs")
    alone = (F.col("p") == F.col("q")) & (F.col("i") == F.col("j"))
    # side 2: a part with itself
    asked = sides.select("pair", F.col("p").alias("node"), F.col("i").alias("part"), F.when(alone, 2).otherwise(0).alias("side"))
    asked = asked.unionByName(sides.where(~alone).select("pair", F.col("q").alias("node"), F.col("j").alias("part"), F.lit(1).alias("side")))
    dealt = points.join(parts, "node").select("node", F.pmod(F.xxhash64("gid"), F.col("parts")).alias("part"), "gid", "weight", "v")
    met = dealt.join(asked, ["node", "part"]).select("pair", "side", "gid", "weight", "v")
    found = stored(met.groupBy("pair").applyInArrow(_leaf_pair(settings), "u long, w long, n long"), "vectors-linked")

    links = found.where("w IS NOT NULL").select("u", F.col("w").alias("v"))
    near = found.where("w IS NULL").groupBy(F.col("u").alias("gid")).agg(F.sum("n").alias("n"))
    classes = components(links).select(F.col("node").alias("gid"), "component")
    classes = alike.select("gid", "least").join(classes, "gid")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    judged = alike.join(near, "gid", "left").join(classes.join(least, "component").select("gid", "component_id"), "gid", "left")
    judged = judged.select("label", "dim", "key", "weight", "n", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("vec_id", "label", F.size("v").alias("dim"), "key").join(judged, ["label", "dim", "key"], "left")
    return out.select(
        "vec_id",
        (F.coalesce("n", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast(LongType()).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )


NEAR_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS size
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w
  FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.v) = len(b.v)
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS far FROM embeddings
  UNION SELECT reach.node, links.w FROM reach JOIN links ON links.u = reach.far
), least AS (SELECT node, min(far) AS component_id FROM reach GROUP BY node
), counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON node = vec_id LEFT JOIN counts ON u = vec_id
"""
