"""Hierarchical clustering of one group's distances and the tables of its tree.

Clustering needs all distances of a group at once, which is a matrix of the square of its members: groups
are genomes or samples, hundreds at most. Many groups are clustered side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("single", "complete", "average", "weighted", "centroid", "median", "ward")


def linkage(d: np.ndarray, method: str = "complete") -> np.ndarray:
    """Merges as rows (left id, right id, height, size) from a square distance matrix, by the Lance-Williams update.

    Of equal distances the pair with the smaller ids merges first; the smaller id is left.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    n = len(d)
    d = np.array(d, float)
    squared = method in ("centroid", "median", "ward")
    if squared:
        d = d**2
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        low = d.min()
        at = np.argwhere(d == low)
        i, j = min(((a, b) for a, b in at if a != b), key=lambda p: tuple(sorted((ids[p[0]], ids[p[1]]))))
        if ids[i] > ids[j]:
            i, j = j, i
        a, b, h = size[i], size[j], d[i, j]
        out.append((ids[i], ids[j], float(np.sqrt(max(h, 0)) if squared else h), a + b))
        x, y, c = d[i], d[j], np.array(size)
        if method == "single":
            new = np.minimum(x, y)
        elif method == "complete":
            new = np.maximum(x, y)
        elif method == "average":
            new = (a * x + b * y) / (a + b)
        elif method == "weighted":
            new = (x + y) / 2
        elif method == "centroid":
            new = (a * x + b * y) / (a + b) - a * b * h / (a + b) ** 2
        elif method == "median":
            new = (x + y) / 2 - h / 4
        else:
            new = ((a + c) * x + (b + c) * y - c * h) / (a + b + c)
        keep = [k for k in range(len(ids)) if k != j]
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d = d[np.ix_(keep, keep)]
        size[i], ids[i] = a + b, n + step
        size, ids = [size[k] for k in keep], [ids[k] for k in keep]
    return np.array(out).reshape(-1, 4)


def tree(merges: np.ndarray, n: int, distance_sort: bool | str = False, count_sort: bool | str = False) -> pd.DataFrame:
    """One row a node: node_id, left_id, right_id, parent_id, x, y, is_leaf, pre_pos, in_pos, post_pos, leaf_pos.

    Leaves stand at 0, 1, ... from left to right at height 0; a parent stands midway between its children. ``count_sort``
    puts the child with fewer leaves to the left (``descending``: to the right), ``distance_sort`` the child whose own children are nearer;
    only one of them may be asked for.
    """
    if distance_sort and count_sort:
        raise ValueError("distance_sort and count_sort exclude each other")
    left = {n + i: int(m[0]) for i, m in enumerate(merges)}
    right = {n + i: int(m[1]) for i, m in enumerate(merges)}
    y = {n + i: float(m[2]) for i, m in enumerate(merges)}
    if distance_sort or count_sort:
        leaves = {n + i: float(m[3]) for i, m in enumerate(merges)}
        weight = (lambda v: leaves.get(v, 1.0)) if count_sort else (lambda v: y.get(v, 0.0))
        down = "descending" in (distance_sort, count_sort)
        for v in left:
            a, b = weight(left[v]), weight(right[v])
            if (a < b) if down else (a > b):
                left[v], right[v] = right[v], left[v]
    parent = {c: p for side in (left, right) for p, c in side.items()}
    root = n + len(merges) - 1 if len(merges) else 0
    pre, ino, post, leaf, x = {}, {}, {}, {}, {}
    todo = [(root, 0)]
    while todo:
        v, stage = todo.pop()
        if stage == 0:
            pre[v] = len(pre)
            if v < n:
                leaf[v] = len(leaf)
                x[v], ino[v], post[v] = float(leaf[v]), len(ino), len(post)
            else:
                todo += [(v, 2), (right[v], 0), (v, 1), (left[v], 0)]
        elif stage == 1:
            ino[v] = len(ino)
        else:
            post[v] = len(post)
            x[v] = (x[left[v]] + x[right[v]]) / 2
    rows = [(v, left.get(v), right.get(v), parent.get(v), x[v], y.get(v, 0.0), v < n, pre[v], ino[v], post[v], leaf.get(v)) for v in sorted(pre)]
    return pd.DataFrame(rows, columns=["node_id", "left_id", "right_id", "parent_id", "x", "y", "is_leaf", "pre_pos", "in_pos", "post_pos", "leaf_pos"]).astype({c: "Int64" for c in ("left_id", "right_id", "parent_id", "leaf_pos")})


NODES = "node_id bigint, left_id bigint, right_id bigint, parent_id bigint, x double, y double, is_leaf boolean, pre_pos bigint, in_pos bigint, post_pos bigint, leaf_pos bigint, label string"


def dendrograms(pairs: DataFrame, members: DataFrame, group: str, method: str = "complete", default: float = 1.0, most: int = 5000) -> DataFrame:
    """(group, node columns, label) for every group of members (group, label) with pairs (group, a, b, distance).

    Pairs that are not listed are ``default`` apart. Members are numbered by label. A group of more than ``most`` members is an
    error, as its matrix would not fit a task.
    """

    def run(key: tuple, m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if len(m) > most:
            raise ValueError(f"group {key[0]} has {len(m)} members, more than {most}")
        labels = sorted(m["label"])
        at = {v: i for i, v in enumerate(labels)}
        d = np.full((len(labels), len(labels)), default)
        np.fill_diagonal(d, 0)
        for a, b, v in zip(p["a"], p["b"], p["distance"], strict=True):
            d[at[a], at[b]] = d[at[b], at[a]] = v
        t = tree(linkage(d, method), len(labels))
        t["label"] = [labels[v] if v < len(labels) else None for v in t["node_id"]]
        t.insert(0, "grp", key[0])
        return t

    out = members.select(F.col(group).cast("string").alias("grp"), F.col("label").cast("string").alias("label")).groupBy("grp").cogroup(
        pairs.select(F.col(group).cast("string").alias("grp"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "distance").groupBy("grp")
    )
    return out.applyInPandas(run, f"grp string, {NODES}").withColumnRenamed("grp", group)


def distances(z: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Square distances between the rows of z; ``precomputed`` takes z as they are. Jaccard compares whether values are zero."""
    if metric == "precomputed":
        return np.array(z, float)
    z = np.array(z, float)
    if metric == "jaccard":
        b = z != 0
        both = b.astype(float) @ b.T.astype(float)
        either = b.sum(1)[:, None] + b.sum(1)[None] - both
        return np.where(either > 0, 1 - both / np.maximum(either, 1), 0.0)
    if metric in ("euclidean", "sqeuclidean"):
        out = np.maximum(((z[:, None] - z[None]) ** 2).sum(-1), 0)
        return np.sqrt(out) if metric == "euclidean" else out
    if metric == "cityblock":
        return np.abs(z[:, None] - z[None]).sum(-1)
    if metric == "cosine":
        norm = np.linalg.norm(z, axis=1)
        return 1 - (z @ z.T) / np.where(np.outer(norm, norm) > 0, np.outer(norm, norm), 1)
    raise ValueError(f"unknown metric {metric}")


@dataclass
class Linked:
    """labels and order of the leaves from left to right, the matrix in that order, the tree, the height of its root, the merges."""

    labels: list
    order: list[int]
    mat: np.ndarray
    tree: pd.DataFrame
    root_distance: float
    linkage: np.ndarray


def hierarchical_cluster(z: np.ndarray, labels: list | None = None, method: str = "ward", metric: str = "euclidean", distance_sort: bool | str = False, count_sort: bool | str = False, sort_order: list[float] | None = None) -> Linked:
    """The tree of one matrix on the driver, for figures; ``sort_order`` (a position for each row) turns children so that the smaller mean is left.

    Positions and heights of the tree are scaled to 0 to 1. With ``sort_order`` the returned order stays that of the clustering.
    """
    z = np.asarray(z, float)
    names = list(range(len(z))) if labels is None else list(labels)
    merges = linkage(distances(z, metric), method)
    t = tree(merges, len(z), distance_sort, count_sort)
    order = [int(v) for v in t[t.is_leaf].sort_values("leaf_pos").node_id]
    mat = z[order][:, order] if metric == "precomputed" else z[order]
    at = {v: float(x) for v, x in zip(t.node_id, t.x, strict=True) if v < len(z)} if sort_order is None else dict(enumerate(map(float, sort_order)))
    return Linked([names[i] for i in order], order, mat, sorted_by(t, at), float(merges[-1][2]) if len(merges) else 0.0, merges)


def deduplicate(z: np.ndarray, labels: list) -> tuple[np.ndarray, list[str], list[list]]:
    """Rows that differ, in order of their first; a label for each (first label, and how many more) and all labels of its rows."""
    groups: dict[bytes, list[int]] = {}
    for i, row in enumerate(np.ascontiguousarray(z)):
        groups.setdefault(row.tobytes(), []).append(i)
    first = [g[0] for g in groups.values()]
    return np.asarray(z)[first], [f"{labels[g[0]]}+{len(g) - 1}" if len(g) > 1 else str(labels[g[0]]) for g in groups.values()], [[labels[i] for i in g] for g in groups.values()]


def sorted_by(nodes: pd.DataFrame, position: dict[int, float]) -> pd.DataFrame:
    """A tree whose nodes stand at the mean position of their leaves, the smaller child to the left; x is scaled to 0 to 1, y too."""
    t = nodes.set_index("node_id")
    below: dict[int, list[float]] = {}
    for v in t.sort_values("post_pos").index:
        row = t.loc[v]
        below[v] = [position[v]] if row["is_leaf"] else below[int(row["left_id"])] + below[int(row["right_id"])]
        t.loc[v, "x"] = float(np.mean(below[v]))
    swap = [v for v in t.index if not t.loc[v, "is_leaf"] and t.loc[int(t.loc[v, "left_id"]), "x"] > t.loc[int(t.loc[v, "right_id"]), "x"]]
    t.loc[swap, ["left_id", "right_id"]] = t.loc[swap, ["right_id", "left_id"]].to_numpy()
    for c in "xy":
        span = t[c].max() - t[c].min()
        t[c] = (t[c] - t[c].min()) / span if span else 0.0
    return t.reset_index()
