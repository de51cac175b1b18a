"""Graph models' forward passes over query graphs, in Arrow batches; weights are given, and their size does not grow with the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def triple_convolution(x: np.ndarray, src, dst, attr: np.ndarray, message: tuple[np.ndarray, np.ndarray], out: tuple[np.ndarray, np.ndarray], eps: float = 0.0) -> np.ndarray:
    """One layer: out((1 + eps) * x + the sum of relu(message(subject, edge, object)) over the edges into each node).

    The last feature of an edge is its direction: -1 says that it runs from object to subject. It turns the order and is no input.
    message and out are (weights by input and output, bias).
    """
    src, dst = np.asarray(src, dtype=int), np.asarray(dst, dtype=int)
    back = (attr[:, -1] == -1)[:, None]
    near, far = x[dst], x[src]
    first, last = np.where(back, far, near), np.where(back, near, far)
    sent = np.maximum(np.hstack([first, attr[:, :-1], last]) @ message[0] + message[1], 0.0)
    total = (1.0 + eps) * x
    np.add.at(total, dst, sent)
    return total @ out[0] + out[1]


def scores(graphs: DataFrame, layers: list[dict], head: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(query_id, score): layers with relu between them, nodes summed, and a linear head, for each row of `features.query_graphs`.

    A layer holds the arguments message, out and eps of `triple_convolution`.
    """

    def run(batches):
        for rows in batches:
            found = []
            for nodes, src, dst, attr in zip(rows["nodes"], rows["edge_src"], rows["edge_dst"], rows["edge_attr"], strict=True):
                x, edges = np.stack(nodes), np.stack(attr)
                for layer in layers:
                    x = np.maximum(triple_convolution(x, src, dst, edges, **layer), 0.0)
                found.append(float((x.sum(axis=0) @ head[0] + head[1]).item()))
            yield rows[["query_id"]].assign(score=found)

    return graphs.select("query_id", "nodes", "edge_src", "edge_dst", "edge_attr").mapInPandas(run, "query_id long, score double")
