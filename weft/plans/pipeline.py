"""The record-linkage pipeline: pairs, training, embeddings, k-NN graph, blocking, candidates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import blocking, graph, metrics, ml, pairs
from weft.operators.knn import knn, undirected
from weft.session import durable

#: Pairs that train the network on the driver at most.
TRAIN_PAIRS = 200_000


@dataclass(frozen=True)
class Linkage:
    """What the pipeline leaves."""

    embeddings: DataFrame
    edges: DataFrame
    bridged_edges: DataFrame
    candidates: DataFrame
    recall: dict[str, DataFrame]
    network: ml.Network | None


def train_network(vectors: DataFrame, labelled: DataFrame, outputs: int = 128, epochs: int = 10, max_pairs: int = TRAIN_PAIRS, **args) -> ml.Network:
    """The siamese network of at most ``max_pairs`` pairs, those of least hash."""
    from weft.functions.scalars import hash_order

    few = labelled.orderBy(hash_order("train", F.col("a"), F.col("b")), "a", "b").limit(max_pairs)
    v = vectors.select("id", "embedding")
    rows = few.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b").select("va", "vb", "label").collect()
    x1, x2 = (np.array([r[c] for r in rows], np.float64) for c in ("va", "vb"))
    start = ml.Network.fresh(x1.shape[1], outputs=outputs)
    return ml.train(x1, x2, np.array([r["label"] for r in rows], float), start, epochs=epochs, **args)[0]


def run(records: DataFrame, network: ml.Network | None = None, k: int = 10, threshold: float = 0.5, n_bridges: int = 2, negatives: float = 1.0, embedder=None, **train_args) -> Linkage:
    """Records (id, text, cluster) to candidate pairs; with a ``network`` the training steps are skipped."""
    gold = records.select("id", "cluster")
    sentence = durable(ml.embed(records, embedder))
    if network is None:
        positive = durable(pairs.positive_pairs(gold))
        n = positive.count()
        size = int(n * negatives) if negatives > 0 else n
        labelled = pairs.trainable(positive.unionByName(pairs.negative_sample(gold, size)), sentence)
        network = train_network(sentence, labelled, **train_args)
    vectors = durable(ml.infer(sentence, network))
    edges = durable(undirected(knn(vectors, k)))
    comp = durable(graph.connected_components(edges, vectors.select("id"), "a", "b"))
    members = durable(comp.join(vectors, "id"))
    recall = {"0": metrics.component_recall(comp, edges, gold)}
    for name, metric in (("a", "centroid"), ("b", "shortest")):
        recall[name] = metrics.component_recall(blocking.merge_closest(members, metric), edges, gold)
    bridged_edges, bridged_comp = blocking.bridged(members, edges, threshold, n_bridges)
    recall["c"] = metrics.component_recall(bridged_comp, bridged_edges, gold)
    candidates = pairs.canonical_pairs(bridged_edges).orderBy("a", "b")
    return Linkage(vectors, edges, bridged_edges, candidates, recall, network)
