"""Sequential kernels over edges that one task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def kruskal(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the forest's edges in the total order (w, u, v)."""
    ids, inv = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = inv[: len(u)].tolist(), inv[len(u) :].tolist()
    root = list(range(len(ids)))
    keep = []
    for k in np.lexsort((v, u, w)).tolist():
        x, y = a[k], b[k]
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, dtype=np.int64)


def local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of a partition's edges: batch after batch joins the forest so far, which bounds memory by nodes."""
    held: list[pd.DataFrame] = []
    size, least = 0, 200_000
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= least:
            held = [forest_of(pd.concat(held))]
            size, least = 0, max(200_000, len(held[0]))
    if held:
        yield forest_of(pd.concat(held))


def forest_of(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[kruskal(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["w"].to_numpy())]


def component_labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, component) of all ends of edges (u, v)."""
    held = list(batches)
    if not held:
        return
    pdf = pd.concat(held)
    ids, inv = np.unique(np.concatenate((pdf["u"], pdf["v"])), return_inverse=True)
    a, b = inv[: len(pdf)], inv[len(pdf) :]
    label = np.arange(len(ids))
    while True:  # both ends take the smaller label, then labels' labels
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    yield pd.DataFrame({"id": ids, "component": ids[label]})
