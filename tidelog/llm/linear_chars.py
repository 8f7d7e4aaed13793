"""Linear scores over hashed character n-grams of whole texts."""

from __future__ import annotations

import numpy as np

from .textvec import folded, gram_index, pieces


def gram_sums(texts: list[str | None], tables: list[np.ndarray], orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Mean weight of a text's n-grams under each table, (text, table)."""
    out = np.zeros((len(texts), len(tables)))
    count = np.zeros(len(texts))
    for who, part, own in pieces(texts, overlap=max(orders)):
        cp, at = folded(part)
        n = np.array(own, dtype=np.int64) + 2
        for k in orders:
            index = gram_index(cp, k, bits)
            end = np.minimum(at[:-1] + n, at[1:] - k + 1)  # grams that begin in the own part
            end = np.maximum(np.minimum(end, len(index)), at[:-1].clip(max=len(index)))
            start = at[:-1].clip(max=len(index))
            np.add.at(count, who, (end - start).astype(float))
            for c, w in enumerate(tables):
                sums = np.zeros(len(index) + 1)
                np.cumsum(w[index], out=sums[1:])
                np.add.at(out[:, c], who, sums[end] - sums[start])
    return out / np.maximum(count, 1)[:, None]


def gram_rows(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same features as sparse rows: (columns, mean counts, where rows begin)."""
    columns, values, at = [], [], [0]
    for t in texts:
        cp, _ = folded([t])
        index = np.concatenate([gram_index(cp, k, bits) for k in orders])
        u, n = np.unique(index, return_counts=True)
        columns.append(u.astype(np.int32))
        values.append((n / max(1, len(index))).astype(np.float32))
        at.append(at[-1] + len(u))
    return np.concatenate(columns), np.concatenate(values), np.array(at, dtype=np.int64)
