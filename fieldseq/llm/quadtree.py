"""K-squared trees of small count matrices, and a joint walk over two of them.

A tree halves rows and columns at each level. Its bitmaps say which quadrants hold a
count, level by level and only below quadrants that do; the cells of the last quadrants
(leaves of 8 by 8) follow. Empty quadrants take no room.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

LEAF = 8


def build(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, depth: int) -> tuple[bytes, bytes]:
    """(bitmaps, deflated leaf cells) of a square matrix with 2^depth leaves a side; no count may be 0."""
    bits, parents = [], np.zeros((1, 2), dtype=np.int64)
    leaves = np.unique(np.stack([rows // LEAF, columns // LEAF], axis=1), axis=0)
    for level in range(depth + 1):
        held = np.unique(leaves >> (depth - level), axis=0)
        width = 1 << level
        code = held[:, 0] * width + held[:, 1]
        if not level:
            bits.append(np.array([len(held) > 0]))
            continue
        below = (parents[:, None, :] * 2 + np.array([[0, 0], [0, 1], [1, 0], [1, 1]])).reshape(-1, 2)
        bits.append(np.isin(below[:, 0] * width + below[:, 1], code))
        parents = below[bits[-1]]
    cells = np.zeros((len(parents), LEAF, LEAF), dtype=np.int64)
    if len(rows):
        code = parents[:, 0] * (1 << depth) + parents[:, 1]
        order = np.argsort(code)
        of = order[np.searchsorted(code[order], (rows // LEAF) * (1 << depth) + columns // LEAF)]
        np.add.at(cells, (of, rows % LEAF, columns % LEAF), counts)
    return np.packbits(np.concatenate(bits)).tobytes(), zlib.compress(cells.tobytes(), 1)


def read(bitmaps: bytes, cells: bytes, depth: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(quadrant grids by level, leaf number by leaf or -1, leaf cells)."""
    bits, at = np.unpackbits(np.frombuffer(bitmaps, np.uint8)).astype(bool), 1
    grids = [np.array([[bits[0]]])]
    parents = np.zeros((int(bits[0]), 2), dtype=np.int64)
    for level in range(1, depth + 1):
        below = (parents[:, None, :] * 2 + np.array([[0, 0], [0, 1], [1, 0], [1, 1]])).reshape(-1, 2)
        parents = below[bits[at:at + len(below)]]
        at += len(below)
        grid = np.zeros((1 << level, 1 << level), dtype=bool)
        grid[parents[:, 0], parents[:, 1]] = True
        grids.append(grid)
    number = np.full((1 << depth, 1 << depth), -1, dtype=np.int64)
    number[parents[:, 0], parents[:, 1]] = np.arange(len(parents))
    return grids, number, np.frombuffer(zlib.decompress(cells), np.int64).reshape(-1, LEAF, LEAF)


#: The tree of a matrix without counts.
EMPTY = (b"\0", zlib.compress(b""))


def leaf_cells(tree: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of all cells with a count."""
    _, number, cells = tree
    r, c = np.nonzero(number >= 0)
    leaf, i, j = np.nonzero(cells[number[r, c]])
    return r[leaf] * LEAF + i, c[leaf] * LEAF + j, cells[number[r, c]][leaf, i, j]


def differences(left: tuple, right: tuple, columns: int, heights: tuple[int, int],
                price: tuple[Callable, Callable], at_once: int = 2048) -> np.ndarray:
    """[row of left, row of right]: sum over `columns` columns of the absolute difference of prices.

    `price` maps (rows, counts) to prices for each side. Both trees are walked together.
    A quadrant that is empty in both has the same price in each row, so its columns are
    counted and multiplied; other leaves are compared cell by cell.
    """
    depth = len(left[0]) - 1
    side = LEAF << depth
    both_empty = np.zeros(heights, dtype=np.int64)
    a = b = c = np.zeros(1, dtype=np.int64)
    for level in range(depth + 1):
        span = side >> level
        real = np.clip(columns - c * span, 0, span)
        some = (left[0][level][a, c] | right[0][level][b, c]) & (real > 0)
        free = np.zeros([-(-h // span) for h in heights], dtype=np.int64)
        np.add.at(free, (a[~some], b[~some]), real[~some])
        both_empty += free.repeat(span, axis=0).repeat(span, axis=1)[:heights[0], :heights[1]]
        a, b, c = a[some], b[some], c[some]
        if level < depth:
            a, b, c = (np.repeat(2 * v, 8) + np.tile(step, len(v)) for v, step in (
                (a, [0, 0, 0, 0, 1, 1, 1, 1]), (b, [0, 0, 1, 1, 0, 0, 1, 1]), (c, [0, 1] * 4)))
            held = (a * (span // 2) < heights[0]) & (b * (span // 2) < heights[1])
            a, b, c = a[held], b[held], c[held]

    def prices(tree: tuple, rows: np.ndarray, cols: np.ndarray, of: Callable) -> np.ndarray:
        """Prices of the leaves (n, 8, 8), 0 beyond the last column."""
        n = tree[1][rows, cols]
        counts = np.zeros((len(rows), LEAF, LEAF), dtype=np.int64)
        counts[n >= 0] = tree[2][n[n >= 0]]
        inside = cols[:, None] * LEAF + np.arange(LEAF) < columns
        row = rows[:, None] * LEAF + np.arange(LEAF)
        return of(np.broadcast_to(row[:, :, None], counts.shape), counts) * inside[:, None, :]

    leaves = [-(-h // LEAF) for h in heights]
    blocks = np.zeros((leaves[0], LEAF, leaves[1], LEAF), dtype=np.int64)
    for i in range(0, len(a), at_once):
        ra, rb, cc = a[i:i + at_once], b[i:i + at_once], c[i:i + at_once]
        pa, pb = prices(left, ra, cc, price[0]), prices(right, rb, cc, price[1])
        apart = np.abs(pa[:, :, None, :] - pb[:, None, :, :]).sum(axis=3)
        np.add.at(blocks, (ra, slice(None), rb), apart)
    visited = blocks.reshape(leaves[0] * LEAF, leaves[1] * LEAF)[:heights[0], :heights[1]]
    empty = [of(np.arange(h), np.zeros(h, np.int64)) for of, h in zip(price, heights)]
    return visited + both_empty * np.abs(empty[0][:, None] - empty[1][None, :])
