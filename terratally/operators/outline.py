"""Outlines of regions: their border as a linked list of row ends, ordered by pointer jumping.

A region without holes has one border. Walked with the region on the left (down its left sides, up its right sides), it visits
the two ends of every run of every row once, and where it goes from an end follows from the runs in the next row alone:

* down a left end: to the left end of the leftmost run below that it touches; but if that run touches another run to the
  left of this one, up that one's right end (a valley); without a run below, to its own right end;
* up a right end: to the right end of the rightmost run above; but if that one touches another run to the right of this
  one, down that one's left end; without a run above, to its own left end.

The outline of a region is one value of one row, so a region is one task's work; many regions share a call.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from terratally.operators.regions import by_tile
from terratally.session import ship_package


def runs_of(code: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray):
    """Pieces, sorted by (code, y, x0), joined to whole runs."""
    new = np.ones(len(y), bool)
    new[1:] = (code[1:] != code[:-1]) | (y[1:] != y[:-1]) | (x0[1:] != x1[:-1] + 1)
    first = np.flatnonzero(new)
    return code[first], y[first], x0[first], x1[np.append(first[1:], len(y)) - 1]


def walk(code: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Where the border goes from each end: nodes 0..n-1 are left ends, n..2n-1 right ends.

    Returns the next node and up to two pixels (x, y) passed on the way, -1 where there are fewer.
    """
    n = len(y)
    i = np.arange(n)
    wide, height = np.int64(right.max() + 4), np.int64(y.max() + 3)
    row = code * height + y

    def touching(step: int):
        """First and last run of the next row that touches each run (first > last: none)."""
        there = (row + step) * wide
        return np.searchsorted(row * wide + right + 1, there + left), np.searchsorted(row * wide + left, there + right + 1, side="right") - 1

    (below, below_end), (above_first, above) = touching(1), touching(-1)
    has_below, has_above = below <= below_end, above_first <= above
    c, p = np.minimum(below, n - 1), np.maximum(above, 0)
    prev, after = np.maximum(i - 1, 0), np.minimum(i + 1, n - 1)
    valley = has_below & (row[prev] == row) & (i > 0) & (right[prev] >= left[c] - 1)
    notch = has_above & (row[after] == row) & (i < n - 1) & (left[after] <= right[p] + 1)
    nxt = np.concatenate([np.where(valley, n + prev, np.where(has_below, c, n + i)), np.where(notch, after, np.where(has_above, n + p, i))])
    via = np.full((2 * n, 2, 2), -1, np.int64)

    def put(nodes, slot, x, yy):
        via[nodes, slot, 0], via[nodes, slot, 1] = x, yy

    a = np.flatnonzero(valley)
    put(a, 0, left[a] - 1, y[a] + 1)
    put(a, 1, right[prev[a]] + 1, y[a] + 1)
    a = np.flatnonzero(has_below & ~valley & (left[c] < left - 1))
    put(a, 0, left[a] - 1, y[a] + 1)
    a = np.flatnonzero(has_below & ~valley & (left[c] > left + 1))
    put(a, 0, left[c[a]] - 1, y[a])
    a = np.flatnonzero(notch)
    put(n + a, 0, right[a] + 1, y[a] - 1)
    put(n + a, 1, left[after[a]] - 1, y[a] - 1)
    a = np.flatnonzero(has_above & ~notch & (right[p] > right + 1))
    put(n + a, 0, right[a] + 1, y[a] - 1)
    a = np.flatnonzero(has_above & ~notch & (right[p] < right - 1))
    put(n + a, 0, right[p[a]] + 1, y[a])
    return nxt, via


def ranked(nxt: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Steps from each node to the end of its loop, which lies before the node where ``start`` holds."""
    jump = np.where(start[nxt], np.arange(len(nxt)), nxt)
    steps = (jump != np.arange(len(nxt))).astype(np.int64)
    while True:
        far = jump[jump]
        if (far == jump).all():
            return steps
        steps = steps + steps[jump]
        jump = far


def outlines(code: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Corner pixels of all regions: arrays code, x, y in border order from each region's first pixel."""
    n = len(y)
    nxt, via = walk(code, y, left, right)
    start = np.zeros(2 * n, bool)
    start[np.flatnonzero(np.diff(code, prepend=code[0] - 1))] = True
    both = np.concatenate([code, code])
    order = np.lexsort((-ranked(nxt, start), both))
    x = np.stack([np.concatenate([left, right]), via[:, 0, 0], via[:, 1, 0]], axis=1)[order]
    yy = np.stack([np.concatenate([y, y]), via[:, 0, 1], via[:, 1, 1]], axis=1)[order]
    there = yy.ravel() >= 0
    code, x, y = np.repeat(both[order], 3)[there], x.ravel()[there], yy.ravel()[there]

    def around(code):
        """The points before and after each, inside the loop of its region."""
        first = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
        last = np.append(first[1:], len(code)) - 1
        before, after = np.arange(len(code)) - 1, np.arange(len(code)) + 1
        before[first], after[last] = last, first
        return before, after

    before, _ = around(code)
    again = (x == x[before]) & (y == y[before]) & (np.arange(len(x)) != before)
    # the first point of a loop stays where the whole loop is one pixel
    again[np.flatnonzero(np.diff(code, prepend=code[0] - 1))] = False
    code, x, y = code[~again], x[~again], y[~again]
    before, after = around(code)
    end = (x == x[after]) & (y == y[after]) & (after < np.arange(len(x)))  # the last point is the first one again
    code, x, y = code[~end], x[~end], y[~end]
    before, after = around(code)
    turn = (np.sign(x - x[before]) != np.sign(x[after] - x)) | (np.sign(y - y[before]) != np.sign(y[after] - y)) | (before == np.arange(len(x)))
    return code[turn], x[turn], y[turn]


OUT = "image_id bigint, mask string, comp_id bigint, outline array<struct<x: double, y: double>>"


def trace(pdf: pd.DataFrame) -> pd.DataFrame:
    code = pdf.groupby(["image_id", "mask", "lab"], sort=False).ngroup().to_numpy()
    order = np.lexsort((pdf["x0"], pdf["y"], code))
    pdf, code = pdf.iloc[order], code[order]
    y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    codes, x, y = outlines(*runs_of(code, y, x0, x1))
    cuts = np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(codes))
    at = np.flatnonzero(np.diff(code, prepend=-1))
    x, y = x.astype(float).tolist(), y.astype(float).tolist()
    return pd.DataFrame({
        "image_id": pdf["image_id"].to_numpy()[at], "mask": pdf["mask"].to_numpy()[at], "comp_id": pdf["lab"].to_numpy()[at],
        "outline": [[{"x": u, "y": v} for u, v in zip(x[a:b], y[a:b])] for a, b in zip(cuts[:-1], cuts[1:])]})


def region_outline(labelled: DataFrame) -> DataFrame:
    """Corner pixels of each region's border, from its first pixel on, down its left side first.

    Straight stretches, along rows, columns and diagonals, are left out. Regions must have no holes.
    """
    ship_package(labelled.sparkSession)
    df = labelled.select("image_id", "mask", "lab", "y", "x0", "x1")
    return by_tile(df, ["image_id", "mask", "lab"], trace, OUT)
