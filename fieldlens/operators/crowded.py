"""Pairing and suppression of photos with thousands of boxes, in memory that grows with the boxes, not with their pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PAIRS = pa.list_(pa.struct([("pass_no", pa.int32()), ("distance", pa.float64()), ("s", pa.int32()), ("c", pa.int32())]))


JUDGED = pa.list_(pa.struct([("subject_ord", pa.int32()), ("expected", pa.int64()), ("class_ord", pa.int32()), ("class_number", pa.int64()), ("distance", pa.float64())]))


def greedy_pairs(subjects: np.ndarray, classes: np.ndarray, expected: np.ndarray, numbers: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(pass, distance, subject, class) of the greedy one-to-one pairs by pass, distance, subject and class.

    subjects and classes are columns x, y; expected and numbers have NaN for none. An edge that is the least of both its
    ends belongs to the greedy result, whatever else does. From any subject, least edges are followed until they meet, so
    each step looks at one box against those that are free.
    """
    free_s, free_c = np.ones(len(expected), bool), np.ones(len(numbers), bool)

    def least(point, mine, others, theirs, free) -> tuple[int, float, int]:
        at = np.flatnonzero(free)
        passes = np.where(theirs[at] == mine, 1, 2)
        at = at[passes == passes.min()]
        far = np.sqrt((others[0][at] - point[0]) ** 2 + (others[1][at] - point[1]) ** 2)
        return int(passes.min()), float(far.min()), int(at[np.argmin(far)])

    out, chain = [], []
    while free_s.any() and free_c.any():
        s = chain.pop() if chain else int(np.argmax(free_s))
        _, _, c = least(subjects[:, s], expected[s], classes, numbers, free_c)
        pass_no, distance, back = least(classes[:, c], numbers[c], subjects, expected, free_s)
        if back == s:
            out.append((pass_no, distance, s, c))
            free_s[s] = free_c[c] = False
        else:
            chain += [s, back]
    return out


def kept_boxes(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, near: float, overlap: float) -> list[int]:
    """The boxes, in their order, that no box kept before is near or overlaps.

    Kept boxes are found by cells as wide as any clash can reach: centres of boxes that share half their area or more are
    no farther apart than the wider of them.
    """
    cx, cy = x + w / 2, y + h / 2
    side = max(near, float(np.max(w, initial=0)), float(np.max(h, initial=0)), 1e-9)
    at = np.floor(cx / side).astype(np.int64), np.floor(cy / side).astype(np.int64)
    cells: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i in range(len(x)):
        a, b = int(at[0][i]), int(at[1][i])
        by = np.array([k for p in (a - 1, a, a + 1) for q in (b - 1, b, b + 1) for k in cells.get((p, q), ())], np.int64)
        if len(by):
            shared = np.maximum(0, np.minimum(x[by] + w[by], x[i] + w[i]) - np.maximum(x[by], x[i])) * np.maximum(0, np.minimum(y[by] + h[by], y[i] + h[i]) - np.maximum(y[by], y[i]))
            union = w[by] * h[by] + w[i] * h[i] - shared
            if (np.sqrt((cx[by] - cx[i]) ** 2 + (cy[by] - cy[i]) ** 2) <= near).any() or ((union > 0) & (shared / np.where(union > 0, union, 1) >= overlap)).any():
                continue
        kept.append(i)
        cells.setdefault((a, b), []).append(i)
    return kept


def _fields(column: pa.Array, row: int, *names: str) -> list[np.ndarray]:
    values = column.slice(row, 1).flatten()
    return [values.field(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]


def _made(batch: pa.RecordBatch, row: int) -> list[tuple[int, float, int, int]]:
    """(pass, distance, subject's ord, class box's ord) of a photo, whose boxes stand in lists s and c, in their order."""
    so, sx, sy, expected = _fields(batch.column("s"), row, "ord", "x", "y", "number")
    co, x, y, number = _fields(batch.column("c"), row, "ord", "x", "y", "number")
    return [(p, d, int(so[s]), int(co[c])) for p, d, s, c in greedy_pairs(np.stack([sx, sy]), np.stack([x, y]), expected, number)]


def paired_photos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, m): the pairs of each photo, whose boxes stand in lists s and c, in their order."""
    for batch in batches:
        for row in range(batch.num_rows):
            found = [{"pass_no": p, "distance": d, "s": s, "c": c} for p, d, s, c in _made(batch, row)]
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(row, 1), pa.array([found], PAIRS)], names=["key", "m"])


def judged_photos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, r): each photo's subject boxes with their pairs, then the class boxes left over. Boxes of equal order share a pair."""
    for batch in batches:
        for row in range(batch.num_rows):
            pairs, named = {}, {}
            for _, distance, s, c in _made(batch, row):
                pairs.setdefault(s, []).append((c, distance))
            classes = batch.column("c")[row].as_py()
            for c in classes:
                named.setdefault(c["ord"], []).append(c["number"])
            found = []
            for s in batch.column("s")[row].as_py():
                own = [(c, n, d) for c, d in pairs.get(s["ord"], ()) for n in named[c]]
                found += [(s["ord"], s["number"], c, n, d) for c, n, d in own or [(None, None, None)]]
            gone = {c for of in pairs.values() for c, _ in of}
            found += [(None, None, c["ord"], c["number"], None) for c in classes if c["ord"] not in gone]
            names = [f.name for f in JUDGED.value_type]
            told = pa.array([[dict(zip(names, r)) for r in found]], JUDGED)
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(row, 1), told], names=["key", "r"])


def suppressing(near: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batch with each list `b` cut down to the boxes that are kept."""
        for batch in batches:
            for row in range(batch.num_rows):
                boxes = batch.column("b").slice(row, 1)
                kept = kept_boxes(*_fields(batch.column("b"), row, "x", "y", "w", "h"), near, overlap)
                some = boxes.flatten().take(pa.array(kept, pa.int64()))
                lists = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(row, 1) for n in ("key", "class_number")), lists], names=["key", "class_number", "b"])

    return run
