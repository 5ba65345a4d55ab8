"""Tracks of boxes over the frames of a recording.

Boxes of a frame go on with the tracks they overlap, so a frame depends on all before it. Recordings are dealt to tasks
whole, sorted by time, and read as a stream: a task holds the boxes of one frame and the tracks that are not forgotten
yet, as arrays, however long a recording is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of a with each of b (rows: left, top, right, bottom); 0 of empty boxes."""
    side = np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2])
    inner = np.clip(side, 0, None).prod(axis=2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inner
    return np.divide(inner, union, out=np.zeros_like(inner), where=(union > 0) & (inner > 0))


class Tracks:
    """The tracks of one recording: parallel arrays in the order in which they began."""

    def __init__(self, least: float, keep: float) -> None:
        self.least, self.keep, self.made = least, keep, 0
        self.number, self.unseen, self.hits, self.box_no = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.boxes, self.center = np.zeros((0, 4)), np.zeros(0)

    def step(self, boxes: np.ndarray, box_no: np.ndarray) -> np.ndarray:
        """Takes in a frame; the place of each box's track in the arrays."""
        fit, at = overlaps(boxes, self.boxes), np.full(len(boxes), -1)
        for i in range(len(boxes) if fit.shape[1] else 0):
            t = int(fit[i].argmax())  # the older of equals
            if fit[i, t] > self.least:
                at[i], fit[:, t] = t, 0
        fresh, old = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
        at[fresh] = len(self.number) + np.arange(len(fresh))
        more, middle = np.zeros(len(fresh), dtype=np.int64), (boxes[:, 0] + boxes[:, 2]) / 2
        self.number = np.append(self.number, self.made + 1 + np.arange(len(fresh)))
        self.made += len(fresh)
        self.unseen, self.hits, self.box_no = np.append(self.unseen + 1, more), np.append(self.hits, more), np.append(self.box_no, more)
        self.boxes, self.center = np.vstack([self.boxes, boxes[fresh]]), np.append(self.center, middle[fresh])
        self.center[at[old]] = self.keep * self.center[at[old]] + (1 - self.keep) * middle[old]
        self.boxes[at], self.box_no[at], self.unseen[at] = boxes, box_no, 0
        self.hits[at] += 1
        return at

    def forget(self, after: int) -> None:
        own = self.unseen <= after
        for name in ("number", "unseen", "hits", "box_no", "boxes", "center"):
            setattr(self, name, getattr(self, name)[own])


def track_boxes(frames: DataFrame, boxes: DataFrame, least_iou: float = 0.25, keep: float = 0.3, confirm: int = 3, forget: int = 15, predict: int = 5) -> DataFrame:
    """Boxes (video_id, ts_ms, box_no, x, y, w, h) of each frame (frames: video_id, ts_ms) with their track_id and its
    smoothed center_x.

    In the order of box_no, a box goes on with the track of largest overlap above least_iou (the older of equals) that
    no box of the frame has taken yet; the track's centre becomes `keep` of its own and the rest of the box's. Other
    boxes begin tracks. A track of at least `confirm` boxes that has none in a frame gives a predicted row there, with
    its last box_no, for `predict` frames, and is forgotten after `forget` of them."""
    schema = "video_id long, ts_ms long, box_no long, track_id long, center_x double, predicted boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, tracks, frame, out = None, None, None, []

        def close() -> None:
            """The rows of the frame that has been read."""
            ts, rows = frame
            some = np.array([r[1:] for r in rows], dtype=np.float64).reshape(len(rows), 4)
            no = np.array([r[0] for r in rows], dtype=np.int64)
            at = tracks.step(some, no)
            out.extend(zip([video] * len(no), [ts] * len(no), no.tolist(), tracks.number[at].tolist(), tracks.center[at].tolist(), [False] * len(no), strict=True))
            tracks.forget(forget)
            gone = np.flatnonzero((tracks.unseen > 0) & (tracks.unseen <= predict) & (tracks.hits >= confirm))
            out.extend((video, ts, int(tracks.box_no[t]), int(tracks.number[t]), float(tracks.center[t]), True) for t in gone)

        for part in parts:
            for v, ts, no, x, y, w, h in part.itertuples(index=False):
                if frame is not None and (v, ts) != (video, frame[0]):
                    close()
                    frame = None
                if tracks is None or v != video:
                    video, tracks = v, Tracks(least_iou, keep)
                frame = frame or (ts, [])
                if not pd.isna(no):
                    frame[1].append((no, x, y, x + w, y + h))
            yield pd.DataFrame(out, columns=names)
            out.clear()
        if frame is not None:
            close()
        yield pd.DataFrame(out, columns=names)

    sides = boxes.select("video_id", "ts_ms", "box_no", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")])
    rows = frames.select("video_id", "ts_ms").distinct().join(sides, ["video_id", "ts_ms"], "left")
    ordered = rows.select("video_id", "ts_ms", "box_no", "x", "y", "w", "h").repartition("video_id").sortWithinPartitions("video_id", "ts_ms", "box_no")
    return ordered.mapInPandas(run, schema)
