"""Causal 2D filter and identity tracking: order-dependent recurrences per camera.

One small numpy step per frame (vectorised over joints) serves both forms: the batch form scans
sorted rows as a stream with constant memory, the Structured Streaming form keeps the same state in
the state store. State resets where the person changes, so the batch form also splits there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.skeleton import SIDE_PAIRS
from ..operators.blocks import carry, index_block, with_halo
from ..session import materialise

FRAME = "session_id int, camera_id string, sample_idx bigint, person_id int, xs array<double>, ys array<double>, scores array<double>, valid array<boolean>"
STATE = "frame bigint, person int, xy array<double>, velocity array<double>, scores array<double>, valid array<boolean>, pending binary"


@dataclass(frozen=True)
class FilterSettings:
    stationary_alpha: float = 0.22
    motion_alpha: float = 0.88
    motion_scale: float = 0.08
    max_jump: float = 0.55
    swap_ratio: float = 0.65
    repair_sides: bool = False
    velocity_alpha: float = 0.35
    minimum_scale: float = 48.0


def _extent(xy: np.ndarray, valid: np.ndarray) -> float:
    body = xy[:17][valid[:17] & np.isfinite(xy[:17]).all(axis=1)]
    return float(np.linalg.norm(np.ptp(body, axis=0))) if len(body) >= 2 else 0.0


def _repair_sides(xy, scores, valid, predicted, known, scale, ratio) -> None:
    """Exchange left and right where the swapped assignment fits the prediction clearly better."""
    for pair in SIDE_PAIRS:
        a, b = list(pair), list(pair[::-1])
        if max(a) >= len(xy) or not (valid[a].all() and known[a].all()):
            continue
        direct = np.linalg.norm(xy[a] - predicted[a], axis=1).sum()
        swapped = np.linalg.norm(xy[b] - predicted[a], axis=1).sum()
        if direct >= 0.12 * scale and swapped < ratio * direct:
            for values in (xy, scores, valid):
                values[a] = values[b]


def filter_step(state: dict | None, frame: int, person: int, xy, scores, valid, cfg: FilterSettings) -> dict:
    """Next state; its xy/scores/valid are the filtered frame."""
    xy, scores, valid = np.array(xy, float), np.array(scores, float), np.array(valid, bool)
    scored = np.isfinite(scores)
    scores = np.where(scored, np.clip(np.nan_to_num(scores), 0.0, 1.0), 0.0)
    valid &= np.isfinite(xy).all(axis=1) & scored
    if state is None or person != state["person"] or frame <= state["frame"]:
        return {"frame": frame, "person": person, "xy": xy, "velocity": np.zeros_like(xy), "scores": scores, "valid": valid}
    dt = max(frame - state["frame"], 1)
    predicted = state["xy"] + state["velocity"] * dt
    known = state["valid"]
    scale = max(_extent(xy, valid), _extent(state["xy"], known), cfg.minimum_scale)
    if cfg.repair_sides:
        _repair_sides(xy, scores, valid, predicted, known, scale, cfg.swap_ratio)
    usable = valid & known & np.isfinite(predicted).all(axis=1)
    residual = np.where(usable[:, None], xy - predicted, 0.0)
    motion = np.linalg.norm(residual, axis=1) / scale
    jump = usable & (motion / dt > cfg.max_jump) & (scores < 0.75)
    alpha = cfg.stationary_alpha + (cfg.motion_alpha - cfg.stationary_alpha) * np.minimum(motion / cfg.motion_scale, 1.0)
    alpha = np.clip(alpha * (0.55 + 0.45 * scores), 0.5 * cfg.stationary_alpha, 1.0)
    follow = usable & ~jump
    hold = jump | (~valid & known)
    lost = ~valid & ~known
    out = np.where(follow[:, None], predicted + alpha[:, None] * residual, np.where(hold[:, None], predicted, xy))
    out[lost] = np.nan
    measured = (out - state["xy"]) / dt
    velocity = np.where(follow[:, None], (1.0 - cfg.velocity_alpha) * state["velocity"] + cfg.velocity_alpha * measured, 0.0)
    velocity = np.where(hold[:, None], state["velocity"], velocity)
    keep = valid & ~jump
    return {"frame": frame, "person": person, "xy": out, "velocity": velocity, "scores": np.where(keep, scores, 0.0), "valid": keep}


def _frame_arrays(row) -> tuple:
    to = lambda v: np.array([np.nan if x is None else x for x in v], float)
    return np.stack([to(row.xs), to(row.ys)], axis=1), to(row.scores), np.array([bool(v) for v in row.valid])


def _output(row, state: dict) -> tuple:
    return (
        row.session_id, row.camera_id, row.sample_idx, row.person_id, _nullable(state["xy"][:, 0]), _nullable(state["xy"][:, 1]),
        state["scores"].tolist(), state["valid"].tolist(),
    )


def _nullable(values: np.ndarray) -> list:
    return [None if not np.isfinite(v) else float(v) for v in values]


_COLUMNS = ["session_id", "camera_id", "sample_idx", "person_id", "xs", "ys", "scores", "valid"]


def causal_filter(frames: DataFrame, cfg: FilterSettings = FilterSettings()) -> DataFrame:
    """Batch form over frames with a dense ``sample_idx`` per (session, camera)."""
    keys = ["session_id", "camera_id"]
    marked = with_halo(frames, keys, "sample_idx", 1, 0, lambda w: {"__new": ~F.col("person_id").eqNullSafe(F.lag("person_id").over(w))})
    opened = F.when(F.col("__new"), F.col("sample_idx"))
    parts = carry(marked, keys, ["sample_idx"], index_block("sample_idx"), last={"__part": opened})
    ordered = parts.select(*_COLUMNS, "__part").repartition(*keys, "__part").sortWithinPartitions(*keys, "__part", "sample_idx")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            rows = []
            for row in pdf.rename(columns={"__part": "part"}).itertuples(index=False):
                here = (row.session_id, row.camera_id, row.part)
                state = filter_step(state if here == key else None, row.sample_idx, row.person_id, *_frame_arrays(row), cfg)
                key = here
                rows.append(_output(row, state))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return ordered.mapInPandas(scan, FRAME)


def event_time(frame, fps: float):
    """Frames as event times; the first lies after the watermark that a stream starts with."""
    return F.timestamp_micros(((F.col(frame) + 1) * (1_000_000.0 / fps)).cast("long"))


def _packed(pdf: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(pdf, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def causal_filter_stream(frames: DataFrame, cfg: FilterSettings = FilterSettings(), delay: str = "1 second", fps: float = 30.0, expire_after: float = 3600.0) -> DataFrame:
    """Streaming form: the state of each (session, camera) lives in the state store between micro-batches.

    Frames wait in the state until the watermark, `delay` behind the newest frame, has passed them and are then applied in
    order, so the result depends on neither micro-batches nor the order of arrival; a frame later than `delay` is dropped.
    The wait list holds `delay` of frames. A camera without frames for `expire_after` seconds of event time is forgotten.
    """

    def update(key, batches, handle):
        state, waiting = None, []
        if handle.exists:
            frame, person, xy, velocity, scores, valid, pending = handle.get
            if frame is not None:
                to = lambda v: np.array([np.nan if x is None else x for x in v], float).reshape(-1, 2)
                state = {"frame": frame, "person": person, "xy": to(xy), "velocity": to(velocity), "scores": np.array(scores, float), "valid": np.array(valid, bool)}
            if pending is not None:
                waiting.append(pa.ipc.open_stream(bytes(pending)).read_pandas())
        if handle.hasTimedOut and not waiting:
            handle.remove()
            return
        waiting.extend(b[_COLUMNS] for b in batches)
        pdf = pd.concat(waiting, ignore_index=True).sort_values("sample_idx", kind="stable")
        at = lambda frame: ((frame + 1) * (1000.0 / fps)).astype("int64")
        due = at(pdf["sample_idx"]) <= handle.getCurrentWatermarkMs()
        rows = []
        for row in pdf[due].itertuples(index=False):
            state = filter_step(state, row.sample_idx, row.person_id, *_frame_arrays(row), cfg)
            rows.append(_output(row, state))
        late = pdf[~due]
        pending = _packed(late) if len(late) else None
        if state is None:
            handle.update((None, None, None, None, None, None, pending))
        else:
            handle.update((int(state["frame"]), int(state["person"]), _nullable(state["xy"].ravel()), _nullable(state["velocity"].ravel()), state["scores"].tolist(), state["valid"].tolist(), pending))
        wake = int(at(late["sample_idx"]).min()) if len(late) else int((state["frame"] + 1) * (1000.0 / fps) + expire_after * 1000.0)
        handle.setTimeoutTimestamp(max(wake, handle.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    timed = frames.withColumn("event_time", event_time("sample_idx", fps)).withWatermark("event_time", delay)
    return timed.groupBy("session_id", "camera_id").applyInPandasWithState(update, FRAME, STATE, "append", GroupStateTimeout.EventTimeTimeout)


REORDERED = FRAME + ", late boolean"
BUFFER = STATE + ", newest bigint"


def causal_filter_reordered(frames: DataFrame, cfg: FilterSettings = FilterSettings(), delay_frames: int = 30) -> DataFrame:
    """Streaming form with a reorder buffer of bounded length and the late frames beside the result.

    A camera's frame waits until one at least `delay_frames` newer has come and is then applied in order. The state is the filter's own and
    `delay_frames` of frames, however long the recording is. A frame that comes when its turn has passed is not applied; it leaves
    unfiltered as a row with `late` true, so nothing vanishes. As long as no frame is more than `delay_frames` behind, the result is that of
    the batch form, whatever the micro-batches. A frame without joints (empty arrays) ends a camera's recording: what still waits is applied and
    the camera forgotten.
    """

    def update(key, batches, handle):
        state, waiting, newest = None, [], -1
        if handle.exists:
            frame, person, xy, velocity, scores, valid, pending, newest = handle.get
            if frame is not None:
                to = lambda v: np.array([np.nan if x is None else x for x in v], float).reshape(-1, 2)
                state = {"frame": frame, "person": person, "xy": to(xy), "velocity": to(velocity), "scores": np.array(scores, float), "valid": np.array(valid, bool)}
            if pending is not None:
                waiting.append(pa.ipc.open_stream(bytes(pending)).read_pandas())
        passed = newest - delay_frames
        came = [b[_COLUMNS] for b in batches]
        rows = []
        for b in came:
            late = b[b["sample_idx"] <= passed] if handle.exists else b.head(0)
            rows += [(*(r[c] for c in _COLUMNS), True) for r in late.to_dict("records")]
            waiting.append(b.drop(late.index))
            newest = max(newest, int(b["sample_idx"].max()))
        pdf = pd.concat(waiting, ignore_index=True).sort_values("sample_idx", kind="stable") if waiting else pd.DataFrame(columns=_COLUMNS)
        ended = bool((pdf["xs"].str.len() == 0).any())
        due = (pdf["sample_idx"] <= newest - delay_frames) | ended
        for row in pdf[due].itertuples(index=False):
            if len(row.xs):
                state = filter_step(state, row.sample_idx, row.person_id, *_frame_arrays(row), cfg)
                rows.append((*_output(row, state), False))
        left = pdf[~due]
        if ended:
            if handle.exists:
                handle.remove()
        else:
            pending = _packed(left) if len(left) else None
            own = (None,) * 6 if state is None else (int(state["frame"]), int(state["person"]), _nullable(state["xy"].ravel()), _nullable(state["velocity"].ravel()), state["scores"].tolist(), state["valid"].tolist())
            handle.update((*own, pending, newest))
        if rows:
            yield pd.DataFrame(rows, columns=[*_COLUMNS, "late"])

    return frames.groupBy("session_id", "camera_id").applyInPandasWithState(update, REORDERED, BUFFER, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- identity and boxes


@dataclass(frozen=True)
class TrackSettings:
    target_confidence: float = 0.65
    padding: float = 0.18
    stationary_alpha: float = 0.35
    motion_scale: float = 0.12
    lost_buffer: int = 30
    reacquire_after: int = 12
    image: tuple[int, int] = (1280, 720)


# Fixed values of the box recurrences: least sides in pixels; reach of one frame's centre step in diagonals of the held box;
# least and greatest growth of a frame, for three frames at most; what a frame keeps of the old centre, and of the old
# size when it grows or shrinks; the weight of the area in a detection's score.
LEAST_SIDE, LEAST_TRACKED_SIDE = 2.0, 32.0
REACH = 0.30
GROWTH, GROWTH_FRAMES = (0.75, 1.35), 3
KEPT_CENTER, KEPT_GROWING, KEPT_SHRINKING = 0.65, 0.75, 0.92
AREA_WEIGHT = 0.08

#: Boxes as rows (x0, y0, x1, y1) times TO_CENTER are rows (centre, size); TO_CORNERS leads back.
TO_CENTER = np.array([[0.5, 0.0, -1.0, 0.0], [0.0, 0.5, 0.0, -1.0], [0.5, 0.0, 1.0, 0.0], [0.0, 0.5, 0.0, 1.0]])
TO_CORNERS = np.array([[1.0, 0.0, 1.0, 0.0], [0.0, 1.0, 0.0, 1.0], [-0.5, 0.0, 0.5, 0.0], [0.0, -0.5, 0.0, 0.5]])
CORNERS = ["x0", "y0", "x1", "y1"]


def _centred(boxes: np.ndarray, least: float) -> np.ndarray:
    return np.maximum(boxes @ TO_CENTER, [-np.inf, -np.inf, least, least])


def _diagonal(centred: np.ndarray) -> np.ndarray:
    return np.hypot(centred[:, 2], centred[:, 3])


def _inside(boxes: np.ndarray, image: tuple[int, int]) -> np.ndarray:
    return np.clip(boxes, 0.0, np.tile(np.maximum(np.array(image, float) - 1.0, 0.0), 2))


def padded(boxes: np.ndarray, padding: float, image: tuple[int, int]) -> np.ndarray:
    wide = 1.0 + 2.0 * padding
    return _inside((_centred(boxes, LEAST_SIDE) * [1.0, 1.0, wide, wide]) @ TO_CORNERS, image)


def steadied(seen: np.ndarray, held: np.ndarray, still: float, motion_scale: float) -> np.ndarray:
    """Held boxes drawn to the seen ones, with weight `still` at rest and 1 from `motion_scale` of movement and growth on."""
    new, old = _centred(seen, LEAST_SIDE), _centred(held, LEAST_SIDE)
    change = new - old
    moved = np.hypot(change[:, 0], change[:, 1]) / np.maximum(_diagonal(old), LEAST_SIDE)
    grown = np.abs(np.log(new[:, 2:] / old[:, 2:])).max(axis=1)
    weight = np.interp((moved + grown) / motion_scale, [0.0, 1.0], [still, 1.0])
    return (old + weight[:, None] * change) @ TO_CORNERS


def followed(held: np.ndarray, seen: np.ndarray, gap: np.ndarray, image: tuple[int, int]) -> np.ndarray:
    """Tracked boxes `gap` frames after `held`: part of the way to `seen`, with bounded steps and growth."""
    old, new = _centred(held, LEAST_TRACKED_SIDE), _centred(seen, LEAST_TRACKED_SIDE)
    gap = np.maximum(gap, 1)[:, None].astype(float)
    way = new - old
    length = np.hypot(way[:, :1], way[:, 1:2])
    step = way[:, :2] * np.minimum(1.0, REACH * _diagonal(old)[:, None] * gap / np.maximum(length, 1e-300))
    low, high = (old[:, 2:] * g ** np.minimum(gap, GROWTH_FRAMES) for g in GROWTH)
    change = np.clip(new[:, 2:], low, high) - old[:, 2:]
    kept = np.where(change >= 0.0, KEPT_GROWING, KEPT_SHRINKING) ** gap
    out = old + np.hstack([(1.0 - KEPT_CENTER**gap) * step, (1.0 - kept) * change])
    return _inside(out @ TO_CORNERS, image)


def best_detections(dets: np.ndarray, usable: np.ndarray, minimum: float) -> np.ndarray:
    """Position of each frame's best detection (confidence, and a little for area), -1 where none is sure enough."""
    sure = usable & (dets[:, :, 4] >= minimum)
    area = np.where(sure, np.prod(np.maximum(dets[:, :, 2:4] - dets[:, :, :2], 0.0), axis=2), 0.0)
    score = dets[:, :, 4] + AREA_WEIGHT * np.sqrt(area / np.maximum(area.max(axis=1, keepdims=True), 1.0))
    return np.where(sure.any(axis=1), np.where(sure, score, -np.inf).argmax(axis=1), -1)


class Tracks:
    """The tracked person of many series at once: id (-1: none yet), box, confidence and frames missed, a row per series."""

    def __init__(self, cfg: TrackSettings):
        self.cfg, self.id, self.missed = cfg, np.zeros(0, int), np.zeros(0, int)
        self.box, self.conf = np.zeros((0, 4)), np.zeros(0)

    def grow(self, n: int) -> None:
        more = max(n - len(self.id), 0)
        self.id, self.missed = np.append(self.id, np.full(more, -1)), np.append(self.missed, np.zeros(more, int))
        self.box, self.conf = np.vstack([self.box, np.zeros((more, 4))]), np.append(self.conf, np.zeros(more))

    def usable(self, dets: np.ndarray) -> np.ndarray:
        return np.isfinite(dets).all(axis=2) & (dets[:, :, 5] >= 0) & (dets[:, :, 2] > dets[:, :, 0]) & (dets[:, :, 3] > dets[:, :, 1])

    def step(self, at: np.ndarray, dets: np.ndarray, usable: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One frame of the series `at`, with their detections (n, k, 6); which of them have a result, and a detected one.

        The tracked id is kept where it is seen, after `reacquire_after` missed frames the best detection replaces it, and
        until `lost_buffer` missed frames the last box stands.
        """
        cfg, known = self.cfg, self.id[at] >= 0
        same = usable & (dets[:, :, 5] == self.id[at][:, None])
        seen = known & same.any(axis=1)
        self.missed[at] += known & ~seen
        free = ~known | (~seen & (self.missed[at] >= cfg.reacquire_after))
        chosen = np.where(seen, same.argmax(axis=1), np.where(free, best, -1))
        hit = chosen >= 0
        slots, found = at[hit], dets[hit, chosen[hit]]
        box = padded(found[:, :4], cfg.padding, cfg.image)
        stays = self.id[slots] == found[:, 5]
        box[stays] = steadied(box[stays], self.box[slots[stays]], cfg.stationary_alpha, cfg.motion_scale)
        self.box[slots], self.conf[slots], self.id[slots], self.missed[slots] = box, found[:, 4], found[:, 5].astype(int), 0
        return hit | (known & (self.missed[at] <= cfg.lost_buffer)), hit


TRACK = "session_id int, camera_id string, sample_idx bigint, track_id int, confidence double, detected boolean, x0 double, y0 double, x1 double, y1 double"
#: Frames in a slice of a series. Tracks forget: two that start apart are bit for bit the same after some hundred frames.
SLICE_FRAMES = 4096


class Boxes:
    """The followed box of many series at once, a row (x0, y0, x1, y1, frame) for each."""

    width = 5

    def __init__(self, image: tuple[int, int]):
        self.image, self.state = image, np.zeros((0, 5))

    def grow(self, n: int) -> None:
        self.state = np.vstack([self.state, np.full((max(n - len(self.state), 0), 5), np.nan)])

    def read(self, pdf: pd.DataFrame) -> None:
        self.seen, self.frame = pdf[CORNERS].to_numpy(float), pdf["sample_idx"].to_numpy(float)

    def step(self, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held, seen = self.state[at], self.seen[rows]
        fresh = np.isnan(held[:, 0])
        gap = np.where(fresh, 1.0, self.frame[rows] - np.where(fresh, 0.0, held[:, 4]))
        self.state[at, :4] = np.where(fresh[:, None], seen, followed(np.where(fresh[:, None], seen, held[:, :4]), seen, gap.astype(int), self.image))
        self.state[at, 4] = self.frame[rows]
        return np.ones(len(at), bool), np.ones(len(at), bool)


class Identities(Tracks):
    """Tracks whose state is one row (id, frames missed, confidence, box) for each series."""

    width = 7
    fields = (*CORNERS, "conf", "track_id")

    @property
    def state(self) -> np.ndarray:
        return np.column_stack([self.id, self.missed, self.conf, self.box]).astype(float)

    def read(self, pdf: pd.DataFrame) -> None:
        size = pdf["x0"].str.len().to_numpy(int)
        self.dets = np.full((len(pdf), max(size.max(), 1), len(self.fields)), np.nan)
        here = np.arange(self.dets.shape[1]) < size[:, None]
        for k, f in enumerate(self.fields):
            self.dets[here, k] = np.concatenate(pdf[f].to_numpy()).astype(float)
        self.sure = self.usable(self.dets)
        self.best = best_detections(self.dets, self.sure, self.cfg.target_confidence)

    def enter(self, slots: np.ndarray, state: np.ndarray) -> None:
        self.id[slots], self.missed[slots], self.conf[slots], self.box[slots] = state[:, 0].astype(int), state[:, 1].astype(int), state[:, 2], state[:, 3:]

    def step(self, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return super().step(at, self.dets[rows], self.sure[rows], self.best[rows])


def _rows_of(state) -> np.ndarray:
    return np.stack([np.array([np.nan if v is None else v for v in s], float) for s in state])


def in_slices(rows: DataFrame, keys: Sequence[str], make, slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """`rows` with st, shown and found: the state of a recurrence after each row, in order of sample_idx within the keys.

    A series is cut into slices of time, which all run at once, each as if nothing came before. Then the state at the end of a slice is handed
    to the next one, which runs again from it, but only until its state is the one it had there anyway: from that row on nothing changes. Slices
    whose end has changed hand over again, until none has. So the result is that of one run from the first row to the last, no task holds more than
    its slices, and for recurrences that forget the second run is short and the last. Each run is a stored table.

    `make()` gives the recurrence for many series at once: state, width, grow, read and step, and enter where state is not an array.
    """
    keys = list(keys)
    inputs = rows.columns
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", slice bigint, st array<double>, shown boolean, found boolean"
    sliced = rows.withColumn("slice", F.floor(F.col("sample_idx") / slice_frames).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, met = make(), np.zeros(0, bool)
        for pdf, series, frames in _by_frame(batches, [*keys, "slice"], slice_frames):
            known, n = len(met), int(series.max()) + 1
            model.grow(n)
            met = np.append(met, np.zeros(max(n - known, 0), bool))
            first = np.unique(series, return_index=True)
            fresh = first[0] >= known
            slots, at_row = first[0][fresh], first[1][fresh]
            has = pdf["entry"].notna().to_numpy()
            again = pdf["st"].notna().to_numpy()
            given = has[at_row]
            if given.any():
                state = _rows_of(pdf["entry"].to_numpy()[at_row[given]])
                model.enter(slots[given], state) if hasattr(model, "enter") else model.state.__setitem__(slots[given], state)
            # a series that ran before and gets no new state stays as it is
            met[slots[again[at_row] & ~given]] = True
            old = np.full((len(pdf), model.width), np.nan)
            if again.any():
                old[again] = _rows_of(pdf["st"].to_numpy()[again])
            shown, found = (pdf[c].eq(True).to_numpy(bool).copy() for c in ("shown", "found"))
            state = old.copy()
            model.read(pdf)
            for own in frames:
                own = own[~met[series[own]]]
                if not len(own):
                    continue
                at = series[own]
                shown[own], found[own] = model.step(at, own)
                now = model.state[at]
                state[own] = now
                same = ((now == old[own]) | (np.isnan(now) & np.isnan(old[own]))).all(axis=1) & again[own]
                met[at[same]] = True
            yield pdf[[*inputs, "slice"]].assign(st=list(state), shown=shown, found=found)

    none = [F.lit(None).cast("array<double>").alias("entry"), F.lit(None).cast("array<double>").alias("st"), F.lit(None).cast("boolean").alias("shown"), F.lit(None).cast("boolean").alias("found")]
    place = F.col("sample_idx") - F.col("slice") * slice_frames

    def ran(frame: DataFrame) -> DataFrame:
        dealt = frame.withColumn("__at", place).repartition(*keys, "slice").sortWithinPartitions("__at", *keys, "slice").drop("__at")
        return materialise(dealt.mapInPandas(run, schema), "slices")

    now = ran(sliced.select("*", *none))
    before = Window.partitionBy(*keys).orderBy("slice")
    used = None
    while True:
        ends = now.groupBy(*keys, "slice").agg(F.max_by("st", "sample_idx").alias("end"))
        handed = materialise(ends.select(*keys, "slice", F.lag("end").over(before).alias("entry")).where("entry is not null"), "handover")
        fresh = handed if used is None else handed.join(used.withColumnRenamed("entry", "__was"), [*keys, "slice"], "left").where(~F.col("entry").eqNullSafe(F.col("__was"))).drop("__was")
        if fresh.isEmpty():
            return now.drop("slice")
        used = handed
        now = ran(now.join(fresh, [*keys, "slice"], "left").select(*inputs, "slice", "entry", "st", "shown", "found"))


def _by_frame(batches: Iterator[pd.DataFrame], keys: Sequence[str], span: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, list[np.ndarray]]]:
    """Batches with each row's series number and the rows of each place in a slice; a series is in a place's rows once."""
    numbers: dict[tuple, int] = {}
    for pdf in batches:
        if not len(pdf):
            continue
        series = pdf.groupby(list(keys), sort=False, dropna=False)
        own = [numbers.setdefault(k, len(numbers)) for k in pdf[list(keys)].drop_duplicates().itertuples(index=False, name=None)]
        place = pdf["sample_idx"] - pdf["slice"] * span
        turn = pdf.groupby([*keys, "sample_idx"], sort=False, dropna=False).cumcount()
        frames = pdf.groupby([place, turn], sort=True).indices
        yield pdf, np.array(own)[series.ngroup().to_numpy()], list(frames.values())


def select_identity(detections: DataFrame, cfg: TrackSettings = TrackSettings(), keys: Sequence[str] = ("session_id", "camera_id"), slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """One tracked person per (session, camera, frame). ``detections`` has one row per frame with the
    frame's few boxes as dets array<struct<x0, y0, x1, y1, conf, track_id>>."""
    columns = [F.coalesce(F.col("dets")[f].cast("array<double>"), F.array().cast("array<double>")).alias(f) for f in Identities.fields]
    done = in_slices(detections.select(*keys, "sample_idx", *columns), keys, lambda: Identities(cfg), slice_frames)
    box = [F.col("st")[3 + k].alias(c) for k, c in enumerate(CORNERS)]
    return done.where("shown").select(*keys, "sample_idx", F.col("st")[0].cast("int").alias("track_id"), F.col("st")[2].alias("confidence"), F.col("found").alias("detected"), *box)


def track_boxes(boxes: DataFrame, image: tuple[int, int] = (1280, 720), keys: Sequence[str] = ("session_id", "camera_id"), slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """Sequentially updated box per camera from candidate boxes (columns x0, y0, x1, y1)."""
    done = in_slices(boxes.select(*keys, "sample_idx", *CORNERS), keys, lambda: Boxes(image), slice_frames)
    return done.select(*keys, "sample_idx", *[F.col("st")[k].alias(c) for k, c in enumerate(CORNERS)])
