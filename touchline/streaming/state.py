"""Possession and tracks as they arrive: one state machine a clip, with the same rows as the batch operators.

Rows of a clip may come in any order and any batch, as long as they come before
the watermark. They wait in the clip's state; a timer at the first waiting row's
event time fires when no earlier row can follow, and what the watermark has
passed is worked off frame by frame. A second delivery of a waiting row replaces
the first. State holds the waiting rows (bounded by the watermark's delay) and
the machine itself: for possession four fields, for tracks those that haven't
expired. When a clip falls silent, a last timer lets its open tracks expire.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.tracking import CentroidMachine, LinkMachine, people

PLAIN = {"long": int, "double": float, "string": str, "boolean": bool}


class PossessionMachine:
    """Which team has the ball: a switch takes effect after `frames` equal candidates in a row, none at once."""

    out = "clip_id long, frame long, timestamp double, team string, candidate_team string, player_id long, distance_to_ball double, ball_x double, ball_y double, is_interpolated boolean, possession_reason string"

    def __init__(self, frames: int):
        self.frames = frames

    def begin(self) -> dict:
        return {"team": "None", "pending": None, "n": 0}

    def idle(self, state: dict) -> dict:
        return state

    def step(self, s: dict, frame: int, rows: list[dict]) -> tuple[dict, list[dict]]:
        out = []
        for r in rows:
            team, note = r["candidate_team"], ""
            if team == "None":
                s = self.begin()
            else:
                # the run of equal candidates goes on after a switch; only its frames-th row confirms one
                n = s["n"] + 1 if team == s["pending"] else 1
                switch = n >= self.frames and team != s["team"]
                s = {"team": team if n >= self.frames else s["team"], "pending": team, "n": n}
                note = "; smoothed_switch_confirmed" if switch else "" if team == s["team"] else f"; smoothed_pending_switch_to_{team}"
            mine = s["team"] != "None"
            out.append({**r, "team": s["team"], "player_id": r["track_id"] if mine else None, "distance_to_ball": r["d"] if mine else None, "possession_reason": r["reason"] + note})
        return s, out


class InOrder(StatefulProcessor):
    """Hands a clip's rows to a machine frame by frame, once the watermark has passed them."""

    def __init__(self, machine, rows: str, idle_ms: int):
        self.machine, self.rows, self.idle_ms = machine, rows, idle_ms
        self.types = {c.split()[0]: PLAIN[c.split()[1]] for c in rows.split(", ")}
        self.names = [c.split()[0] for c in machine.out.split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, n long", self.rows)
        self.state = handle.getValueState("machine", "state string, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            for r in pdf.to_dict("records"):
                ms = int(r["ts"].timestamp() * 1000)
                if ms <= now:  # too late: its frame has been worked off
                    continue
                self.waiting.updateValue((ms, int(r["n"])), tuple((math.nan if f is float else None) if pd.isna(r[c]) else f(r[c]) for c, f in self.types.items()))
                first = ms if first is None else min(first, ms)
        if first is not None and not any(t <= first for t in self.handle.listTimers()):
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        keys = sorted(self.waiting.keys())
        due = [k for k in keys if k[0] <= now]
        text, last = self.state.get() if self.state.exists() else (json.dumps(self.machine.begin()), -1)
        state, out = json.loads(text), []
        frames: dict[int, list[dict]] = {}
        for k in due:
            row = dict(zip(self.types, self.waiting.getValue(k), strict=True))
            frames.setdefault(row["frame"], []).append({"clip_id": key[0], **row})
            self.waiting.removeKey(k)
            last = max(last, k[0])
        for frame in sorted(frames):
            state, done = self.machine.step(state, frame, frames[frame])
            out += done
        if not due and not keys:
            state = self.machine.idle(state)
        self.state.update((json.dumps(state), last))
        if len(keys) > len(due):
            self.handle.registerTimer(keys[len(due)][0])
        elif due:
            self.handle.registerTimer(max(last, now) + self.idle_ms)
        return iter([pd.DataFrame(out, columns=self.names)] if out else ())

    def close(self) -> None:
        pass


def _machine(stream: DataFrame, machine, rows: str, n: str, at: str, late: str, idle_ms: int) -> DataFrame:
    df = stream.select(F.col("clip_id").cast("long").alias("clip_id"), F.col(at).alias("ts"), F.expr(n).cast("long").alias("n"), *(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in rows.split(", "))))
    return df.withWatermark("ts", late).groupBy("clip_id").transformWithStateInPandas(InOrder(machine, rows, idle_ms), machine.out, "Append", "EventTime")


def possession_stream(candidates: DataFrame, frames: int = 3, at: str = "ts", late: str = "10 seconds") -> DataFrame:
    """The rows of estimate_possession from a stream of candidates (clip_id, frame, at, timestamp, candidate_team, reason, track_id, d, ball_x, ball_y, is_interpolated; one row a frame). Needs the RocksDB state store."""
    rows = "frame long, timestamp double, candidate_team string, reason string, track_id long, d double, ball_x double, ball_y double, is_interpolated boolean"
    return _machine(candidates, PossessionMachine(frames), rows, "0", at, late, 10_000)


def link_stream(detections: DataFrame, reach: float = 90.0, max_gap: int = 8, least: int = 2, at: str = "ts", late: str = "10 seconds", idle_ms: int = 10_000) -> DataFrame:
    """The rows of link_ball_tracks from a stream of detections; a track's first points come with its point number `least`. idle_ms: how long a clip may be silent before its tracks expire, longer than max_gap frames."""
    rows = "frame long, det_id long, timestamp double, center_x double, center_y double, confidence double"
    return _machine(detections, LinkMachine(reach, max_gap, least), rows, "det_id", at, late, idle_ms)


def centroid_stream(detections: DataFrame, reach: float = 120.0, max_missing: int = 30, smooth: float = 0.7, least_area: float = 100.0, at: str = "ts", late: str = "10 seconds", idle_ms: int = 10_000) -> DataFrame:
    """The rows of centroid_track from a stream of detections."""
    return _machine(people(detections.withColumn("ts", F.col(at)), least_area), CentroidMachine(reach, max_missing, smooth), "frame long, det_id long, x1 double, y1 double, x2 double, y2 double", "det_id", "ts", late, idle_ms)
