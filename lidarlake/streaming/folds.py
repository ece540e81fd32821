"""Per-session step functions shared by the batch and the streaming forms.

A step takes a JSON-like state and the ordered rows of one session and returns the new state and
the output rows. Rows are slim: poses and scores, never points.
"""

import itertools
import math

import pandas as pd

from lidarlake.functions.numpose import angle, compose, distance, inverse
from lidarlake.schema import POSE_FIELDS


def as_list(pose):
    """Pose in any row form (dict, Row, sequence) as a list of seven."""
    if pose is None:
        return None
    if isinstance(pose, dict):
        return [float(pose[f]) for f in POSE_FIELDS]
    if hasattr(pose, "asDict"):
        return [float(getattr(pose, f)) for f in POSE_FIELDS]
    return [float(v) for v in pose]


def as_dict(pose):
    return None if pose is None else dict(zip(POSE_FIELDS, pose))


class Step:
    """A step over single rows: ``rows(state, rows)`` reads dicts in order, yields output dicts, returns the state.

    Called with a state and a pandas frame it gives the new state and a frame. Runners that hold many
    short sessions use ``rows``, which builds no frame per session and holds no session whole.
    """

    def __init__(self, rows, columns=None):
        self.rows, self.columns = rows, columns

    def __call__(self, state, pdf: pd.DataFrame):
        end, out = [state], []

        def run():
            end[0] = yield from self.rows(state, pdf.to_dict("records"))

        out = list(run())
        names = self.columns or list(dict.fromkeys([*pdf.columns, *(out[0] if out else ())]))
        return end[0], pd.DataFrame(out, columns=names)


# --- keyframe gate ----------------------------------------------------------------------------


def gate_step(dist=1.0, turn=0.5, pose="pose"):
    """Accept a frame that moved or turned enough since the last accepted one; the first always."""

    def fold(last, rows):
        for r in rows:
            p = as_list(r[pose])
            ok = last is None or distance(last, p) >= dist or angle(compose(inverse(last), p)) >= turn
            if ok:
                last = p
            yield {**r, "accepted": ok}
        return last

    return Step(fold)


# --- lock of a localization -------------------------------------------------------------------

LOCK = {
    "window": 5, "min_ll": 2.0, "margin": 0.35, "streak": 3, "converged": 3, "miss": 8.0, "ambiguity_margin": 0.35,
    "ambiguity_ratio": 1.05, "separation": 3.0,
}


def new_lock():
    return {"hyps": [], "window": 0, "winner": None, "streak": 0}


def lock_frame(state, rows, odom, p=LOCK):
    """One frame of lock tracking.

    ``rows``: dicts of scored registrations of this frame: seed, match_id, ll (log-likelihood),
    converged, valid, ambiguous, pose (scan in the map), x, y, z of the match. Returns the new
    state and a result dict.
    """
    res = {"status": "idle", "locked": False, "match_id": None, "map_odom": None, "confidence": None}
    s = {**state, "hyps": [dict(h) for h in state["hyps"]]}
    if not s["hyps"]:
        if any(r["ambiguous"] for r in rows):
            return s, {**res, "status": "ambiguous"}
        s["hyps"] = [
            {
                "seed": r["seed"], "match": r["match_id"], "ll": r["ll"], "conv": 1, "spot": r["spot"],
                "T": compose(r["pose"], inverse(odom)),
            }
            for r in rows
            if r["valid"]
        ]
        s["window"] = 1
        if not s["hyps"]:
            return new_lock() | {"window": 1}, res
    else:
        s["window"] += 1
        by_seed = {r["seed"]: r for r in rows}
        for h in s["hyps"]:
            r = by_seed.get(h["seed"])
            if r is None or r["match_id"] is None:
                h["ll"] -= p["miss"]
                continue
            h["ll"] += r["ll"]
            if r["converged"]:
                h["T"] = compose(r["pose"], inverse(odom))
                h["match"], h["spot"] = r["match_id"], r["spot"]
                h["conv"] += 1
    ranked = sorted(s["hyps"], key=lambda h: (-h["ll"], h["seed"]))
    top = ranked[0]
    second = ranked[1] if len(ranked) > 1 else None
    if top["seed"] == s["winner"]:
        s["streak"] += 1
    else:
        s["winner"], s["streak"] = top["seed"], 1
    window = max(1, p["window"])
    if s["window"] < window:
        return s, {**res, "status": "pending"}
    margin = top["ll"] - second["ll"] if second else math.inf
    need_conv = min(max(1, p["converged"]), window)
    viable = second is not None and second["ll"] >= p["min_ll"] and second["conv"] >= need_conv
    ratio = top["ll"] / second["ll"] if second and second["ll"] > 1e-6 else math.inf
    apart = second is not None and math.dist(top["spot"], second["spot"]) >= p["separation"]
    unclear = viable and apart and margin < p["ambiguity_margin"] and ratio < p["ambiguity_ratio"]
    good = (
        top["ll"] >= p["min_ll"]
        and margin >= max(0.0, p["margin"])
        and s["streak"] >= min(max(1, p["streak"]), window)
        and top["conv"] >= need_conv
    )
    if good and not unclear:
        res = {
            "status": "locked", "locked": True, "match_id": top["match"], "map_odom": top["T"],
            "confidence": min(1.0, max(0.0, top["ll"] / 10.0)),
        }
    else:
        res["status"] = "ambiguous" if unclear else "rejected"
    return new_lock(), res


def _plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA else v


def _scored(r):
    match = _plain(r["match_id"])
    return {
        "seed": int(r["seed"]),
        "match_id": None if match is None else int(match),
        "ll": float(r["ll"]),
        "converged": bool(r["converged"]),
        "valid": bool(r["valid"]),
        "ambiguous": bool(r["ambiguous"]),
        "pose": as_list(r["pose"]),
        "spot": [float(r["x"]), float(r["y"]), float(r["z"])],
    }


LOCK_DDL = (
    "frame_id long, status string, locked boolean, match_id long, confidence double, map_odom array<double>"
)


def lock_step(params=None):
    """Lock tracking over scored rows: several rows (one per seed) share a frame id."""
    p = {**LOCK, **(params or {})}

    def fold(state, rows):
        state = state or new_lock()
        for frame, group in itertools.groupby(rows, lambda r: r["frame_id"]):
            group = list(group)
            state, res = lock_frame(state, [_scored(r) for r in group], as_list(group[0]["odom"]), p)
            yield {"frame_id": int(frame), **res}
        return state

    return Step(fold, ["frame_id", "status", "locked", "match_id", "confidence", "map_odom"])


# --- mode of a session that extends a loaded map ----------------------------------------------


def mode_step(dist=1.0, turn=0.5):
    """Map loaded -> relocalized at the first lock -> extending at the first accepted keyframe.

    Rows: frame_id, lock (a lock happened on this frame), pose (in the map frame), gate_pose (the
    last loaded keyframe's odometry pose, used by the first gate). Frames before the lock fail.
    """

    def fold(state, rows):
        state = state or {"mode": "MAP_LOADED", "last": None}
        for r in rows:
            ok, accepted = False, False
            if state["mode"] == "MAP_LOADED":
                if bool(r["lock"]):
                    state["mode"], ok = "RELOCALIZED", True
                    state["last"] = as_list(_plain(r["gate_pose"]))
            else:
                ok, pose, last = True, as_list(r["pose"]), state["last"]
                accepted = (
                    last is None or distance(last, pose) >= dist or angle(compose(inverse(last), pose)) >= turn
                )
                if accepted:
                    state["mode"], state["last"] = "EXTENDING", pose
            yield {"frame_id": int(r["frame_id"]), "success": ok, "accepted": accepted, "mode": state["mode"]}
        return state

    return Step(fold, ["frame_id", "success", "accepted", "mode"])


MODE_DDL = "frame_id long, success boolean, accepted boolean, mode string"
