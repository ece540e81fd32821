"""Running the step functions: chunk-parallel over tables, with keyed state over streams."""

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.functions.pose import pose_between, rotation_angle, translation_norm
from lidarlake.operators.clouds import CLOUD, member_points, voxel_downsample
from lidarlake.operators.sequence import _key_ddl, _split_ddl, chunked_fold
from lidarlake.streaming.folds import gate_step


def fold_batch(df: DataFrame, step, out_ddl: str, keys=("session_id",), order="frame_id", chunk_size=100_000):
    """A step over a finished table, sessions cut into chunks of ``order``."""
    chunk = F.floor(F.col(order) / chunk_size)
    return chunked_fold(df, list(keys), chunk, order, step.rows, out_ddl, None)


def fold_stream(df: DataFrame, step, out_ddl: str, keys=("session_id",), order="frame_id") -> DataFrame:
    """The same step over a stream; the state of a session survives between micro-batches.

    Rows of a session must arrive in order across micro-batches; inside one they are sorted.
    """
    keys = list(keys)
    names = [c.strip().split(" ")[0] for c in _split_ddl(out_ddl)]

    def run(key, batches, state):
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        held = json.loads(state.get[0]) if state.exists else None
        held, out = step(held, pdf)
        state.update((json.dumps(held),))
        out = out[names].copy()
        for k, v in zip(keys, key):
            out[k] = v
        yield out[[*keys, *names]]

    return df.groupBy(*keys).applyInPandasWithState(
        run, f"{_key_ddl(df, keys)}, {out_ddl}", "state string", "append", "NoTimeout"
    )


def keyframe_gate(frames: DataFrame, dist=1.0, angle=0.5, order="seq", pose="pose", chunk_size=100_000):
    """Flag the frames that become keyframes: keys session_id; returns session_id, seq, accepted.

    Works on tables and on streams.
    """
    slim = frames.select("session_id", order, pose)
    step, ddl = gate_step(dist, angle, pose), f"{order} long, accepted boolean"
    if frames.isStreaming:
        return fold_stream(slim, step, ddl, order=order)
    return fold_batch(slim, step, ddl, order=order, chunk_size=chunk_size)


def lock_count_stream(results: DataFrame, order="seq") -> DataFrame:
    """Running number of locks per session over a stream of frame results."""

    def step(n, pdf):
        hits = pdf[pdf["locked"]]
        start = n or 0
        return start + len(hits), hits.assign(lock_count=range(start + 1, start + 1 + len(hits)))

    slim = results.select("session_id", order, "locked")
    return fold_stream(slim, step, f"{order} long, lock_count long", order=order)


def monotone_stream(rows: DataFrame, ts="ts", order="seq") -> DataFrame:
    """Drop rows of a stream whose time (double seconds) does not exceed every earlier one."""

    def step(last, pdf):
        keep = []
        for t in pdf[ts]:
            keep.append(last is None or t > last)
            last = t if last is None else max(last, t)
        return last, pdf[keep]

    slim = rows.select("session_id", order, ts)
    return fold_stream(slim, step, f"{order} long, {ts} double", order=order)


def static_members(frames: DataFrame, max_frames=5, min_frames=3, max_t=0.25, max_r=0.20) -> DataFrame:
    """Earlier frames that may be merged into each frame because the sensor stood still.

    ``frames``: session_id, seq (dense), frame_id, pose. Going back from the frame, members end at
    the first one too far away; with fewer than ``min_frames`` only the frame itself remains.
    Output: session_id, frame_id, member_id, pose (of the member, seen from the frame).
    """
    return _member_runs(frames, max_frames, min_frames, max_t, max_r).drop("_n")


def _member_runs(frames, max_frames=5, min_frames=3, max_t=0.25, max_r=0.20):
    """``static_members`` with the number of members of the frame, ``_n``."""
    # The rows before a frame hold its members: frames are dealt by session once and joined with nothing.
    back = Window.partitionBy("session_id").orderBy("seq")
    old = F.struct("seq", F.col("frame_id").alias("member_id"), F.col("pose").alias("then"))
    rows = frames.select(
        "session_id", "frame_id", "seq", F.col("pose").alias("_now"),
        F.array(old, *(F.lag(old, k).over(back) for k in range(1, max(1, max_frames)))).alias("_old"),
    ).select("session_id", "frame_id", "seq", "_now", F.explode("_old").alias("_o"))
    near = rows.withColumns({"k": F.col("seq") - F.col("_o.seq"), "member_id": F.col("_o.member_id")})
    near = near.filter(F.col("k") < max(1, max_frames)).withColumn("pose", pose_between("_now", "_o.then"))
    ok = (translation_norm("pose") <= max_t) & (rotation_angle("pose") <= max_r)
    # At most five rows per frame: find the first break, keep what is nearer.
    runs = near.groupBy("session_id", "frame_id").agg(
        F.min(F.when(~ok, F.col("k"))).alias("_break"),
        F.collect_list(F.struct("k", "member_id", "pose")).alias("_m"),
    )
    kept = F.filter("_m", lambda m: F.col("_break").isNull() | (m["k"] < F.col("_break")))
    alone = F.filter("_m", lambda m: m["k"] == 0)
    chosen = runs.withColumn("_c", F.when(F.size(kept) >= max(1, min_frames), kept).otherwise(alone))
    return chosen.select("session_id", "frame_id", F.size("_c").alias("_n"), F.explode("_c").alias("m")).select(
        "session_id", "frame_id", "m.member_id", "m.pose", "_n"
    )


#: Points of merged clouds that one task thins.
POINTS_PER_TASK = 1_000_000


def static_aggregate(frames: DataFrame, points: DataFrame, leaf=0.12, **limits) -> DataFrame:
    """Query cloud of each frame, merged over the members and thinned where there are several.

    ``points``: session_id, frame_id, x, y, z, intensity.
    """
    linked = _member_runs(frames, **limits).select(
        F.col("session_id").alias("map_id"), F.col("frame_id").alias("target"), "_n",
        F.col("member_id").alias("kf_id"), "pose",
    )
    clouds = points.withColumnsRenamed({"session_id": "map_id", "frame_id": "kf_id"})
    merged = member_points(linked, clouds).select(
        "map_id", F.col("target").alias("kf_id"), "_n", "x", "y", "z", "intensity"
    )
    single = merged.filter("_n = 1").drop("_n")
    # Clouds of members hardly share a cell before they meet: points travel to their frame and are thinned there.
    tasks = -(-points.count() * limits.get("max_frames", 5) // POINTS_PER_TASK)
    width = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    met = merged.filter("_n > 1").drop("_n").repartition(width, *CLOUD)
    many = voxel_downsample(met, leaf).select(*single.columns)
    return single.unionByName(many).withColumnsRenamed({"map_id": "session_id", "kf_id": "frame_id"})


def static_members_stream(frames: DataFrame, max_frames=5, min_frames=3, max_t=0.25, max_r=0.20) -> DataFrame:
    """Members of each frame over a stream: session_id, frame_id, member_id, pose (array of seven)."""
    from lidarlake.streaming import folds as S

    def step(buffer, pdf):
        buffer, out = buffer or [], []
        for frame, pose in zip(pdf["frame_id"], pdf["pose"]):
            now = S.as_list(pose)
            buffer = [*buffer, [int(frame), now]][-max(1, max_frames) :]
            members = []
            for member, then in reversed(buffer):
                rel = S.compose(S.inverse(now), then)
                if S.distance(rel, [0, 0, 0]) > max_t or S.angle(rel) > max_r:
                    break
                members.append((int(frame), member, rel))
            out += members if len(members) >= max(1, min_frames) else members[:1]
        return buffer, pd.DataFrame(out, columns=["frame_id", "member_id", "pose"])

    slim = frames.select("session_id", "frame_id", "pose")
    return fold_stream(slim, step, "frame_id long, member_id long, pose array<double>")
