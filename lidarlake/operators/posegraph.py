"""Pose graphs: residuals, start values and batch relaxation, for all maps in the same joins."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarlake.functions.pose import (
    pose_between,
    pose_compose,
    pose_inverse,
    rotation_angle,
    translation_norm,
)
from lidarlake.functions.predicates import is_finite_pose
from lidarlake.functions.scores import NOISE, edge_information, robust_weight
from lidarlake.operators.binding import bind
from lidarlake.operators.neighbors import fresh, split_large
from lidarlake.operators.ranking import anchor_row
from lidarlake.operators.register import step_pose
from lidarlake.operators.sequence import dense_position
from lidarlake.schema import POSE_FIELDS
from lidarlake.session import materialize

NODE = ["map_id", "kf_id"]
#: Nodes and edges of a map whose linear system one task solves.
ROWS_IN_TASK = 100_000


def edge_residuals(edges: DataFrame, poses: DataFrame) -> DataFrame:
    """Residual pose and its translation and rotation norms; edges lacking a pose are left out."""
    a = poses.select("map_id", F.col("kf_id").alias("from_id"), F.col("pose").alias("_a"))
    b = poses.select("map_id", F.col("kf_id").alias("to_id"), F.col("pose").alias("_b"))
    both = edges.join(a, ["map_id", "from_id"]).join(b, ["map_id", "to_id"])
    both = bind(both, "_rel", pose_between("_a", "_b"))
    both = bind(both, "residual", pose_compose(pose_inverse("meas"), "_rel"))
    return (
        both.withColumn("residual_t", translation_norm("residual"))
        .withColumn("residual_r", rotation_angle("residual"))
        .drop("_a", "_b", "_rel")
    )


def mean_residual(edges: DataFrame, poses: DataFrame) -> DataFrame:
    return edge_residuals(edges, poses).groupBy("map_id").agg(
        F.avg("residual_t").alias("mean_t"), F.avg("residual_r").alias("mean_r"), F.count(F.lit(1)).alias("edges")
    )


def pose_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sums, means and maxima of the pose changes per map."""
    moved = before.select(*NODE, F.col("pose").alias("_a")).join(
        after.select(*NODE, F.col("pose").alias("_b")), NODE
    )
    moved, d = bind(moved, "_d", pose_between("_a", "_b")), "_d"
    per = moved.select("map_id", translation_norm(d).alias("t"), rotation_angle(d).alias("r"))
    return running_mean_combine(
        per.groupBy("map_id").agg(
            F.sum("t").alias("sum_t"), F.sum("r").alias("sum_r"), F.max("t").alias("max_t"),
            F.max("r").alias("max_r"), F.count(F.lit(1)).alias("count"),
        )
    )


def running_mean_combine(reports: DataFrame, keys=("map_id",)) -> DataFrame:
    """Combine reports of several rounds: sums and counts add up, means are taken at the end."""
    total = reports.groupBy(*keys).agg(
        F.sum("sum_t").alias("sum_t"), F.sum("sum_r").alias("sum_r"), F.max("max_t").alias("max_t"),
        F.max("max_r").alias("max_r"), F.sum("count").alias("count"),
    )
    return total.withColumn("mean_t", F.col("sum_t") / F.col("count")).withColumn(
        "mean_r", F.col("sum_r") / F.col("count")
    )


def edge_noise(edges: DataFrame) -> DataFrame:
    """Replace an all-zero information matrix by the default of the edge's kind."""
    zero = F.forall("info", lambda v: F.abs(v) < 1e-10)
    return edges.withColumn("info", F.when(zero, edge_information("type")).otherwise(F.col("info")))


def _compose_rows(a, b):
    """Compose poses stored as rows of seven."""
    ta, qa, tb, qb = a[:3], a[3:], b[:3], b[3:]
    u = 2 * np.cross(qa[:3], tb)
    t = ta + tb + qa[3] * u + np.cross(qa[:3], u)
    v = qa[3] * qb[:3] + qb[3] * qa[:3] + np.cross(qa[:3], qb[:3])
    q = np.array([*v, qa[3] * qb[3] - qa[:3] @ qb[:3]])
    return np.concatenate([t, q / np.linalg.norm(q)])


_IDENTITY = np.array([0, 0, 0, 0, 0, 0, 1.0])


def initial_values(edges: DataFrame, anchors: DataFrame, chunk=10_000) -> DataFrame:
    """Poses from chained odometry: each is the one before times the measurement.

    The product is associative: chunks of the chain are multiplied in parallel, the few chunk
    totals are chained, and both are combined. The chain ends at the first missing link.
    ``anchors``: map_id, kf_id, opt. Output: map_id, kf_id, pose.
    """
    odo = edges.filter("type = 'ODOMETRY' and to_id = from_id + 1").select("map_id", "to_id", "meas")
    start = anchors.select("map_id", F.col("kf_id").alias("_root"), F.col("opt").alias("_start"))
    after = odo.join(start, ["map_id"]).filter(F.col("to_id") > F.col("_root"))
    run = dense_position(after, ["map_id"], "to_id").filter(
        F.col("to_id") - F.col("pos") == F.col("_root") + 1
    )
    rows = run.select(
        "map_id", "to_id", F.floor(F.col("pos") / chunk).alias("chunk"), "meas.*"
    )

    def prefix(order):
        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            m, acc = pdf[list(POSE_FIELDS)].to_numpy(), _IDENTITY
            out = np.empty_like(m)
            for i in range(len(m)):
                out[i] = acc = _compose_rows(acc, m[i])
            pdf[list(POSE_FIELDS)] = out
            return pdf

        return fold

    local = rows.groupBy("map_id", "chunk").applyInPandas(prefix("to_id"), rows.schema)
    local = materialize(local)
    totals = local.groupBy("map_id", "chunk").agg(
        F.max_by(F.struct(*POSE_FIELDS), "to_id").alias("_t")
    ).select("map_id", "chunk", "_t.*")
    chained = totals.groupBy("map_id").applyInPandas(prefix("chunk"), totals.schema)
    offset = chained.select("map_id", (F.col("chunk") + 1).alias("chunk"), F.struct(*POSE_FIELDS).alias("_o"))
    here = local.select("map_id", "chunk", F.col("to_id").alias("kf_id"), F.struct(*POSE_FIELDS).alias("_l"))
    joined = here.join(offset, ["map_id", "chunk"], "left").join(start, ["map_id"])
    chain = F.when(F.col("_o").isNotNull(), pose_compose("_o", "_l")).otherwise(F.col("_l"))
    out = joined.withColumn("_c", chain).select(*NODE, pose_compose("_start", "_c").alias("pose"))
    return out.unionByName(start.select("map_id", F.col("_root").alias("kf_id"), F.col("_start").alias("pose")))


# --- linearisation kernels, over Arrow batches of edges ---------------------------------------


def _rot(q):
    x, y, z, w = q.T
    return np.stack(
        [
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        ],
        axis=1,
    ).reshape(-1, 3, 3)


def _skew(v):
    m = np.zeros((len(v), 3, 3))
    m[:, 0, 1], m[:, 0, 2] = -v[:, 2], v[:, 1]
    m[:, 1, 0], m[:, 1, 2] = v[:, 2], -v[:, 0]
    m[:, 2, 0], m[:, 2, 1] = -v[:, 1], v[:, 0]
    return m


def _rotvec(q):
    q = np.where(q[:, 3:] < 0, -q, q)
    s = np.linalg.norm(q[:, :3], axis=1)
    k = np.where(s > 1e-12, 2 * np.arctan2(s, q[:, 3]) / np.where(s > 1e-12, s, 1), 2.0)
    return q[:, :3] * k[:, None]


def _right_inverse(phi):
    """Inverse right Jacobian of the rotation group."""
    a = np.linalg.norm(phi, axis=1)
    k = _skew(phi)
    small = a < 1e-6
    a_ = np.where(small, 1.0, a)
    c = np.where(small, 1 / 12.0, 1 / a_**2 - (1 + np.cos(a_)) / (2 * a_ * np.sin(a_) + 1e-300))
    return np.eye(3) + 0.5 * k + c[:, None, None] * (k @ k)


def _full(packed):
    m = np.zeros((len(packed), 6, 6))
    iu = np.triu_indices(6)
    m[:, iu[0], iu[1]] = packed
    m[:, iu[1], iu[0]] = packed
    return m


def _linearize(batches):
    """Per edge: gradient and Hessian blocks of the weighted residual."""
    for pdf in batches:
        if pdf.empty:
            continue
        res = pdf[[f"r_{f}" for f in POSE_FIELDS]].to_numpy()
        rel = pdf[[f"d_{f}" for f in POSE_FIELDS]].to_numpy()
        om = _full(np.stack(pdf["info"].to_numpy())) * pdf["weight"].to_numpy()[:, None, None]
        phi = _rotvec(res[:, 3:])
        e = np.concatenate([res[:, :3], phi], axis=1)
        jj = np.zeros((len(pdf), 6, 6))
        jj[:, :3, :3], jj[:, 3:, 3:] = _rot(res[:, 3:]), _right_inverse(phi)
        rt = np.transpose(_rot(rel[:, 3:]), (0, 2, 1))
        back = np.zeros((len(pdf), 6, 6))
        back[:, :3, :3] = back[:, 3:, 3:] = rt
        back[:, :3, 3:] = _skew(-np.einsum("nij,nj->ni", rt, rel[:, :3])) @ rt
        ji = -jj @ back
        jit, jjt = np.transpose(ji, (0, 2, 1)) @ om, np.transpose(jj, (0, 2, 1)) @ om
        blocks = {
            "h_ff": jit @ ji, "h_ft": jit @ jj, "h_tt": jjt @ jj,
            "b_f": np.einsum("nij,nj->ni", jit, e), "b_t": np.einsum("nij,nj->ni", jjt, e),
        }
        yield pd.DataFrame(
            {c: pdf[c] for c in ("map_id", "from_id", "to_id")}
            | {k: list(v.reshape(len(pdf), -1)) for k, v in blocks.items()}
        )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _edge_cost_terms(res: pd.DataFrame, info: pd.Series) -> pd.Series:
    """Squared whitened norm of each residual, as a one-element array."""
    r = res[list(POSE_FIELDS)].to_numpy()
    e = np.concatenate([r[:, :3], _rotvec(r[:, 3:])], axis=1)
    return pd.Series(list(np.einsum("ni,nij,nj->n", e, _full(np.stack(info.to_numpy())), e)[:, None]))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _invert(h: pd.Series) -> pd.Series:
    m = np.stack(h.to_numpy()).reshape(-1, 6, 6)
    return pd.Series(list(np.linalg.inv(m + 1e-9 * np.eye(6)).reshape(-1, 36)))


def _with_cost(edges, poses, kind, delta):
    """Residual, robust weight and loss of each edge; only loop edges are robust."""
    out = edge_residuals(edges, poses).withColumn("_q", F.get(_edge_cost_terms("residual", "info"), F.lit(0)))
    norm = F.sqrt("_q")
    robust = (F.col("type") == "LOOP") & F.lit(kind is not None)
    d2 = delta * delta
    loss = {
        "Huber": F.when(norm <= delta, F.col("_q") / 2).otherwise(delta * (norm - delta / 2)),
        "Cauchy": 0.5 * d2 * F.log1p(F.col("_q") / d2),
        "DCS": F.when(F.col("_q") <= delta, F.col("_q") / 2).otherwise(
            delta * (3 * F.col("_q") - delta) / (2 * (F.col("_q") + delta))
        ),
    }.get(kind, F.col("_q") / 2)
    return out.withColumn(
        "weight", F.when(robust, robust_weight(norm, kind, delta)).otherwise(1.0)
    ).withColumn("loss", F.when(robust, loss).otherwise(F.col("_q") / 2))


def _prior_residual(poses, priors):
    """Residual of the anchored node against its prior pose."""
    t, r = NOISE["PRIOR"]
    e = F.col("_d")
    w = [1 / (t * t)] * 3 + [1 / (r * r)] * 3
    sign = F.when(e["qw"] < 0, -1.0).otherwise(1.0)
    err = F.array(e["tx"], e["ty"], e["tz"], *(2 * sign * e[f"q{c}"] for c in "xyz"))
    out = bind(poses.join(priors, NODE), "_d", pose_between("_prior", "pose")).withColumn("_e", err)
    cost = sum((F.get("_e", F.lit(i)) ** 2 * (w[i] / 2) for i in range(6)), F.lit(0.0))
    return out.withColumn("_cost", cost), w


def objective(edges, poses, priors, kind="Cauchy", delta=1.0) -> DataFrame:
    """Total loss per map: map_id, cost."""
    loss = _with_cost(edges, poses, kind, delta).select("map_id", "loss")
    prior, _ = _prior_residual(poses, priors)
    return loss.unionByName(prior.select("map_id", F.col("_cost").alias("loss"))).groupBy("map_id").agg(
        F.sum("loss").alias("cost")
    )


def _matvec(m: str, v: str, transpose=False):
    """6x6 column (array of 36) times vector column (array of 6), inside code generation.

    Built as text: one expression object instead of hundreds.
    """
    def at(i, j):
        return f"{m}[{j * 6 + i if transpose else i * 6 + j}]"

    rows = (" + ".join(f"{at(i, j)} * {v}[{j}]" for j in range(6)) for i in range(6))
    return F.expr(f"array({', '.join(rows)})")


def _axpy(x, a, y):
    return F.zip_with(x, y, lambda u, v: u + a * v)


def _dot(a: str, b: str):
    return F.expr(" + ".join(f"{a}[{i}] * {b}[{i}]" for i in range(6)))


def _sum_arrays(df, keys, **columns):
    """Element-wise sums of array columns; ``columns`` maps names to lengths."""
    sums = [F.expr(f"sum({n}[{i}]) as {n}{i}") for n, k in columns.items() for i in range(k)]
    packed = (f"array({', '.join(f'{n}{i}' for i in range(k))}) as {n}" for n, k in columns.items())
    return df.groupBy(*keys).agg(*sums).selectExpr(*keys, *packed)


def _times_matrix(blocks, nodes, vec, out):
    """Add the product of the block system with the node vector ``vec`` as column ``out``."""
    v = nodes.select(*NODE, F.col(vec).alias("_v"))
    at_from = v.withColumnsRenamed({"kf_id": "from_id", "_v": "_f"})
    at_to = v.withColumnsRenamed({"kf_id": "to_id", "_v": "_t"})
    ends = blocks.join(at_from, ["map_id", "from_id"]).join(at_to, ["map_id", "to_id"])
    both = F.array(
        F.struct(F.col("from_id").alias("kf_id"), _matvec("h_ft", "_t").alias("off")),
        F.struct(F.col("to_id").alias("kf_id"), _matvec("h_ft", "_f", True).alias("off")),
    )
    off = _sum_arrays(ends.select("map_id", F.explode(both).alias("e")).select("map_id", "e.*"), NODE, off=6)
    own = _matvec("diag", vec)
    full = F.when(F.col("off").isNotNull(), _axpy(own, F.lit(1.0), F.col("off"))).otherwise(own)
    return nodes.join(off, NODE, "left").withColumn(out, full).drop("off")


def _solve_step(blocks, nodes, iterations, tol):
    """Conjugate gradient on the block system, preconditioned by the inverse diagonal blocks.

    ``blocks``: map_id, from_id, to_id, h_ft. ``nodes``: map_id, kf_id, diag, b, inv. Maps whose system fits a task
    are solved there, larger ones in rounds over tables. Output: map_id, kf_id, x, left.
    """
    small, large = split_large([blocks, nodes], ["map_id"], ROWS_IN_TASK)
    found = _solve_in_tasks(*small, iterations, tol)
    if large is None:
        return found
    return found.unionByName(_solve_over_tables(*large, iterations, tol))


def conjugate_gradient(diag, inv, b, ends, off, iterations, tol):
    """(x, left) of one map: blocks ``diag`` and ``inv`` and vector ``b`` per node, blocks ``off`` between the rows ``ends``."""
    x, p, s, r = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b), -b
    i, j = ends
    gamma = alpha = start = 0.0
    for turn in range(iterations):
        z = np.einsum("nij,nj->ni", inv, r)
        w = np.einsum("nij,nj->ni", diag, z)
        np.add.at(w, i, np.einsum("nij,nj->ni", off, z[j]))
        np.add.at(w, j, np.einsum("nji,nj->ni", off, z[i]))
        g, d = float((r * z).sum()), float((z * w).sum())
        start = start if turn else g
        beta = g / gamma if alpha else 0.0
        den = d - beta * g / alpha if beta else d
        gamma, alpha = g, g / den if g > tol * start and den > 0 else 0.0
        # Without a step the next turn starts afresh, which changes something only after a turned direction.
        if not alpha and (not beta or g <= tol * start):
            break
        p, s = z + beta * p, w + beta * s
        r, x = r - alpha * s, x + alpha * p
    return x, math.sqrt(abs(gamma) / start) if start > 0 else 0.0


def _solve_in_tasks(blocks, nodes, iterations, tol):
    def run(es: pd.DataFrame, ns: pd.DataFrame) -> pd.DataFrame:
        if ns.empty:
            return pd.DataFrame([], columns=[*NODE, "x", "left"])
        # The same order whatever the shuffle brought, so that reruns agree to the last digit.
        ns, es = ns.sort_values("kf_id"), es.sort_values(["from_id", "to_id"], kind="stable")
        ids = ns["kf_id"].to_numpy()
        ends = [np.searchsorted(ids, es[c].to_numpy()) for c in ("from_id", "to_id")]
        known = np.all([ids[np.minimum(e, len(ids) - 1)] == es[c] for e, c in zip(ends, ("from_id", "to_id"))], axis=0)
        off = np.stack(es["h_ft"].to_numpy()).reshape(-1, 6, 6)[known] if len(es) else np.zeros((0, 6, 6))
        diag, inv, b = (np.stack(ns[c].to_numpy()) for c in ("diag", "inv", "b"))
        x, left = conjugate_gradient(diag.reshape(-1, 6, 6), inv.reshape(-1, 6, 6), b, [e[known] for e in ends], off, iterations, tol)
        return pd.DataFrame({"map_id": ns["map_id"].to_numpy(), "kf_id": ids, "x": list(x), "left": left})

    nodes = fresh(nodes.select(*NODE, "diag", "inv", "b"))
    return blocks.groupBy("map_id").cogroup(nodes.groupBy("map_id")).applyInPandas(run, "map_id long, kf_id long, x array<double>, left double")


def _solve_over_tables(blocks, nodes, iterations, tol):
    """The same for maps that are too large for a task.

    In the single-reduction form: one matrix product and one set of per-map sums per iteration,
    so an iteration is one job and one written table. The scalars live in the plan. Maps that
    reached ``tol`` keep their step. ``left`` is what the residual of the map came down to, of its start.
    """
    zero = F.array(*(F.lit(0.0) for _ in range(6)))
    none = F.lit(None).cast("double")
    state = materialize(
        nodes.withColumn("r", F.transform("b", lambda v: -v))
        .drop("b")
        .withColumns({"x": zero, "p": zero, "s": zero, "gamma": none, "alpha": none, "start": none})
    )
    for _ in range(iterations):
        work = _times_matrix(blocks, state.withColumn("z", _matvec("inv", "r")), "z", "w")
        sums = work.groupBy("map_id").agg(
            F.sum(_dot("r", "z")).alias("_g"), F.sum(_dot("z", "w")).alias("_d"),
            F.max("gamma").alias("_g0"), F.max("alpha").alias("_a0"), F.max("start").alias("_s0"),
        )
        start = F.coalesce("_s0", "_g")
        beta = F.when(F.col("_a0").isNull() | (F.col("_a0") == 0), 0.0).otherwise(F.col("_g") / F.col("_g0"))
        scalars = sums.withColumn("_beta", beta).withColumn("_start", start).withColumn(
            "_den",
            F.when(F.col("_beta") == 0, F.col("_d")).otherwise(F.col("_d") - F.col("_beta") * F.col("_g") / F.col("_a0")),
        )
        live = (F.col("_g") > tol * F.col("_start")) & (F.col("_den") > 0)
        scalars = scalars.select(
            "map_id", "_beta", "_start", "_g", F.when(live, F.col("_g") / F.col("_den")).otherwise(0.0).alias("_alpha")
        )
        state = materialize(
            work.join(scalars, "map_id")
            .withColumn("p", _axpy(F.col("z"), F.col("_beta"), F.col("p")))
            .withColumn("s", _axpy(F.col("w"), F.col("_beta"), F.col("s")))
            .select(
                *NODE, "diag", "inv",
                _axpy(F.col("r"), -F.col("_alpha"), F.col("s")).alias("r"),
                _axpy(F.col("x"), F.col("_alpha"), F.col("p")).alias("x"),
                "p", "s", F.col("_g").alias("gamma"), F.col("_alpha").alias("alpha"), F.col("_start").alias("start"),
            )
        )
        if state.filter("alpha <> 0").isEmpty():
            break
    left = F.when(F.col("start") > 0, F.sqrt(F.abs(F.col("gamma")) / F.col("start"))).otherwise(0.0)
    return state.select(*NODE, "x", F.coalesce(left, F.lit(1.0)).alias("left"))


def relax_pose_graph(
    nodes: DataFrame, edges: DataFrame, iterations=10, cg_iterations=50, cg_tol=1e-10, kind="Cauchy",
    delta=1.0, min_gain=1e-6, halvings=4, report=False,
):
    """Poses that minimise the weighted edge residuals with a prior on each map's first node.

    ``nodes``: map_id, kf_id, pose. ``edges``: map_id, from_id, to_id, meas, info, type. Gauss-Newton;
    a map takes a step only if its objective falls, halving the step a few times before giving up,
    and stops when the gain is small. Output: map_id, kf_id, pose; with ``report`` also a table
    map_id, cost, steps, gradient (norm at the last linearization), residual (of the last linear solve,
    relative), promised (what its quadratic model gains by the step), stalled (no halved step lowered the
    objective, although more than a small gain was promised) and converged (the gain, or the promised one,
    became small; false if stalled or if the steps ran out first).
    """
    edges = materialize(edge_noise(edges))
    poses = materialize(nodes.select(*NODE, "pose"))
    roots = anchor_row(poses.withColumnRenamed("pose", "opt"))
    priors = materialize(roots.select(*NODE, F.col("opt").alias("_prior")))
    none = F.lit(None).cast("double")
    start = {"active": F.lit(True), "steps": F.lit(0), "gradient": none, "residual": none, "promised": none, "moved": F.lit(True)}
    cost = materialize(objective(edges, poses, priors, kind, delta).withColumns(start))
    for _ in range(iterations):
        live = cost.filter("active").select("map_id")
        if live.isEmpty():
            break
        lin = _with_cost(edges.join(live, "map_id", "left_semi"), poses, kind, delta)
        lin, rel = bind(lin, "_rel", pose_compose("meas", "residual")), F.col("_rel")
        flat = lin.select(
            "map_id", "from_id", "to_id", "info", "weight",
            *(F.col(f"residual.{f}").alias(f"r_{f}") for f in POSE_FIELDS),
            *(rel.getField(f).alias(f"d_{f}") for f in POSE_FIELDS),
        )
        ddl = "map_id long, from_id long, to_id long, h_ff array<double>, h_ft array<double>, h_tt array<double>, b_f array<double>, b_t array<double>"
        blocks = materialize(flat.mapInPandas(_linearize, ddl))
        prior, w = _prior_residual(poses.join(live, "map_id", "left_semi"), priors)
        eye = F.array(*(F.lit(w[i] if i == j else 0.0) for i in range(6) for j in range(6)))
        grad = F.array(*(F.get("_e", F.lit(i)) * w[i] for i in range(6)))
        ends = (
            blocks.select("map_id", F.col("from_id").alias("kf_id"), F.col("h_ff").alias("diag"), F.col("b_f").alias("b"))
            .unionByName(
                blocks.select("map_id", F.col("to_id").alias("kf_id"), F.col("h_tt").alias("diag"), F.col("b_t").alias("b"))
            )
            .unionByName(prior.select(*NODE, eye.alias("diag"), grad.alias("b")))
        )
        system = _sum_arrays(ends, NODE, diag=36, b=6).withColumn("inv", _invert("diag"))
        system = materialize(system)
        square = F.aggregate("b", F.lit(0.0), lambda total, v: total + v * v)
        norm = system.groupBy("map_id").agg(F.sqrt(F.sum(square)).alias("_norm"))
        cost = cost.join(norm, "map_id", "left").withColumns(
            {"gradient": F.coalesce("_norm", "gradient"), "steps": F.col("steps") + F.col("active").cast("int")}
        ).drop("_norm")
        step = materialize(
            _solve_step(blocks.select("map_id", "from_id", "to_id", "h_ft"), system, cg_iterations, cg_tol)
        )
        solved = step.join(system.select(*NODE, "b"), NODE).groupBy("map_id").agg(
            F.max("left").alias("_left"), (F.sum(_dot("b", "x")) / -2).alias("_promised")
        )
        last = {"residual": F.coalesce("_left", "residual"), "promised": F.coalesce("_promised", "promised")}
        cost = cost.join(solved, "map_id", "left").withColumns(last).drop("_left", "_promised")
        poses, cost = _take_step(poses, step, materialize(cost), edges, priors, kind, delta, min_gain, halvings)
    if not report:
        return poses
    more = F.coalesce(F.col("promised") > min_gain * F.greatest("cost", F.lit(1e-12)), F.lit(True))
    stalled = ~F.col("moved") & more
    return poses, cost.select(
        "map_id", "cost", "steps", "gradient", "residual", "promised",
        stalled.alias("stalled"), (~F.col("active") & ~stalled).alias("converged"),
    )


def _take_step(poses, step, cost, edges, priors, kind, delta, min_gain, halvings):
    """Apply the step map by map, halving it where the objective would rise."""
    todo, scale = cost.filter("active").select("map_id", "cost"), 1.0
    taken = None
    for _ in range(halvings + 1):
        moved = poses.join(todo.select("map_id"), "map_id", "left_semi").join(step, NODE)
        moved = bind(moved, "_x", F.transform("x", lambda v: v * F.lit(scale)))
        moved = bind(moved, "_s", step_pose(F.col("_x")))
        moved = materialize(moved.select(*NODE, pose_compose("pose", "_s").alias("pose")))
        now = objective(edges.join(todo, "map_id", "left_semi"), moved, priors, kind, delta)
        judged = materialize(
            now.withColumnRenamed("cost", "_new").join(todo, "map_id").withColumn("ok", F.col("_new") <= F.col("cost"))
        )
        good = judged.filter("ok")
        part = moved.join(good.select("map_id"), "map_id", "left_semi")
        gain = good.select(
            "map_id", F.col("_new").alias("_cost"),
            ((F.col("cost") - F.col("_new")) > min_gain * F.greatest(F.col("cost"), F.lit(1e-12))).alias("_go"),
        )
        taken = (part, gain) if taken is None else (taken[0].unionByName(part), taken[1].unionByName(gain))
        todo = judged.filter("not ok").select("map_id", "cost")
        if todo.isEmpty():
            break
        scale /= 2
    part, gain = taken
    new_poses = poses.join(part.withColumnRenamed("pose", "_p"), NODE, "left").select(
        *NODE, F.coalesce("_p", "pose").alias("pose")
    )
    new_cost = cost.join(gain, "map_id", "left").select(
        "map_id",
        F.coalesce("_cost", "cost").alias("cost"),
        "steps",
        "gradient",
        "residual",
        "promised",
        (F.col("active") & F.coalesce("_go", F.lit(False))).alias("active"),
        # An active map without a gain found no step that does not raise its objective.
        F.when(F.col("active"), F.col("_go").isNotNull()).otherwise(F.col("moved")).alias("moved"),
    )
    return materialize(new_poses), materialize(new_cost)


def keep_last_good(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per map the candidate poses, or the previous ones if any candidate is missing or not finite."""
    joined = previous.select(*NODE, F.col("pose").alias("_old")).join(
        candidate.select(*NODE, F.col("pose").alias("_new")), NODE, "left"
    )
    bad = joined.groupBy("map_id").agg(
        F.bool_or(F.col("_new").isNull() | ~is_finite_pose("_new")).alias("_bad")
    )
    return joined.join(bad, "map_id").select(
        *NODE, F.when(F.col("_bad"), F.col("_old")).otherwise(F.col("_new")).alias("pose"),
        F.col("_bad").alias("reverted"),
    )
