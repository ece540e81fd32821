"""Pose arithmetic as SQL text, for the checking queries."""

from lidarlake.schema import POSE_FIELDS


def cols(prefix):
    return [f"{prefix}{f}" for f in POSE_FIELDS]


def named(exprs, prefix):
    return ", ".join(f"{e} as {prefix}{f}" for e, f in zip(exprs, POSE_FIELDS, strict=True))


def rounded(exprs, prefix):
    return ", ".join(f"{r6(e)} as {prefix}{f}" for e, f in zip(exprs, POSE_FIELDS, strict=True))


def r6(e):
    """Six digits, without negative zero."""
    return f"(round({e}, 6) + 0e0)"


def rotate(q, v):
    x, y, z, w = q
    a, b, c = v
    ux, uy, uz = f"(2*({y}*{c}-{z}*{b}))", f"(2*({z}*{a}-{x}*{c}))", f"(2*({x}*{b}-{y}*{a}))"
    return (
        f"({a}+{w}*{ux}+({y}*{uz}-{z}*{uy}))",
        f"({b}+{w}*{uy}+({z}*{ux}-{x}*{uz}))",
        f"({c}+{w}*{uz}+({x}*{uy}-{y}*{ux}))",
    )


def transform(p, v):
    return [f"({r}+{t})" for r, t in zip(rotate(p[3:], v), p[:3])]


def compose(a, b):
    t = [f"({r}+{s})" for r, s in zip(rotate(a[3:], b[:3]), a[:3])]
    ax, ay, az, aw = a[3:]
    bx, by, bz, bw = b[3:]
    return t + [
        f"({aw}*{bx}+{ax}*{bw}+{ay}*{bz}-{az}*{by})",
        f"({aw}*{by}-{ax}*{bz}+{ay}*{bw}+{az}*{bx})",
        f"({aw}*{bz}+{ax}*{by}-{ay}*{bx}+{az}*{bw})",
        f"({aw}*{bw}-{ax}*{bx}-{ay}*{by}-{az}*{bz})",
    ]


def inverse(p):
    q = [f"(-{p[3]})", f"(-{p[4]})", f"(-{p[5]})", p[6]]
    return [f"(-{r})" for r in rotate(q, p[:3])] + q


def between(a, b):
    return compose(inverse(a), b)


def angle(p):
    x, y, z, w = p[3:]
    return f"(2*atan2(sqrt({x}*{x}+{y}*{y}+{z}*{z}), abs({w})))"


def norm(p):
    return f"sqrt({p[0]}*{p[0]}+{p[1]}*{p[1]}+{p[2]}*{p[2]})"


def yaw(p):
    x, y, z, w = p[3:]
    return f"atan2(2*({w}*{z}+{x}*{y}), 1-2*({y}*{y}+{z}*{z}))"
