"""Primitives of one drawing, in numpy. Kernels see plain Python objects and never Spark."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import acos, atan2, ceil, cos, hypot, pi, sin

import numpy as np

from linework.schema import NODE_DECIMALS, SAGITTA, UNKNOWN

TAU = 2 * pi
Point = tuple[float, float]


@dataclass(frozen=True)
class Prim:
    """kind line: ends; arc: centre, radius, angles, direction; circle; ellipse: centre, axis, ratio, parameters; spline."""

    kind: str
    p: tuple[float, ...] = ()
    ccw: bool = True
    degree: int = 3
    ctrl: tuple[Point, ...] = ()
    knots: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    samples: tuple[Point, ...] = ()


@dataclass(frozen=True)
class Edge:
    id: int
    prim: Prim
    role: str = UNKNOWN
    style: object = None
    n0: Point = (0.0, 0.0)
    n1: Point = (0.0, 0.0)
    parent: int | None = None
    sampled: tuple[Point, ...] = field(default=(), compare=False)

    @property
    def loop(self) -> bool:
        return self.n0 == self.n1


def node(p) -> Point:
    return (round(float(p[0]), NODE_DECIMALS) + 0.0, round(float(p[1]), NODE_DECIMALS) + 0.0)


def line(a, b) -> Prim:
    return Prim("line", (float(a[0]), float(a[1]), float(b[0]), float(b[1])))


def arc(c, r: float, a0: float, a1: float, ccw: bool = True) -> Prim:
    return Prim("arc", (float(c[0]), float(c[1]), float(r), float(a0), float(a1)), ccw)


def circle(c, r: float) -> Prim:
    return Prim("circle", (float(c[0]), float(c[1]), float(r)))


def edge(id_: int, prim: Prim, role: str = UNKNOWN, style: object = None, parent: int | None = None) -> Edge:
    pts = sample(prim)
    return Edge(id_, prim, role, style, node(pts[0]), node(pts[-1]), parent, pts)


def with_prim(e: Edge, prim: Prim) -> Edge:
    pts = sample(prim)
    return replace(e, prim=prim, n0=node(pts[0]), n1=node(pts[-1]), sampled=pts)


def sweep(a0: float, a1: float, ccw: bool) -> float:
    way = a1 - a0 if ccw else a0 - a1
    turn = way % TAU
    return TAU if turn < 1e-9 and abs(way) > 1e-9 else turn


def prim_from_row(s: dict) -> Prim:
    """From a segment struct of a table."""
    pts = lambda v: tuple((q["x"], q["y"]) for q in v) if v is not None else ()
    k = s["kind"]
    if k == "line":
        return Prim("line", (s["x0"], s["y0"], s["x1"], s["y1"]))
    if k == "arc":
        return Prim("arc", (s["cx"], s["cy"], s["r"], s["a0"], s["a1"]), bool(s["ccw"]))
    if k == "circle":
        return Prim("circle", (s["cx"], s["cy"], s["r"]))
    if k == "ellipse":
        return Prim("ellipse", (s["cx"], s["cy"], s["mx"], s["my"], s["ratio"], s["a0"], s["a1"]), bool(s["ccw"]))
    some = lambda v: tuple(v) if v is not None else ()
    return Prim("spline", (), True, int(s["degree"] or 3), pts(s["ctrl"]), some(s["knots"]), some(s["weights"]), pts(s["samples"]))


def arc_at(q: Prim, t: float) -> Point:
    """Point after the share t of an arc, circle or ellipse."""
    if q.kind == "circle":
        return (q.p[0] + q.p[2] * cos(t * TAU), q.p[1] + q.p[2] * sin(t * TAU))
    way = 1 if q.ccw else -1
    if q.kind == "arc":
        cx, cy, r, a0, a1 = q.p
        a = a0 + way * t * sweep(a0, a1, q.ccw)
        return (cx + r * cos(a), cy + r * sin(a))
    x, y = ellipse_at(q, np.array([t]))[0]
    return (float(x), float(y))


def spline_at(q: Prim, ts) -> np.ndarray:
    """De Boor's algorithm for many parameters at once; weighted curves are evaluated in homogeneous coordinates."""
    ts = np.asarray(ts, float)
    w = np.asarray(q.weights, float) if q.weights else np.ones(len(q.ctrl))
    c = np.column_stack([np.asarray(q.ctrl, float) * w[:, None], w])
    k, d = np.asarray(q.knots, float), q.degree
    span = np.clip(np.searchsorted(k, ts, side="right") - 1, d, len(c) - 1)
    level = np.stack([c[span - d + j] for j in range(d + 1)], axis=1)
    for r in range(1, d + 1):
        for j in range(d, r - 1, -1):
            lo, hi = k[span - d + j], k[span + 1 + j - r]
            a = np.where(hi > lo, (ts - lo) / np.where(hi > lo, hi - lo, 1), 0)[:, None]
            level[:, j] = (1 - a) * level[:, j - 1] + a * level[:, j]
    return level[:, d, :2] / level[:, d, 2:]


def refined(at, lo: float, hi: float, n: int, tolerance: float, depth: int = 8, most: int = 400) -> list[Point]:
    """Even samples, halved where the middle of a step is further than tolerance from its chord. at takes an array of
    parameters and gives their points; each round looks at all steps at once."""
    ts = np.linspace(lo, hi, n + 1)
    pts = at(ts)
    for _ in range(depth):
        mid = (ts[:-1] + ts[1:]) / 2
        m, a, d = at(mid), pts[:-1], pts[1:] - pts[:-1]
        square = (d * d).sum(1)
        k = np.clip(np.divide(((m - a) * d).sum(1), square, out=np.zeros(len(mid)), where=square > 0), 0, 1)
        wide = np.flatnonzero(np.hypot(*(m - a - k[:, None] * d).T) > tolerance)
        if not len(wide) or len(ts) >= most:
            break
        ts, pts = np.insert(ts, wide + 1, mid[wide]), np.insert(pts, wide + 1, m[wide], axis=0)
    return [(float(x), float(y)) for x, y in pts]


def ellipse_at(q: Prim, t: np.ndarray) -> np.ndarray:
    """Points after the shares t of an ellipse."""
    cx, cy, mx, my, ratio, a0, a1 = q.p
    a = a0 + (1 if q.ccw else -1) * t * sweep(a0, a1, q.ccw)
    return np.column_stack([cx + mx * np.cos(a) - my * ratio * np.sin(a), cy + my * np.cos(a) + mx * ratio * np.sin(a)])


def sample(q: Prim, tolerance: float = SAGITTA) -> tuple[Point, ...]:
    if q.kind == "line":
        return ((q.p[0], q.p[1]), (q.p[2], q.p[3]))
    if q.kind in ("arc", "circle"):
        r, turn = q.p[2], TAU if q.kind == "circle" else sweep(q.p[3], q.p[4], q.ccw)
        if not (np.isfinite(r) and np.isfinite(turn)):
            return ((r, turn), (r, turn))
        step = 2 * acos(max(-1.0, 1 - tolerance / r)) if r > tolerance else pi / 18
        n = min(128, max(64, ceil(turn / step))) if q.kind == "circle" else max(32, ceil(turn / step))
        return tuple(arc_at(q, i / n) for i in range(n + 1))
    if q.kind == "ellipse":
        return tuple(refined(lambda t: ellipse_at(q, t), 0.0, 1.0, 32, tolerance))
    if q.samples:
        return q.samples
    if len(q.ctrl) > q.degree and len(q.knots) == len(q.ctrl) + q.degree + 1:
        lo, hi = q.knots[q.degree], q.knots[len(q.ctrl)]
        return tuple(refined(lambda t: spline_at(q, t), lo, hi, min(100, 4 * len(q.ctrl)), tolerance))
    return q.ctrl or ((float("nan"), float("nan")),) * 2


def length(q: Prim) -> float:
    if q.kind == "line":
        return hypot(q.p[2] - q.p[0], q.p[3] - q.p[1])
    if q.kind == "arc":
        return q.p[2] * sweep(q.p[3], q.p[4], q.ccw)
    if q.kind == "circle":
        return TAU * q.p[2]
    return path_length(sample(q))


def path_length(pts) -> float:
    a = np.asarray(pts, float)
    return float(np.hypot(*(a[1:] - a[:-1]).T).sum()) if len(a) > 1 else 0.0


def reverse(q: Prim) -> Prim:
    if q.kind == "line":
        return replace(q, p=(*q.p[2:], *q.p[:2]))
    if q.kind == "arc":
        return replace(q, p=(*q.p[:3], q.p[4], q.p[3]), ccw=not q.ccw)
    if q.kind == "ellipse":
        return replace(q, p=(*q.p[:5], q.p[6], q.p[5]), ccw=not q.ccw)
    if q.kind == "spline":
        both = q.knots[0] + q.knots[-1] if q.knots else 0
        return replace(q, ctrl=q.ctrl[::-1], weights=q.weights[::-1], samples=q.samples[::-1], knots=tuple(both - k for k in q.knots[::-1]))
    return q


def to_segment(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def to_path(p, pts) -> float:
    """Distance from a point to a run of points."""
    a = np.asarray(pts, float)
    d, e = a[1:] - a[:-1], np.asarray(p, float) - a[:-1]
    n = (d * d).sum(1)
    t = np.clip(np.divide((d * e).sum(1), n, out=np.zeros(len(n)), where=n > 0), 0, 1)
    return float(np.hypot(*(e - t[:, None] * d).T).min()) if len(a) > 1 else hypot(*(np.asarray(p) - a[0]))


def area(ring) -> float:
    """Signed, positive counter-clockwise; taken around the first point."""
    a = np.asarray(ring, float)
    if len(a) < 3:
        return 0.0
    x, y = (a - a[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def inside(p, ring) -> bool:
    """Even-odd rule."""
    a = np.asarray(ring, float)
    b = np.roll(a, -1, axis=0)
    hit = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((hit & (p[0] < x)).sum() % 2)


def close_ring(pts) -> list[Point]:
    """Without the repeated last point."""
    out = [tuple(p) for p in pts]
    return out[:-1] if len(out) > 1 and hypot(out[0][0] - out[-1][0], out[0][1] - out[-1][1]) < 1e-9 else out


def ring_contains(outer, inner, slack: float = 0.0) -> bool:
    """Every point of inner lies in outer, or within slack of its border."""
    border = [*outer, outer[0]]
    return all(inside(p, outer) or (slack > 0 and to_path(p, border) <= slack) for p in inner)


def angle_of(q: Prim, p) -> float:
    """Share of an arc's or circle's turn at which it points to p."""
    a0 = q.p[3] if q.kind == "arc" else 0.0
    to = atan2(p[1] - q.p[1], p[0] - q.p[0])
    turn = sweep(q.p[3], q.p[4], q.ccw) if q.kind == "arc" else TAU
    return ((to - a0 if q.ccw else a0 - to) % TAU) / turn


def meet(a: Prim, b: Prim) -> list[Point]:
    """Points where two primitives cross or touch; sampled curves are met chord by chord; overlaps give none."""
    if a.kind in ("line", "arc", "circle") and b.kind in ("line", "arc", "circle"):
        if a.kind == b.kind == "line":
            p = lines_meet(a.p, b.p)
            found = [p] if p else []
        elif a.kind == "line":
            found = circle_meets_line(b.p[:3], a.p)
        elif b.kind == "line":
            found = circle_meets_line(a.p[:3], b.p)
        else:
            found = circles_meet(a.p[:3], b.p[:3])
        return [p for p in found if on(a, p) and on(b, p)]
    out: list[Point] = []
    for c in chords(a):
        for d in chords(b):
            p = lines_meet(c, d)
            if p and on(Prim("line", c), p) and on(Prim("line", d), p) and all(hypot(p[0] - q[0], p[1] - q[1]) > 1e-4 for q in out):
                out.append(p)
    return out


def chords(q: Prim) -> list[tuple[float, ...]]:
    s = sample(q, 1e-4) if q.kind in ("ellipse",) else sample(q)
    return [(*a, *b) for a, b in zip(s, s[1:])]


def on(q: Prim, p, slack: float = 1e-7) -> bool:
    if q.kind == "line":
        return to_segment(p, q.p[:2], q.p[2:]) <= slack
    if q.kind == "circle":
        return True
    t = angle_of(q, p)
    turn = sweep(q.p[3], q.p[4], q.ccw) * q.p[2]
    return t * turn <= turn + slack or TAU * q.p[2] - t * turn <= slack


def lines_meet(s, t) -> Point | None:
    """Of the infinite lines through two segments."""
    dx, dy, ex, ey = s[2] - s[0], s[3] - s[1], t[2] - t[0], t[3] - t[1]
    det = dx * ey - dy * ex
    if abs(det) <= 1e-10:
        return None
    k = ((t[0] - s[0]) * ey - (t[1] - s[1]) * ex) / det
    return (s[0] + k * dx, s[1] + k * dy)


def circle_meets_line(c, s) -> list[Point]:
    dx, dy = s[2] - s[0], s[3] - s[1]
    n = dx * dx + dy * dy
    if n == 0:
        return []
    t = ((c[0] - s[0]) * dx + (c[1] - s[1]) * dy) / n
    f = (s[0] + t * dx, s[1] + t * dy)
    rest = c[2] ** 2 - (f[0] - c[0]) ** 2 - (f[1] - c[1]) ** 2
    if rest < -1e-9:
        return []
    h = (max(rest, 0.0) / n) ** 0.5
    return [f] if rest <= 1e-9 else [(f[0] - h * dx, f[1] - h * dy), (f[0] + h * dx, f[1] + h * dy)]


def circles_meet(a, b) -> list[Point]:
    d = hypot(b[0] - a[0], b[1] - a[1])
    if d <= 1e-10:
        return []
    along = (a[2] ** 2 - b[2] ** 2 + d * d) / (2 * d)
    rest = a[2] ** 2 - along**2
    if rest < -1e-9:
        return []
    mx, my, h = a[0] + along * (b[0] - a[0]) / d, a[1] + along * (b[1] - a[1]) / d, max(rest, 0.0) ** 0.5
    ux, uy = (b[1] - a[1]) / d * h, (b[0] - a[0]) / d * h
    return [(mx, my)] if rest <= 1e-9 else [(mx + ux, my - uy), (mx - ux, my + uy)]


def piece(q: Prim, t0: float, t1: float) -> Prim:
    """The part of a line, arc or circle between two shares of its length."""
    if q.kind == "line":
        at = lambda t: (q.p[0] + t * (q.p[2] - q.p[0]), q.p[1] + t * (q.p[3] - q.p[1]))
        return line(at(t0), at(t1))
    a0, turn = (q.p[3], sweep(q.p[3], q.p[4], q.ccw)) if q.kind == "arc" else (0.0, TAU)
    way = 1 if q.ccw else -1
    return arc(q.p[:2], q.p[2], a0 + way * t0 * turn, a0 + way * t1 * turn, q.ccw)


def share_at(q: Prim, p) -> float:
    if q.kind == "line":
        dx, dy = q.p[2] - q.p[0], q.p[3] - q.p[1]
        n = dx * dx + dy * dy
        return ((p[0] - q.p[0]) * dx + (p[1] - q.p[1]) * dy) / n if n else 0.0
    return angle_of(q, p)


def rotate(q: Prim, a: float, o: Point = (0.0, 0.0)) -> Prim:
    def turn(x, y):
        return (o[0] + (x - o[0]) * cos(a) - (y - o[1]) * sin(a), o[1] + (x - o[0]) * sin(a) + (y - o[1]) * cos(a))

    if q.kind == "line":
        return line(turn(*q.p[:2]), turn(*q.p[2:]))
    if q.kind in ("arc", "circle"):
        return replace(q, p=(*turn(*q.p[:2]), q.p[2], *[x + a for x in q.p[3:]]))
    if q.kind == "ellipse":
        return replace(q, p=(*turn(*q.p[:2]), q.p[2] * cos(a) - q.p[3] * sin(a), q.p[2] * sin(a) + q.p[3] * cos(a), *q.p[4:]))
    return replace(q, ctrl=tuple(turn(*c) for c in q.ctrl), samples=tuple(turn(*c) for c in q.samples))
