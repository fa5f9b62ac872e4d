"""Plain versions of the route operators, point by point, for small maps."""

from __future__ import annotations

import math


def wrap(a):
    return math.atan2(math.sin(a), math.cos(a))


def lengths(pts):
    out = [0.0]
    for a, b in zip(pts, pts[1:], strict=False):
        out.append(out[-1] + math.dist(a, b))
    return out


def at_length(pts, cum, target):
    """(point, nearer index) at an arc length."""
    i = next((i for i in range(len(pts) - 1) if cum[i + 1] >= target and cum[i + 1] > cum[i]), len(pts) - 2)
    t = min(1.0, max(0.0, (target - cum[i]) / (cum[i + 1] - cum[i])))
    return tuple(a + (b - a) * t for a, b in zip(pts[i], pts[i + 1], strict=True)), i if t < 0.5 else i + 1


def shape(pts):
    """Headings and curvatures."""
    turn = [math.atan2(b[1] - a[1], b[0] - a[0]) for a, b in zip(pts, pts[1:], strict=False)]

    def bend(a, b, c):
        whole = math.dist(a, b) * math.dist(b, c) * math.dist(a, c)
        return 2 * ((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])) / whole if whole > 1e-9 else 0.0

    inner = [bend(*pts[i - 1 : i + 2]) for i in range(1, len(pts) - 1)]
    return [*turn, turn[-1]], [inner[0], *inner, inner[-1]] if inner else [0.0] * len(pts)


def lane(pts):
    """Samples at about 1 m: points and their arc lengths."""
    cum = lengths(pts)
    n = max(2, math.floor(cum[-1]) + 1)
    out = [at_length(pts, cum, cum[-1] * i / (n - 1))[0] for i in range(n)]
    return out, lengths(out)


def nearest(p, pts):
    """(distance, place, segment, share) of the nearest place on a polyline."""
    best = (math.inf, None, None, None)
    for i, (a, b) in enumerate(zip(pts, pts[1:], strict=False)):
        u = (b[0] - a[0], b[1] - a[1])
        t = min(1.0, max(0.0, ((p[0] - a[0]) * u[0] + (p[1] - a[1]) * u[1]) / (u[0] ** 2 + u[1] ** 2)))
        q = (a[0] + u[0] * t, a[1] + u[1] * t)
        if math.dist(p, q) < best[0]:
            best = (math.dist(p, q), q, i, t)
    return best


def reference_path(lanes, route, start_s, step=0.5):
    """lanes: lane -> points; route: (lane, changed). (x, y, heading, curvature, lane) of each sample."""
    raw = []
    for k, (own, changed) in enumerate(route):
        pts, cum = lane(lanes[own])
        for p, s in zip(pts, cum, strict=True):
            if k == 0 and s < max(0.0, start_s - 2.0):
                continue
            if k and changed:
                gap, q, *_ = nearest(p, lane(lanes[route[k - 1][0]])[0])
                if gap < 12:
                    w = min(1.0, s / 25.0)
                    w = w * w * (3 - 2 * w)
                    p = (q[0] * (1 - w) + p[0] * w, q[1] * (1 - w) + p[1] * w)
            if not raw or math.dist(raw[-1][0], p) >= 0.05:
                raw.append((p, own))
    pts = [p for p, _ in raw]
    for _ in range(2):
        pts = [p if i in (0, len(pts) - 1) else tuple(a / 4 + b / 2 + c / 4 for a, b, c in zip(pts[i - 1], p, pts[i + 1], strict=True)) for i, p in enumerate(pts)]
    cum = lengths(pts)
    if cum[-1] < 2 * step:
        return []
    found = [at_length(pts, cum, min(cum[-1], i * step)) for i in range(math.floor(cum[-1] / step) + 1)]
    out = [p for p, _ in found]
    heading, curve = shape(out)
    curve = [c if i in (0, len(curve) - 1) else curve[i - 1] / 4 + c / 2 + curve[i + 1] / 4 for i, c in enumerate(curve)]
    return [(*p, h, c, raw[i][1]) for p, h, c, (_, i) in zip(out, heading, curve, found, strict=True)]


def frenet(path, x, y, step=0.5):
    pts = [p[:2] for p in path]
    i = min(range(len(pts)), key=lambda k: (x - pts[k][0]) ** 2 + (y - pts[k][1]) ** 2)
    low = max(0, i - 1)
    _, q, seg, t = nearest((x, y), pts[low : min(len(pts), i + 2)])
    a, b = pts[low + seg], pts[low + seg + 1]
    side = (b[0] - a[0]) * (y - q[1]) - (b[1] - a[1]) * (x - q[0])
    return (low + seg + t) * step, side / math.dist(a, b)
