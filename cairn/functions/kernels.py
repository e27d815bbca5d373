"""Planar geometry in numpy, for use inside Arrow batches. A polygon is a list of closed (n, 2) rings; a region a list of polygons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from cairn.functions.arrangement import arrange, cross, meeting, outline, ring_area

Ring = np.ndarray
Polygon = list[Ring]


def area(ring: Ring) -> float:
    """Signed area, positive where the inside is on the left; measured from a corner, so that places far from the origin lose nothing."""
    return ring_area(ring)


def polygon_area(polygon: Polygon) -> float:
    return abs(area(polygon[0])) - sum(abs(area(h)) for h in polygon[1:])


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker: keep the farthest point of each stretch that lies beyond the tolerance from its chord."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, between = points[b] - points[a], points[a + 1 : b] - points[a]
        length = float(np.dot(chord, chord))
        along = np.clip(between @ chord / length, 0, 1) if length else np.zeros(len(between))
        far = np.hypot(*(between - along[:, None] * chord).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def inside(points: np.ndarray, region: list[Polygon], at_once: int = 1 << 21) -> np.ndarray:
    """Whether each point lies in some polygon of the region (even-odd over its rings); few pairs of a point and a side at a time."""
    found = np.zeros(len(points), bool)
    for polygon in region:
        p, q = (np.concatenate([r[s] for r in polygon]) for s in (slice(None, -1), slice(1, None)))
        step = max(1, at_once // max(len(p), 1))
        for i in range(0, len(points), step):
            x, y = points[i : i + step, :1], points[i : i + step, 1:]
            rising = (p[:, 1] > y) != (q[:, 1] > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = (q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0]
            found[i : i + step] |= (rising & (x < at)).sum(1) % 2 == 1
    return found


def _edges(rings: list[Ring]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all sides that have a length."""
    rings = [r for r in rings if len(r) > 1]
    if not rings:
        return np.zeros((0, 2)), np.zeros((0, 2))
    p, q = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    solid = (p != q).any(1)
    return p[solid], q[solid]


def _turned(polygon: Polygon) -> Polygon:
    """A valid polygon with its inside on the left of every ring."""
    return [r if (area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(polygon)]


def oriented(polygon: Polygon) -> list[Polygon]:
    """The polygon with its inside on the left of every ring; an invalid one is rebuilt by the even-odd rule."""
    if len(polygon) == 1 and convex(polygon[0]) or invalid_reason("Polygon", polygon) is None:
        return [_turned(polygon)]
    return overlay([polygon], [], lambda x, y: x)


def overlay(a: list[Polygon], b: list[Polygon], wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[Polygon]:
    """Polygons of the points where ``wanted(in a, in b)`` holds. One polygon is taken by the even-odd rule, several as their union."""
    sides, rules = [], []
    for region in (a, b):
        if len(region) > 1:
            region = [p for polygon in region for p in oriented(polygon)]
            rules.append(lambda times: times > 0)
        else:
            rules.append(lambda times: times % 2 == 1)
        sides.append(_edges([r for polygon in region for r in polygon]))
    p, q = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
    if not len(p):
        return []
    layer = np.repeat(np.eye(2, dtype=np.int64), [len(s[0]) for s in sides], axis=0)
    met = arrange(p, q, layer)
    left, right = (wanted(rules[0](x[:, 0]), rules[1](x[:, 1])) for x in (met.left, met.right))
    return outline(met, left, right)


def as_box(ring: Ring) -> tuple[float, float, float, float] | None:
    """(x0, y0, x1, y1) of a ring that is a rectangle along the axes; null for others."""
    if len(ring) != 5:
        return None
    (ax, ay), (bx, by), (cx, cy), (dx, dy), (ex, ey) = ring.tolist()
    flat = ax == dx and bx == cx and ay == by and cy == dy or ax == bx and cx == dx and ay == dy and by == cy
    return (min(ax, cx), min(ay, cy), max(ax, cx), max(ay, cy)) if flat and (ax, ay) == (ex, ey) and ax != cx and ay != cy else None


def intersection(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    if len(a) == len(b) == len(a[0]) == len(b[0]) == 1:
        one, other = as_box(a[0][0]), as_box(b[0][0])
        if one and other:
            x0, y0, x1, y1 = max(one[0], other[0]), max(one[1], other[1]), min(one[2], other[2]), min(one[3], other[3])
            return [[box(x0, y0, x1, y1)]] if x0 < x1 and y0 < y1 else []
    if len(a) == len(b) == len(a[0]) == len(b[0]) == 1 and convex(a[0][0]) and convex(b[0][0]):
        frame = b[0][0] if area(b[0][0]) > 0 else b[0][0][::-1]
        both = clip_convex(a[0][0] if area(a[0][0]) > 0 else a[0][0][::-1], frame)
        size = float(np.ptp(np.concatenate([a[0][0], b[0][0]]), axis=0).max())
        return [[both]] if len(both) and area(both) > 1e-12 * size * size else []
    return overlay(a, b, np.logical_and)


def difference(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    return overlay(a, b, lambda x, y: x & ~y)


def union(region: list[Polygon]) -> list[Polygon]:
    if len(region) == 1 and len(region[0]) == 1 and convex(region[0][0]):
        return region
    return overlay(region, [], lambda x, y: x)


def clip_line(line: np.ndarray, region: list[Polygon], closed: bool = False) -> list[np.ndarray]:
    """Stretches of a line inside a region. Of stretches along its outline, all with ``closed``, else those with it on their right
    hand in the sweep, so that regions side by side share none."""
    p, q = _edges([r for polygon in region for r in polygon])
    s, e = _edges([line])
    if not len(p) or not len(s):
        return []
    met = arrange(np.concatenate([s, p]), np.concatenate([e, q]), np.repeat([0, 1], [len(s), len(p)])[:, None])
    owner, start, stop, piece = met.steps
    yes = met.right[piece, 0] % 2 == 1
    if closed:
        yes |= met.left[piece, 0] % 2 == 1
    mine = np.flatnonzero(owner < len(s))  # in the order of the line
    out: list[list[int]] = []
    for k in mine[yes[mine]].tolist():
        if out and out[-1][-1] == start[k]:
            out[-1].append(stop[k])
        else:
            out.append([start[k], stop[k]])
    return [met.place[x] for x in out]


def on_outline(point: np.ndarray, rings: list[np.ndarray]) -> bool:
    """Whether a point lies on one of the lines, or is one of the points."""
    for ring in rings:
        if (np.abs(ring - point).max(1) == 0).any():
            return True
        p, d = ring[:-1], np.diff(ring, axis=0)
        if len(d):
            w, length = point - p, np.hypot(d[:, 0], d[:, 1])
            along = (w * d).sum(1)
            if ((np.abs(d[:, 0] * w[:, 1] - d[:, 1] * w[:, 0]) <= 1e-9 * length * np.maximum(length, 1e-300)) & (along >= 0) & (along <= length**2)).any():
                return True
    return False


def touches(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(stretches, points) that the lines of a and those of b share; points on a shared stretch are not named again."""
    (p, q), (u, v) = _edges(a), _edges(b)
    if not len(p) or not len(u):
        return [], []
    met = arrange(np.concatenate([p, u]), np.concatenate([q, v]), np.repeat(np.eye(2, dtype=np.int64), [len(p), len(u)], axis=0))
    owner, start, stop, piece = met.steps
    of_a, of_b = owner < len(p), owner >= len(p)
    shared = np.intersect1d(piece[of_a], piece[of_b])
    on_both = np.intersect1d(np.concatenate([start[of_a], stop[of_a]]), np.concatenate([start[of_b], stop[of_b]]))
    alone = np.setdiff1d(on_both, np.concatenate([met.low[shared], met.high[shared]]))
    return [straight(met.place[x]) for x in _chained(met.low[shared], met.high[shared])], list(met.place[alone])


def straight(line: np.ndarray) -> np.ndarray:
    """A line without points that lie straight between their neighbours."""
    step = np.diff(line, axis=0)
    bend = np.abs(cross(step[:-1], step[1:])) > 1e-9 * np.hypot(*step[:-1].T) * np.hypot(*step[1:].T)
    return line[np.concatenate([[True], bend, [True]])]


def _chained(low: np.ndarray, high: np.ndarray) -> list[list[int]]:
    """Pieces chained end to end into lines, each piece once; a line goes on where just two pieces meet."""
    ways: dict[int, list[int]] = {}
    ends = list(zip(low.tolist(), high.tolist(), strict=True))
    for k, pair in enumerate(ends):
        for x in pair:
            ways.setdefault(x, []).append(k)
    used = [False] * len(ends)

    def walk(at: int, k: int) -> list[int]:
        line = [at]
        while True:
            used[k] = True
            at = ends[k][0] if ends[k][1] == at else ends[k][1]
            line.append(at)
            more = [x for x in ways[at] if not used[x]]
            if len(ways[at]) != 2 or not more:
                return line
            k = more[0]

    tips = [x for x, at in ways.items() if len(at) != 2]
    lines = [walk(x, k) for x in tips for k in ways[x] if not used[k]]
    return lines + [walk(ends[k][0], k) for k in range(len(ends)) if not used[k]]


def clip_convex(ring: Ring, corners: Ring) -> Ring:
    """Sutherland and Hodgman: a ring cut by the half-planes left of the edges of a convex counter-clockwise ring."""
    out = ring[:-1]
    for a, b in zip(corners[:-1], corners[1:], strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        points = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                points.append(out[i])
            if (side[i] >= 0) != (side[j] >= 0) and side[i] != side[j]:
                points.append(out[i] + side[i] / (side[i] - side[j]) * (out[j] - out[i]))
        out = np.array(points).reshape(-1, 2)
    return np.concatenate([out, out[:1]]) if len(out) >= 3 else np.zeros((0, 2))


def half_plane(polygon: Polygon, axis: int, at: float, below: bool) -> list[Polygon]:
    """The parts of a polygon on one side of a line along an axis."""
    frame = as_box(polygon[0]) if len(polygon) == 1 else None
    if frame:
        low, high = list(frame[:2]), list(frame[2:])
        if below:
            high[axis] = min(high[axis], at)
        else:
            low[axis] = max(low[axis], at)
        return [[box(*low, *high)]] if low[axis] < high[axis] else []
    if len(polygon) == 1 and convex(polygon[0]):
        core = polygon[0][:-1]
        depth = (at - core[:, axis]) * (1 if below else -1)
        after, deeper = np.roll(core, -1, axis=0), np.roll(depth, -1)
        cut = (depth > 0) != (deeper > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            met = core + (depth / (depth - deeper))[:, None] * (after - core)
        met[:, axis] = at
        both, kept = np.stack([core, met], axis=1), np.stack([depth > 0, cut & (depth != 0) & (deeper != 0)], axis=1)
        kept[:, 0] |= (depth == 0) & ((deeper > 0) | (np.roll(depth, 1) > 0))
        ring = both[kept]
        return [[np.concatenate([ring, ring[:1]])]] if len(ring) >= 3 else []
    low, high = polygon[0].min(0) - 1, polygon[0].max(0) + 1
    if below:
        high[axis] = at
    else:
        low[axis] = at
    return intersection([polygon], [[box(*low, *high)]]) if (low < high).all() else []


def into_cells(polygon: Polygon, side: float) -> Iterator[tuple[int, int, Polygon]]:
    """(cx, cy, part) of a polygon in each square cell it has area in. Halves are cut in half again, so that a cell costs about its own points.

    What reaches less than a millionth of a cell beyond a border, as cuts may by rounding, belongs to the cell it comes from.
    """
    todo = [polygon]
    while todo:
        part = todo.pop()
        low, high = part[0].min(0) / side, part[0].max(0) / side
        first = np.floor(low + 1e-6)
        last = np.maximum(np.ceil(high - 1e-6) - 1, first)
        if (first == last).all():
            yield int(first[0]), int(first[1]), part
            continue
        axis = int(last[1] - first[1] > last[0] - first[0])
        at = (first[axis] + last[axis] + 1) // 2 * side
        todo += [half for below in (True, False) for half in half_plane(part, axis, at, below)]


def box(x0: float, y0: float, x1: float, y1: float) -> Ring:
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)


def circle(centre: np.ndarray, radius: float, quad_segs: int = 8) -> Ring:
    turn = np.arange(4 * quad_segs) * (np.pi / (2 * quad_segs))
    ring = centre + radius * np.column_stack([np.cos(turn), np.sin(turn)])
    return np.concatenate([ring, ring[:1]])


def convex(ring: Ring) -> bool:
    """Whether a closed ring turns one way only, once around."""
    step = np.diff(ring, axis=0)
    if len(step) < 3:
        return False
    after = np.roll(step, -1, axis=0)
    turn = np.arctan2(step[:, 0] * after[:, 1] - step[:, 1] * after[:, 0], (step * after).sum(1))
    return bool((step != 0).any(1).all()) and ((turn > 0).all() or (turn < 0).all()) and abs(abs(turn.sum()) - 2 * np.pi) < 1e-9


def around_convex(ring: Ring, distance: float, quad_segs: int) -> Ring:
    """Outline at a distance from a convex ring: its sides moved out, and an arc at each corner."""
    core = ring[:-1] if area(ring) > 0 else ring[-1:0:-1]
    side = np.roll(core, -1, axis=0) - core
    out = np.arctan2(-side[:, 0], side[:, 1])  # outward direction of the side that leaves each corner
    parts = []
    for corner, a, b in zip(core, np.roll(out, 1), out, strict=True):
        swing = (b - a) % (2 * np.pi)
        steps = max(1, int(np.ceil(swing / (np.pi / (2 * quad_segs)) - 1e-9)))
        turn = a + np.linspace(0, swing, steps + 1)
        parts.append(corner + distance * np.column_stack([np.cos(turn), np.sin(turn)]))
    outline = np.concatenate(parts)
    return np.concatenate([outline, outline[:1]])


def _around(kind: str, rings: list[np.ndarray], lines: list[Polygon], distance: float) -> list[Polygon]:
    """A buffer from what is around its lines."""
    if kind == "LineString":
        return union(lines)
    return union([*oriented(rings), *lines]) if distance > 0 else difference(oriented(rings), lines)


FLAT = 0.005  # dents less deep than this part of the distance are filled first, about what an arc of sides is short of a circle
STRETCH = 64  # sides of a stretch
MEETINGS = 1 << 20  # about as many places where a line beside a ring may meet itself; beyond, stretches go one by one


def filled(ring: Ring, depth: float, rounds: int = 8) -> Ring:
    """The ring without corners that turn right and lie within ``depth`` of their neighbours' chord, in rounds of a part of the depth each."""
    core = ring[:-1]
    for turn in range(rounds):
        if len(core) < 8:
            break
        before, after = np.roll(core, 1, axis=0), np.roll(core, -1, axis=0)
        chord = after - before
        side = cross(chord, core - before)  # a dent lies to the left of its chord
        dent = (side > 0) & (side <= depth / rounds * np.hypot(*chord.T))
        dent &= np.arange(len(core)) % 2 == turn % 2  # never two in a row
        dent[-1] &= not dent[0]
        core = core[~dent]
    return np.concatenate([core, core[:1]])


def beside(ring: Ring, distance: float, quad_segs: int = 8) -> Ring:
    """The closed line at ``distance`` on the right of a closed ring: sides moved out, an arc at each corner that turns left.

    At a corner that turns right, the moved sides end where they cross if both are long enough, else they go by way of
    the corner itself. Either way, what it goes around more often than the ring does, and never less often, is all within the distance on
    that side.
    """
    core = ring[:-1]
    core = core[(core != np.roll(core, 1, axis=0)).any(1)]
    n = len(core)
    if not n:
        return circle(ring[0], distance, quad_segs)
    out = _beside_all(_Rings(core, np.array([n]), np.zeros(1, np.int64)), distance, quad_segs).place
    return np.concatenate([out, out[:1]])


SIMPLE_SIDES, SIMPLE_RINGS = 64, 9  # of a polygon that is buffered with many others at once
SIDE_PAIRS = 1 << 20


class _Rings:
    """The rings of many polygons, each without its last point, in arrays: of each point its ring, its polygon and the points beside it."""

    def __init__(self, place: np.ndarray, sizes: np.ndarray, owner: np.ndarray):
        self.place, self.sizes, self.owner = place, sizes, owner
        self.first = np.cumsum(sizes) - sizes
        self.ring = np.repeat(np.arange(len(sizes)), sizes)
        self.of = owner[self.ring]
        n = np.arange(len(place))
        self.after, self.before = n + 1, n - 1
        self.after[self.first + sizes - 1] = self.first
        self.before[self.first] = self.first + sizes - 1
        self.side = place[self.after] - place
        self.length = np.hypot(*self.side.T)

    def areas(self) -> np.ndarray:
        at = self.place - self.place[self.first][self.ring]
        return np.add.reduceat(cross(at, at[self.after]), self.first) / 2

    def kept(self, keep: np.ndarray) -> _Rings:
        return _Rings(self.place[keep], np.add.reduceat(keep.astype(np.int64), self.first), self.owner)

    def apart(self, polygons: int) -> np.ndarray:
        """Of each polygon: no side has hardly any length, and sides come near one another only where one goes on in the next."""
        bounds = np.flatnonzero(np.append(True, self.of[1:] != self.of[:-1]))
        wide = np.ones(polygons)
        wide[self.of[bounds]] = (np.maximum.reduceat(self.place, bounds) - np.minimum.reduceat(self.place, bounds)).max(1)
        eps = 1e-8 * wide[self.of]
        good = np.ones(polygons, bool)
        good[self.of[self.length <= eps]] = False
        p, q, d = self.place, self.place[self.after], self.side
        low, high = np.minimum(p, q) - eps[:, None], np.maximum(p, q) + eps[:, None]
        many = np.repeat(np.append(bounds[1:], len(p)), np.diff(np.append(bounds, len(p)))) - np.arange(len(p)) - 1
        total, a = np.append(0, np.cumsum(many)), 0
        while a < len(p):
            b = max(a + 1, int(np.searchsorted(total, total[a] + SIDE_PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(a, b), many[a:b])
            j = i + 1 + np.arange(len(i)) - np.repeat(total[a:b] - total[a], many[a:b])
            for c in (0, 1):
                near = np.flatnonzero((low[i, c] <= high[j, c]) & (low[j, c] <= high[i, c]))
                i, j = i[near], j[near]
            next_to = (self.after[i] == j) | (self.after[j] == i)
            turn, along = cross(d[i], d[j]), (d[i] * d[j]).sum(1)
            wrong = next_to & (along < 0) & (np.abs(turn) <= 1e-9 * self.length[i] * self.length[j])
            clear = np.zeros(len(i), bool)
            for one, other in ((i, j), (j, i)):
                o1, o2, slack = cross(d[one], p[other] - p[one]), cross(d[one], q[other] - p[one]), eps[one] * self.length[one]
                clear |= ((o1 > slack) & (o2 > slack)) | ((o1 < -slack) & (o2 < -slack))
            good[self.of[i[wrong | (~next_to & ~clear)]]] = False
            a = b
        return good

    def nested(self, polygons: int) -> np.ndarray:
        """Of each polygon whose rings do not meet: the others lie in the first, and in none of the others."""
        shell = np.append(True, self.owner[1:] != self.owner[:-1])
        holes = np.flatnonzero(~shell)
        good = np.ones(polygons, bool)
        if not len(holes):
            return good
        shells = np.flatnonzero(shell)
        start = shells[np.cumsum(shell) - 1]  # the first ring of each ring's polygon
        ends = np.append(shells[1:], len(shell))[np.cumsum(shell) - 1]
        begin, stop = self.first[start[holes]], (self.first + self.sizes)[ends[holes] - 1]
        hole = np.repeat(np.arange(len(holes)), stop - begin)
        at = np.arange(len(hole)) - np.repeat(np.cumsum(stop - begin) - (stop - begin), stop - begin) + begin[hole]
        others = np.flatnonzero(self.ring[at] != holes[hole])
        hole, at = hole[others], at[others]
        x, y = self.place[self.first[holes[hole]]].T
        (px, py), (qx, qy) = self.place[at].T, self.place[self.after[at]].T
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = ((py > y) != (qy > y)) & (x < (qx - px) * (y - py) / (qy - py) + px)
        local = self.ring[at] - start[holes[hole]]
        times = np.bincount(hole * SIMPLE_RINGS + local, crossed, len(holes) * SIMPLE_RINGS).reshape(len(holes), SIMPLE_RINGS) % 2
        good[self.owner[holes[(times[:, 0] != 1) | (times[:, 1:] != 0).any(1)]]] = False
        return good


def _rings_of(polygons: list[Polygon]) -> _Rings:
    """The given polygons, none without rings, whose rings are closed."""
    rings = [r[:-1] for polygon in polygons for r in polygon]
    return _Rings(np.concatenate(rings), np.array([len(r) for r in rings]), np.repeat(np.arange(len(polygons)), [len(p) for p in polygons]))


def _beside_all(given: _Rings, distance: float, quad_segs: int) -> _Rings:
    """The lines of ``beside`` for rings all of whose sides have a length."""
    length, core = given.length, given.place
    normal = np.column_stack([given.side[:, 1], -given.side[:, 0]]) / length[:, None]
    before = normal[given.before]
    sine, cosine = cross(before, normal), (before * normal).sum(1)
    swing = np.arctan2(sine, cosine)
    swing[(np.abs(sine) < 1e-12) & (cosine < 0)] = np.pi  # the tip of a line
    left = swing > 0
    trim = np.where(left, 0.0, distance * np.tan(np.where(left, 0.0, -swing) / 2))
    fits = trim + trim[given.after] <= length
    short = ~left & fits & fits[given.before]
    arcs = np.maximum(1, np.ceil(swing / (np.pi / (2 * quad_segs)) - 1e-9)).astype(int)
    many = np.where(left, arcs + 1, np.where(short, 1, 3))
    corner = np.repeat(np.arange(len(core)), many)
    k = np.arange(len(corner)) - np.repeat(np.cumsum(many) - many, many)
    turn = np.arctan2(before[:, 1], before[:, 0])[corner] + swing[corner] * k / arcs[corner]
    arc = np.column_stack([np.cos(turn), np.sin(turn)])
    bent = np.where((k == 0)[:, None], before[corner], np.where((k == 2)[:, None], normal[corner], 0.0))
    meet = ((before + normal) / np.maximum(1 + cosine, 1e-12)[:, None])[corner]
    out = core[corner] + distance * np.where(left[corner][:, None], arc, np.where(short[corner][:, None], meet, bent))
    return _Rings(out, np.add.reduceat(many, given.first), given.owner)


def buffers(polygons: list[Polygon], distance: float, quad_segs: int = 8) -> list[Polygon | None]:
    """``buffer`` of many polygons at once, where that is a polygon whose rings are the lines beside the given ones; null for all others.

    That holds for valid polygons when those lines neither meet nor turn around: then what they go around is what they enclose. Polygons
    of many sides are left to ``buffer``, as all pairs of sides are looked at here.
    """
    out: list[Polygon | None] = [None] * len(polygons)
    few = lambda p: 0 < len(p) <= SIMPLE_RINGS and sum(map(len, p)) <= SIMPLE_SIDES and all(len(r) >= 4 and (r[0] == r[-1]).all() and np.isfinite(r).all() for r in p)
    at = [k for k, p in enumerate(polygons) if few(p)] if distance else []
    if not at:
        return out
    given = _rings_of([polygons[k] for k in at])
    good = given.apart(len(at)) & given.nested(len(at))
    shell = np.append(True, given.owner[1:] != given.owner[:-1])
    back = ((given.areas() > 0) != shell) != (distance < 0)  # to have the inside on the left, or on the right to shrink
    far, lines, number = abs(distance), [], 0
    chosen = np.flatnonzero(good)
    for k, p in enumerate(at):
        if good[k]:
            lines.append([filled(r[::-1] if b else r, FLAT * far) for r, b in zip(polygons[p], back[number : number + len(polygons[p])].tolist(), strict=True)])
        number += len(polygons[p])
    if not lines:
        return out
    moved = _beside_all(_rings_of(lines), far, quad_segs)
    fine = moved.apart(len(lines))
    before, after = moved.side[moved.before], moved.side
    bend = np.abs(cross(before, after)) > 1e-9 * moved.length[moved.before] * moved.length
    moved = moved.kept(bend | ~fine[moved.of])
    fine &= moved.nested(len(lines))
    shell = np.append(True, moved.owner[1:] != moved.owner[:-1])
    fine[moved.owner[(moved.areas() > 0) != (shell == (distance > 0))]] = False
    fine[moved.owner[moved.sizes < 3]] = False
    ends = np.cumsum(moved.sizes).tolist()
    for a, b, k in zip([0, *ends], ends, moved.owner.tolist(), strict=False):
        if fine[k]:
            ring = moved.place[a:b] if distance > 0 else moved.place[a:b][::-1]
            to = at[chosen[k]]
            out[to] = [*(out[to] or []), np.concatenate([ring, ring[:1]])]
    return out


def buffer(kind: str, rings: list[np.ndarray], distance: float, quad_segs: int = 8) -> list[Polygon]:
    """All within ``distance`` of a point, line or polygon; a negative distance shrinks a polygon, 0 repairs it.

    One closed line goes around everything at the distance; what it goes around at least once is the result. To shrink, it goes around
    the outside of the polygon.
    """
    if kind == "Point":
        return [[circle(rings[0][0], distance, quad_segs)]] if distance > 0 else []
    if kind == "LineString":
        if distance <= 0:
            return []
        lines = [np.concatenate([r, r[-2::-1]]) for r in rings]
    elif distance > 0 and len(rings) == 1 and convex(rings[0]):
        return [[around_convex(rings[0], distance, quad_segs)]]
    elif distance == 0:
        return overlay([rings], [], lambda x, y: x)
    elif invalid_reason(kind, rings) is None:
        lines = [r if distance > 0 else r[::-1] for r in _turned(rings)]
    else:
        return _around(kind, rings, buffer("LineString", rings, abs(distance), quad_segs), distance)
    far = abs(distance)
    lines = [filled(r, FLAT * far) for r in lines]
    reach = [len(r) * min(len(r), far * len(r) / max(float(np.hypot(*np.diff(r, axis=0).T).sum()), 1e-300)) for r in lines]
    if sum(reach) > MEETINGS and max(map(len, lines)) > 4 * STRETCH:
        stretches = [[r[k : k + STRETCH + 1]] for r in lines for k in range(0, len(r) - 1, STRETCH)]
        around = [p for s in stretches for p in buffer("LineString", s, far, quad_segs)]
        return _around(kind, rings, around, distance)
    p, q = _edges([beside(r, far, quad_segs) for r in lines])
    met = arrange(p, q, np.ones((len(p), 1), np.int64))
    left, right = (x[:, 0] > 0 if distance > 0 else x[:, 0] < 0 for x in (met.left, met.right))
    return outline(met, left, right)


def crossing(rings: list[Ring]) -> bool:
    """Whether sides of the rings cross, or a ring touches or folds back on itself."""
    p, q = (np.concatenate([r[s] for r in rings]) for s in (slice(None, -1), slice(1, None)))
    ring = np.concatenate([np.full(len(r) - 1, i) for i, r in enumerate(rings)])
    number = np.concatenate([np.arange(len(r) - 1) for r in rings])
    last = np.array([len(r) - 2 for r in rings])[ring]
    within = lambda a, b, z: ((np.minimum(a, b) <= z) & (z <= np.maximum(a, b))).all(-1)
    for i, j in meeting(np.minimum(p, q), np.maximum(p, q)):
        d, w = q[i] - p[i], p[j] - p[i]
        o1, o2 = cross(d, w), cross(d, q[j] - p[i])
        near = np.flatnonzero(~(((o1 > 0) & (o2 > 0)) | ((o1 < 0) & (o2 < 0))))
        i, j, d, o1, o2 = i[near], j[near], d[near], o1[near], o2[near]
        e = q[j] - p[j]
        o3, o4 = cross(e, p[i] - p[j]), cross(e, q[i] - p[j])
        proper = (o1 * o2 < 0) & (o3 * o4 < 0)
        same = ring[i] == ring[j]
        next_to = same & ((number[j] - number[i] == 1) | ((number[i] == 0) & (number[j] == last[j])))
        touch = ((o1 == 0) & within(p[i], q[i], p[j])) | ((o2 == 0) & within(p[i], q[i], q[j])) | ((o3 == 0) & within(p[j], q[j], p[i])) | ((o4 == 0) & within(p[j], q[j], q[i]))
        folds = next_to & (o1 == 0) & (o2 == 0) & ((d * e).sum(-1) < 0)
        if (proper | (touch & ~next_to & same) | folds).any():
            return True
    return False


def invalid_reason(kind: str, rings: list[Ring]) -> str | None:
    """Why a geometry is not valid; None if it is.

    Points and lines need finite coordinates. A polygon's rings are closed, have four points or more and do not cross or touch themselves;
    rings may touch one another in single points, as long as the inside stays in one piece; holes lie in the shell and outside one another.
    """
    if not all(np.isfinite(r).all() for r in rings):
        return "coordinate is not finite"
    if kind != "Polygon":
        return None
    for ring in rings:
        if (ring[0] != ring[-1]).any():
            return "ring is not closed"
        if len(ring) < 4:
            return "too few points in a ring"
    apart = _apart(rings)
    if apart and all(as_box(r) or convex(r) for r in rings):
        return None
    if crossing(rings):
        return "self-intersection"
    return None if apart else _nesting(rings)


def _apart(rings: list[Ring]) -> bool:
    """Whether there are no holes, or a few in a shell that is a box, none of whose own boxes meets its sides or another's box."""
    if len(rings) == 1:
        return True
    frame = as_box(rings[0])
    if not frame or len(rings) > 9:
        return False
    low, high = (np.array([f(r, axis=0) for r in rings[1:]]) for f in (np.min, np.max))
    within = (low > frame[:2]).all() and (high < frame[2:]).all() and (low < high).all()
    met = (low[:, None] <= high[None]).all(-1) & (low[None] <= high[:, None]).all(-1)
    return bool(within) and int(met.sum()) == len(low)


def _nesting(rings: list[Ring]) -> str | None:
    """What is wrong with how rings lie that do not cross: the inside is where they go around once, counted with holes backwards."""
    turned = _turned(rings)
    of = np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
    p, q = (np.concatenate([r[s] for r in turned]) for s in (slice(None, -1), slice(1, None)))
    solid = (p != q).any(1)
    p, q, of = p[solid], q[solid], of[solid]
    met = arrange(p, q, np.ones((len(p), 1), np.int64))
    owner, start, _, piece = met.steps
    if (met.times > 1).any():
        on = [set(piece[of[owner] == k].tolist()) for k in range(len(rings))]
        return "hole equals shell" if any(h == on[0] for h in on[1:]) else "rings share a side"
    low, high = np.minimum(met.left, met.right)[piece, 0], np.maximum(met.left, met.right)[piece, 0]
    wrong = np.unique(of[owner[(low != 0) | (high != 1)]])
    if len(wrong):
        for k in wrong[wrong > 0].tolist():
            if not inside((rings[k][:1] + rings[k][1:2]) / 2, [[rings[0]]])[0]:
                return "hole lies outside shell"
        return "nested holes"
    spots, sides = np.unique(np.column_stack([start, of[owner]]), axis=0).T
    _, times = np.unique(spots, return_counts=True)
    common = np.repeat(times > 1, times)
    return "interior is disconnected" if _cyclic(sides[common].tolist(), (spots[common] + len(rings)).tolist()) else None


def _cyclic(a: list[int], b: list[int]) -> bool:
    """Whether the graph with these edges has a cycle."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        if top(x) == top(y):
            return True
        parent[top(x)] = top(y)
    return False
