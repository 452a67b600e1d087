"""Numpy on the pixels of one mask (at most a tile's), for grouped tasks.

A mask is a sorted array of flat places in a `Frame`, the bounding box of its pixels with a rim of one, so that a place's
neighbours are at fixed distances and a row's last pixel never touches the next row's first."""

import math

import numpy as np

CROSS = [(-1, 0), (0, -1), (0, 1), (1, 0)]
#: Neighbours in clockwise order from the west, as (dy, dx); bit k of a neighbour code is set where neighbour k is.
RING = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
_BITS = np.array([[c >> k & 1 for k in range(8)] for c in range(256)], bool)
COUNT = _BITS.sum(1).astype(np.uint8)
# Parallel thinning (Zhang and Suen, 1984): what may go in each subpass, by neighbour code.
_W, _, _N, _, _E, _, _S, _ = _BITS.T
_EDGE = (COUNT >= 2) & (COUNT <= 6) & ((~_BITS & np.roll(_BITS, -1, 1)).sum(1) == 1)
_THIN = [_EDGE & ~(_N & _E & _S) & ~(_E & _S & _W), _EDGE & ~(_N & _E & _W) & ~(_N & _S & _W)]
# Along an outer border: the next step by neighbour code and the direction one came from (8 if there is none).
_NEXT = bytes(next(((back + k) % 8 for k in range(1, 9) if c >> (back + k) % 8 & 1), 8) for c in range(256) for back in range(8))


class Frame:
    """The box of some pixels with a rim of one: coordinates to flat places and back."""

    def __init__(self, y: np.ndarray, x: np.ndarray):
        self.top, self.left = (int(y.min()) - 1, int(x.min()) - 1) if len(y) else (0, 0)
        self.height, self.width = (int(y.max()) - self.top + 2, int(x.max()) - self.left + 2) if len(y) else (0, 0)
        self.ring = [dy * self.width + dx for dy, dx in RING]

    def places(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.unique((y - self.top) * self.width + (x - self.left))

    def coordinates(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at // self.width + self.top, at % self.width + self.left

    def image(self, at: np.ndarray) -> np.ndarray:
        on = np.zeros(self.height * self.width, np.uint8)
        on[at] = 1
        return on

    def codes(self, on: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the eight neighbours of each place are on."""
        out = np.zeros(len(at), np.uint8)
        for k, step in enumerate(self.ring):
            out |= on[at + step] << k
        return out


def framed(pixels) -> tuple[Frame, np.ndarray]:
    """The frame of (y, x) pixels and their places."""
    p = np.asarray(list(pixels), np.int64).reshape(-1, 2)
    frame = Frame(p[:, 0], p[:, 1])
    return frame, frame.places(p[:, 0], p[:, 1])


def thinned(frame: Frame, at: np.ndarray) -> np.ndarray:
    """The skeleton: two subpasses in turn until neither drops a pixel."""
    on, before = frame.image(at), -1
    while before != len(at):
        before = len(at)
        for may_go in _THIN:
            drop = may_go[frame.codes(on, at)]
            on[at[drop]] = 0
            at = at[~drop]
    return at


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find of n vertices over edges (a, b): each vertex's smallest connected vertex.

    A round hooks every root to the smallest root next to it and flattens all paths, so rounds are few."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    return parent


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of consecutive places."""
    breaks = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate(([0], breaks + 1))] if len(at) else at, at[np.concatenate((breaks, [len(at) - 1]))] + 1 if len(at) else at


def run_roots(frame: Frame, at: np.ndarray, conn: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, root) of a mask's runs: each run's component is named by its first run. Union-find over runs of adjacent rows."""
    start, end = runs(at)
    reach = frame.width + (conn == 8)
    low = np.searchsorted(end, start + 2 * frame.width - reach, "right")  # runs of the next row that end past this one's start
    n = np.maximum(np.searchsorted(start, end + reach, "left") - low, 0)  # and start before its end
    first = np.repeat(np.arange(len(start)), n)
    second = np.arange(len(first)) + np.repeat(low - (np.cumsum(n) - n), n)
    return start, end, roots(len(start), first, second)


def labels(frame: Frame, at: np.ndarray, conn: int = 8) -> np.ndarray:
    """The component of each place, numbered from 0 in the order of their first pixels."""
    start, end, root = run_roots(frame, at, conn)
    number = np.cumsum(root == np.arange(len(root))) - 1
    return np.repeat(number[root], end - start)


def component_count(frame: Frame, at: np.ndarray, conn: int = 8) -> int:
    root = run_roots(frame, at, conn)[2]
    return int((root == np.arange(len(root))).sum())


def junction_clusters(frame: Frame, at: np.ndarray) -> int:
    """Clusters of pixels with three or more neighbours."""
    return component_count(frame, at[COUNT[frame.codes(frame.image(at), at)] >= 3])


def border_length(frame: Frame, at: np.ndarray) -> float:
    """Sum of the closed outer borders of all 8-connected components: steps of 1 and sqrt(2)."""
    if not len(at):
        return 0.0
    code = np.zeros(frame.height * frame.width, np.uint8)
    code[at] = frame.codes(frame.image(at), at)
    code, ring, straight, slanted = code.tobytes(), frame.ring, 0, 0
    begin, _, root = run_roots(frame, at)
    for start in begin[root == np.arange(len(root))].tolist():
        place, d = start, _NEXT[code[start] << 3]
        if d == 8:
            continue  # a single pixel
        begun = d
        while True:
            if d & 1:
                slanted += 1
            else:
                straight += 1
            place += ring[d]
            d = _NEXT[code[place] << 3 | d ^ 4]
            if place == start and d == begun:
                break
    return straight + math.sqrt(2) * slanted


def convex_hull(frame: Frame, at: np.ndarray) -> tuple[float, float]:
    """Area and closed perimeter of the convex hull of pixel centres; a row's ends are all that can be corners."""
    if len(at) < 2:
        return 0.0, 0.0
    y, x = frame.coordinates(at)
    rows, first = np.unique(y, return_index=True)
    last = np.concatenate((first[1:], [len(y)])) - 1

    def side(xs: list[int], sign: int) -> list[tuple[int, int]]:
        out: list = []
        for p in zip(xs, rows.tolist(), strict=True):
            while len(out) > 1 and sign * ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out

    left, right = side(x[first].tolist(), -1), side(x[last].tolist(), 1)
    corners = np.array(right + left[::-1], float)
    step = np.roll(corners, -1, 0)
    area = abs((corners[:, 0] * step[:, 1] - step[:, 0] * corners[:, 1]).sum()) / 2
    return float(area), float(np.hypot(*(step - corners).T).sum())


def euler_number(frame: Frame, at: np.ndarray, part: np.ndarray) -> int:
    """Corners less edges plus faces of the pixels' closed squares, each part (4-connected) on its own."""
    shared = sum(int(frame.image(at)[at + step].sum()) for step in (1, frame.width))  # edges that two pixels share
    corners = np.concatenate([at, at + 1, at + frame.width, at + frame.width + 1]) * (int(part.max(initial=0)) + 1) + np.tile(part, 4)
    return len(np.unique(corners)) - (4 * len(at) - shared) + len(at)


def betti_numbers(frame: Frame, at: np.ndarray) -> tuple[int, int]:
    """Components (4-connected) and, per component, holes by its Euler number, summed."""
    part = labels(frame, at, 4)
    n = int(part.max(initial=-1)) + 1
    return n, n - euler_number(frame, at, part)


def filled_places(y: np.ndarray, x: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The mask and all background of the height x width tile that is not 4-connected to its corner (0, 0)."""
    on = np.zeros((height, width), bool)
    on[y, x] = True
    if not on[0, 0]:  # else the flood starts inside: all that is left of the tile is filled
        frame = Frame(np.array([0, height - 1]), np.array([0, width - 1]))
        off = frame.places(*np.nonzero(~on))
        part = labels(frame, off, 4)
        outside_y, outside_x = frame.coordinates(off[part == part[0]])
        on[:] = True
        on[outside_y, outside_x] = False
    else:
        on[:] = True
    return np.nonzero(on)


def grown(frame: Frame, at: np.ndarray, open_: np.ndarray, rounds: int) -> np.ndarray:
    """Places grown a step a round through open ones; only the last round's places are looked around from."""
    free = frame.image(open_)
    free[at] = 0
    out, rim = [at], at
    for _ in range(rounds):
        near = np.unique(np.concatenate([rim + step for step in frame.ring]))
        rim = near[free[near] == 1]
        if not len(rim):
            break
        free[rim] = 0
        out.append(rim)
    return np.sort(np.concatenate(out))


def sholl_rings(y: np.ndarray, x: np.ndarray, cy: float, cx: float) -> tuple[int, int, int, int, int]:
    """(smallest, busiest and largest radius, pixels of the busiest ring, of all): rings from 1 to the largest distance, rounded up."""
    if not len(y):
        return 0, 0, 0, 0, 0
    d = np.sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx))
    r = np.floor(d + 0.5).astype(np.int64)
    n = np.bincount(r[(r >= 1) & (r <= math.ceil(d.max()))])
    hit = np.flatnonzero(n)
    return (int(hit[0]), int(n.argmax()), int(hit[-1]), int(n.max()), int(n.sum())) if len(hit) else (0, 0, 0, 0, 0)


def set_places(counts: np.ndarray) -> np.ndarray:
    """Places of the set runs of run lengths that begin with zeros."""
    ends, n = np.cumsum(counts), counts[1::2]
    return np.repeat((ends - counts)[1::2] - (np.cumsum(n) - n), n) + np.arange(n.sum())


# --- on lists of (y, x) pixels


def label(pixels, conn: int = 8) -> dict[tuple[int, int], int]:
    """Component of each (y, x), numbered from 1 in the order of their first pixel by row and column."""
    frame, at = framed(pixels)
    if not len(at):
        return {}
    y, x = frame.coordinates(at)
    return dict(zip(zip(y.tolist(), x.tolist(), strict=True), (labels(frame, at, conn) + 1).tolist(), strict=True))


def thin(pixels) -> list[tuple[int, int]]:
    frame, at = framed(pixels)
    y, x = frame.coordinates(thinned(frame, at)) if len(at) else (at, at)
    return list(zip(y.tolist(), x.tolist(), strict=True))


def perimeter(pixels) -> float:
    return border_length(*framed(pixels))


def hull(pixels) -> tuple[float, float]:
    return convex_hull(*framed(pixels))


def junction_count(skeleton) -> int:
    frame, at = framed(skeleton)
    return junction_clusters(frame, at) if len(at) else 0


def euler(pixels, conn: int = 8) -> int:
    """Euler number: components less holes of the whole mask, pixels being closed squares (8) or open ones (4)."""
    frame, at = framed(pixels)
    if not len(at):
        return 0
    if conn == 8:
        return euler_number(frame, at, np.zeros(len(at), np.int64))
    on, w = frame.image(at), frame.width
    right, down = on[at + 1], on[at + w]
    return len(at) - int(right.sum()) - int(down.sum()) + int((right & down & on[at + w + 1]).sum())


def betti(pixels) -> tuple[int, int]:
    frame, at = framed(pixels)
    return betti_numbers(frame, at) if len(at) else (0, 0)


def filled(pixels, height: int, width: int) -> list[tuple[int, int]]:
    p = np.asarray(list(pixels), np.int64).reshape(-1, 2)
    y, x = filled_places(p[:, 0], p[:, 1], height, width)
    return list(zip(y.tolist(), x.tolist(), strict=True))
