"""HEALPix NEST pixels (Gorski et al. 2005) as column stages, with numpy twins for what the driver plans.

Angles are degrees. ``x`` and ``y`` run from a face's southern corner to the north-east and north-west.
"""

from __future__ import annotations

import math

import numpy as np

from heliograph.functions.stages import Stage

#: Face rows and columns, and neighbours' faces and turns by where a step leaves a face.
JR = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
JP = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
FACE = (
    (8, 9, 10, 11, -1, -1, -1, -1, 10, 11, 8, 9),
    (5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8),
    (-1, -1, -1, -1, 5, 6, 7, 4, -1, -1, -1, -1),
    (4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10),
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11),
    (1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4),
    (-1, -1, -1, -1, 7, 4, 5, 6, -1, -1, -1, -1),
    (3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7),
    (2, 3, 0, 1, -1, -1, -1, -1, 0, 1, 2, 3),
)
TURN = ((0, 0, 3), (0, 0, 6), (0, 0, 0), (0, 0, 5), (0, 0, 0), (5, 0, 0), (0, 0, 0), (6, 0, 0), (3, 0, 0))
#: Steps to the neighbours SW, W, NW, N, NE, E, SE, S.
STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
MAX_ORDER = 29


def check_order(order: int) -> int:
    if not 0 <= int(order) <= MAX_ORDER:
        raise ValueError(f"order must be between 0 and {MAX_ORDER}, not {order}")
    return int(order)


def order2nside(order: int) -> int:
    return 1 << check_order(order)


def order2npix(order: int) -> int:
    return 12 << (2 * check_order(order))


def nside2npix(nside: int) -> int:
    return 12 * nside * nside


def npix2order(npix: int) -> int:
    order = (npix // 12).bit_length() - 1 >> 1
    if npix < 12 or order2npix(order) != npix:
        raise ValueError(f"{npix} is not a number of HEALPix pixels")
    return order


def pixel_area(order: int) -> float:
    """Square degrees."""
    return 4 * math.pi / order2npix(order) * math.degrees(1) ** 2


def resolution(order: int) -> float:
    """Degrees: the side of a square of a pixel's area."""
    return math.sqrt(pixel_area(order))


def reach(order: int) -> float:
    """A safe bound on the angle from a pixel's centre to its farthest corner."""
    return 62.0 / (1 << order)


# ---- column stages ----


def big(v: int | str) -> str:
    return f"CAST({v} AS BIGINT)"


def whole(e: str) -> str:
    return f"CAST(floor({e}) AS BIGINT)"


def xyf_stages(order: int, ra: str, dec: str, p: str = "hp") -> list[Stage]:
    """``{p}_x``, ``{p}_y`` and ``{p}_f`` of a position."""
    ns = order2nside(order)
    return [
        {f"{p}_z": f"sin(radians({dec}))", f"{p}_tt": f"((({ra} % 360e0) + 360e0) % 360e0) / 90e0", f"{p}_t": f"{ns}e0 * sqrt(6e0) * sin(radians(90e0 - abs({dec})) / 2e0)"},
        {
            f"{p}_eq": f"abs({p}_z) <= 2e0 / 3e0",
            f"{p}_a": whole(f"{ns}e0 * (0.5e0 + {p}_tt) - {ns}e0 * 0.75e0 * {p}_z"), f"{p}_b": whole(f"{ns}e0 * (0.5e0 + {p}_tt) + {ns}e0 * 0.75e0 * {p}_z"),
            f"{p}_nt": f"least({big(3)}, {whole(f'{p}_tt')})",
        },
        {
            f"{p}_fa": f"{p}_a >> {order}", f"{p}_fb": f"{p}_b >> {order}",
            f"{p}_c": f"least({whole(f'({p}_tt - {p}_nt) * {p}_t')}, {big(ns - 1)})", f"{p}_d": f"least({whole(f'(1e0 - ({p}_tt - {p}_nt)) * {p}_t')}, {big(ns - 1)})",
        },
        {
            f"{p}_f": f"CASE WHEN {p}_eq THEN CASE WHEN {p}_fa = {p}_fb THEN ({p}_fa & {big(3)}) + 4 WHEN {p}_fa < {p}_fb THEN {p}_fa & {big(3)} ELSE ({p}_fb & {big(3)}) + 8 END WHEN {p}_z > 0e0 THEN {p}_nt ELSE {p}_nt + 8 END",
            f"{p}_x": f"CASE WHEN {p}_eq THEN {p}_b & {big(ns - 1)} WHEN {p}_z > 0e0 THEN {ns - 1} - {p}_d ELSE {p}_c END",
            f"{p}_y": f"CASE WHEN {p}_eq THEN {ns - 1} - ({p}_a & {big(ns - 1)}) WHEN {p}_z > 0e0 THEN {ns - 1} - {p}_c ELSE {p}_d END",
        },
    ]


def pack_stages(order: int, out: str, x: str, y: str, f: str, p: str = "pk") -> list[Stage]:
    """The pixel ``out`` of face coordinates."""
    stages, a, b = [], x, y
    for k, (s, m) in enumerate(MASKS):
        stages.append({f"{p}_x{k}": f"({a} | ({a} << {s})) & {big(m)}", f"{p}_y{k}": f"({b} | ({b} << {s})) & {big(m)}"})
        a, b = f"{p}_x{k}", f"{p}_y{k}"
    # not nullable, so that no filter on nulls is pushed down and unfolds the stages
    return [*stages, {out: f"coalesce(({f} << {2 * order}) | {a} | ({b} << 1), {big(-1)})"}]


def unpack_stages(order: int, pix: str, p: str = "up") -> list[Stage]:
    """``{p}_x``, ``{p}_y`` and ``{p}_f`` of a pixel."""
    half = MASKS[-1][1]
    stages: list[Stage] = [{f"{p}_f": f"{pix} >> {2 * order}", f"{p}_i": f"{pix} & {big((1 << 2 * order) - 1)}"}, {f"{p}_x5": f"{p}_i & {big(half)}", f"{p}_y5": f"({p}_i >> 1) & {big(half)}"}]
    for k, (s, m) in zip((4, 3, 2, 1, 0), [(1, MASKS[3][1]), (2, MASKS[2][1]), (4, MASKS[1][1]), (8, MASKS[0][1]), (16, 0xFFFFFFFF)]):
        stages.append({f"{p}_{v}{k}" if k else f"{p}_{v}": f"({p}_{v}{k + 1} | ({p}_{v}{k + 1} >> {s})) & {big(m)}" for v in "xy"})
    return stages


def ang2pix_stages(order: int, ra: str, dec: str, out: str, p: str = "hp") -> list[Stage]:
    return [*xyf_stages(order, ra, dec, p), *pack_stages(order, out, f"{p}_x", f"{p}_y", f"{p}_f", f"{p}p")]


def pick(table: tuple, at: str) -> str:
    """An entry of a table of small integers, as a look-up in a string."""
    return f"CAST(substr('{''.join(f'{v:2d}' for v in table)}', CAST(2 * ({at}) + 1 AS INT), 2) AS BIGINT)"


def angle_stages(order: int, x: str, y: str, f: str, ra: str, dec: str, p: str = "an") -> list[Stage]:
    """The position of (fractional) face coordinates."""
    ns = order2nside(order)
    return [
        {f"{p}_jr": f"{pick(JR, f)} * {ns}e0 - ({x}) - ({y})"},
        {f"{p}_nr": f"CASE WHEN {p}_jr < {ns}e0 THEN {p}_jr WHEN {p}_jr > {3 * ns}e0 THEN {4 * ns}e0 - {p}_jr ELSE {ns}e0 END"},
        {
            f"{p}_z": f"CASE WHEN {p}_jr < {ns}e0 THEN 1e0 - {p}_nr * {p}_nr / {3 * ns * ns}e0 WHEN {p}_jr > {3 * ns}e0 THEN {p}_nr * {p}_nr / {3 * ns * ns}e0 - 1e0 ELSE ({2 * ns}e0 - {p}_jr) * 2e0 / {3 * ns}e0 END",
            f"{p}_w": f"{pick(JP, f)} * {p}_nr + ({x}) - ({y})",
        },
        {ra: f"coalesce(CASE WHEN {p}_nr <= 0e0 THEN 0e0 ELSE 45e0 * (({p}_w + 8e0 * {p}_nr) % (8e0 * {p}_nr)) / {p}_nr END, CAST('NaN' AS DOUBLE))", dec: f"coalesce(degrees(asin(greatest(-1e0, least(1e0, {p}_z)))), CAST('NaN' AS DOUBLE))"},
    ]


def pix2ang_stages(order: int, pix: str, ra: str, dec: str, p: str = "pa") -> list[Stage]:
    return [*unpack_stages(order, pix, p), *angle_stages(order, f"{p}_x + 0.5e0", f"{p}_y + 0.5e0", f"{p}_f", ra, dec, f"{p}a")]


def ring_stages(order: int, pix: str, out: str, p: str = "ri") -> list[Stage]:
    """The number in the ring scheme of a pixel in the nested scheme."""
    ns = order2nside(order)
    return [
        *unpack_stages(order, pix, p),
        {f"{p}_j": f"{pick(JR, f'{p}_f')} * {ns} - {p}_x - {p}_y - 1"},
        {f"{p}_n": f"CASE WHEN {p}_j < {ns} THEN {p}_j WHEN {p}_j > {3 * ns} THEN {4 * ns} - {p}_j ELSE {big(ns)} END", f"{p}_s": f"CASE WHEN {p}_j < {ns} OR {p}_j > {3 * ns} THEN {big(0)} ELSE ({p}_j - {ns}) & {big(1)} END"},
        {
            f"{p}_b": f"CASE WHEN {p}_j < {ns} THEN 2 * {p}_n * ({p}_n - 1) WHEN {p}_j > {3 * ns} THEN {big(12 * ns * ns)} - 2 * {p}_n * ({p}_n + 1) ELSE {big(2 * ns * (ns - 1))} + ({p}_j - {ns}) * {4 * ns} END",
            f"{p}_k": f"(({pick(JP, f'{p}_f')} * {p}_n + {p}_x - {p}_y + 1 + {p}_s) >> 1) - 1",
        },
        {out: f"{p}_b + ({p}_k + 4 * {p}_n) % (4 * {p}_n)"},
    ]


def polar_stages(order: int, pix: str, out: str, p: str = "po") -> list[Stage]:
    """Which pole a pixel touches, no text for none."""
    top = order2nside(order) - 1
    return [*unpack_stages(order, pix, p), {out: f"CASE WHEN {p}_f < 4 AND {p}_x = {top} AND {p}_y = {top} THEN 'North' WHEN {p}_f >= 8 AND {p}_x = 0 AND {p}_y = 0 THEN 'South' ELSE '' END"}]


def neighbour_stages(order: int, x: str, y: str, f: str, p: str = "nb") -> list[Stage]:
    """``{p}0`` .. ``{p}7``: the neighbours SW, W, NW, N, NE, E, SE, S of a cell, -1 where there is none."""
    ns = order2nside(order)
    faces, turns = tuple(v for row in FACE for v in row), tuple(v for row in TURN for v in row)
    one: list[Stage] = [{}, {}, {}, {}, {}]
    parts = []
    for k, (dx, dy) in enumerate(STEPS):
        q = f"{p}{k}"
        one[0] |= {f"{q}_u": f"({x}) + ({dx})", f"{q}_v": f"({y}) + ({dy})"}
        one[1] |= {f"{q}_n": f"4 + CASE WHEN {q}_u < 0 THEN -1 WHEN {q}_u >= {ns} THEN 1 ELSE 0 END + CASE WHEN {q}_v < 0 THEN -3 WHEN {q}_v >= {ns} THEN 3 ELSE 0 END"}
        one[2] |= {f"{q}_f": pick(faces, f"12 * {q}_n + {f}"), f"{q}_t": pick(turns, f"3 * {q}_n + ({f} >> 2)"), f"{q}_p": f"({q}_u + {ns}) & {big(ns - 1)}", f"{q}_q": f"({q}_v + {ns}) & {big(ns - 1)}"}
        one[3] |= {f"{q}_g": f"greatest({q}_f, {big(0)})", f"{q}_a": f"CASE WHEN ({q}_t & {big(1)}) > 0 THEN {ns - 1} - {q}_p ELSE {q}_p END", f"{q}_b": f"CASE WHEN ({q}_t & {big(2)}) > 0 THEN {ns - 1} - {q}_q ELSE {q}_q END"}
        one[4] |= {f"{q}_x": f"CASE WHEN ({q}_t & {big(4)}) > 0 THEN {q}_b ELSE {q}_a END", f"{q}_y": f"CASE WHEN ({q}_t & {big(4)}) > 0 THEN {q}_a ELSE {q}_b END"}
        parts.append(pack_stages(order, f"{q}_o", f"{q}_x", f"{q}_y", f"{q}_g", f"{q}_k"))
    packed = [{n: e for part in parts for n, e in part[i].items()} for i in range(len(parts[0]))]
    return [*one, *packed, {f"{p}{k}": f"CASE WHEN {p}{k}_f < 0 THEN {big(-1)} ELSE {p}{k}_o END" for k in range(8)}]


# ---- numpy twins ----


def spread(v: np.ndarray) -> np.ndarray:
    for s, m in MASKS:
        v = (v | (v << s)) & m
    return v


def compress(v: np.ndarray) -> np.ndarray:
    v = v & MASKS[-1][1]
    for s, m in [(1, MASKS[3][1]), (2, MASKS[2][1]), (4, MASKS[1][1]), (8, MASKS[0][1]), (16, 0xFFFFFFFF)]:
        v = (v | (v >> s)) & m
    return v


def ang2pix(order: int, ra, dec) -> np.ndarray:
    ns = order2nside(order)
    ra, dec = np.asarray(ra, float), np.asarray(dec, float)
    z, tt = np.sin(np.radians(dec)), ra % 360 / 90
    a, b = np.floor(ns * (0.5 + tt) - 0.75 * ns * z).astype(np.int64), np.floor(ns * (0.5 + tt) + 0.75 * ns * z).astype(np.int64)
    fa, fb = a >> order, b >> order
    nt = np.minimum(3, np.floor(tt)).astype(np.int64)
    t = ns * math.sqrt(6) * np.sin(np.radians(90 - np.abs(dec)) / 2)
    c, d = (np.minimum(np.floor(v * t), ns - 1).astype(np.int64) for v in (tt - nt, 1 - (tt - nt)))
    eq, north = np.abs(z) <= 2 / 3, z > 0
    f = np.where(eq, np.where(fa == fb, (fa & 3) + 4, np.where(fa < fb, fa & 3, (fb & 3) + 8)), np.where(north, nt, nt + 8))
    x = np.where(eq, b & (ns - 1), np.where(north, ns - 1 - d, c))
    y = np.where(eq, ns - 1 - (a & (ns - 1)), np.where(north, ns - 1 - c, d))
    return xyf2pix(order, x, y, f)


def xyf2pix(order: int, x, y, f) -> np.ndarray:
    return (np.asarray(f) << 2 * order) | spread(np.asarray(x)) | (spread(np.asarray(y)) << 1)


def pix2xyf(order: int, pix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pix = np.asarray(pix, np.int64)
    i = pix & ((1 << 2 * order) - 1)
    return compress(i), compress(i >> 1), pix >> 2 * order


def nest2ring(order: int, pix) -> np.ndarray:
    """Numbers in the ring scheme of pixels in the nested scheme."""
    ns = order2nside(order)
    x, y, f = pix2xyf(order, pix)
    j = np.asarray(JR)[f] * ns - x - y - 1
    cap, foot = j < ns, j > 3 * ns
    n = np.where(cap, j, np.where(foot, 4 * ns - j, ns))
    before = np.where(cap, 2 * n * (n - 1), np.where(foot, 12 * ns * ns - 2 * n * (n + 1), 2 * ns * (ns - 1) + (j - ns) * 4 * ns))
    k = ((np.asarray(JP)[f] * n + x - y + 1 + np.where(cap | foot, 0, (j - ns) & 1)) >> 1) - 1
    return before + k % (4 * n)


def xyf2ang(order: int, x, y, f) -> tuple[np.ndarray, np.ndarray]:
    ns = order2nside(order)
    jr = np.asarray(JR)[f] * ns - x - y
    nr = np.where(jr < ns, jr, np.where(jr > 3 * ns, 4 * ns - jr, ns)).astype(float)
    z = np.where(jr < ns, 1 - nr * nr / (3 * ns * ns), np.where(jr > 3 * ns, nr * nr / (3 * ns * ns) - 1, (2 * ns - jr) * 2 / (3 * ns)))
    w = np.asarray(JP)[f] * nr + x - y
    safe = np.where(nr > 0, nr, 1)
    return np.where(nr > 0, 45 * (w % (8 * safe)) / safe, 0.0), np.degrees(np.arcsin(np.clip(z, -1, 1)))


def pix2ang(order: int, pix) -> tuple[np.ndarray, np.ndarray]:
    x, y, f = pix2xyf(order, pix)
    return xyf2ang(order, x + 0.5, y + 0.5, f)


def ang2vec(ra, dec) -> np.ndarray:
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d) * np.ones_like(a)], -1)


def neighbours(order: int, pix) -> np.ndarray:
    """Eight columns in the order of STEPS, -1 where there is none."""
    ns = order2nside(order)
    x, y, f = pix2xyf(order, np.atleast_1d(pix))
    out = []
    for dx, dy in STEPS:
        u, v = x + dx, y + dy
        n = 4 - (u < 0) + (u >= ns) - 3 * (v < 0) + 3 * (v >= ns)
        face, turn = np.asarray(FACE)[n, f], np.asarray(TURN)[n, f >> 2]
        u, v = u & (ns - 1), v & (ns - 1)
        u, v = np.where(turn & 1, ns - 1 - u, u), np.where(turn & 2, ns - 1 - v, v)
        u, v = np.where(turn & 4, v, u), np.where(turn & 4, u, v)
        out.append(np.where(face < 0, -1, xyf2pix(order, u, v, np.maximum(face, 0))))
    return np.stack(out, 1)


def boundaries(order: int, pix: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """4 * step points around a pixel, from the northern corner by west, south and east."""
    x, y, f = pix2xyf(order, pix)
    t = np.arange(step) / step
    xs = np.concatenate([1 - t, 0 * t, t, 0 * t + 1])
    ys = np.concatenate([0 * t + 1, 1 - t, 0 * t, t])
    return xyf2ang(order, x + xs, y + ys, np.full(4 * step, f))


def query_disc(order: int, ra: float, dec: float, radius: float, inclusive: bool = False) -> np.ndarray:
    """Pixels whose centre lies within the radius; inclusive: all that may touch the disc (a superset)."""
    centre = ang2vec(ra, dec)
    pix = np.arange(12)
    for o in range(check_order(order) + 1):
        away = np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(ang2vec(*pix2ang(o, pix)) - centre, axis=-1) / 2, 0, 1)))
        last = o == order
        pix = pix[away <= radius + (0 if last and not inclusive else reach(o))]
        if not last:
            pix = (pix[:, None] * 4 + np.arange(4)).ravel()
    return np.sort(pix)


def query_discs(order: int, ra: np.ndarray, dec: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(which centre, pixel) of the pixels whose centres lie within the radius of each of many centres."""
    centres = ang2vec(ra, dec)
    who, pix = np.repeat(np.arange(len(centres)), 12), np.tile(np.arange(12), len(centres))
    for o in range(check_order(order) + 1):
        away = np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(ang2vec(*pix2ang(o, pix)) - centres[who], axis=-1) / 2, 0, 1)))
        near = away <= radius + (0 if o == order else reach(o))
        who, pix = who[near], pix[near]
        if o < order:
            who, pix = np.repeat(who, 4), (pix[:, None] * 4 + np.arange(4)).ravel()
    return who, pix


def disc_tiles(ra: np.ndarray, dec: np.ndarray, radius: np.ndarray, deepest: np.ndarray, inclusive: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which disc, order, pixel, inside) of the fewest pixels of orders up to ``deepest`` that make up each of many discs: those of
    the deepest order whose centres are in the disc, or with ``inclusive`` all that may touch it. ``inside``: no point of the pixel is
    farther from the centre than the radius."""
    centres, found = ang2vec(ra, dec), []
    who, pix = np.repeat(np.arange(len(centres)), 12), np.tile(np.arange(12), len(centres))
    for o in range(int(max(deepest, default=0)) + 1):
        away = np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(ang2vec(*pix2ang(o, pix)) - centres[who], axis=-1) / 2, 0, 1)))
        inside, last = away <= radius[who] - reach(o), deepest[who] == o
        keep = inside | (last & (away <= radius[who] + (reach(o) if inclusive else 0)))
        found.append((who[keep], np.full(keep.sum(), o, np.int32), pix[keep], inside[keep]))
        on = ~inside & ~last & (away <= radius[who] + reach(o))
        who, pix = np.repeat(who[on], 4), (pix[on][:, None] * 4 + np.arange(4)).ravel()
    return tuple(np.concatenate(c) for c in zip(*found))


def order_for(radius) -> np.ndarray:
    """The order whose pixels are about a third of the radius wide, 14 at most."""
    with np.errstate(divide="ignore"):
        return np.clip(np.ceil(np.log2(3 * resolution(0) / np.maximum(np.asarray(radius, float), 0))), 0, 14).astype(np.int64)


def pixels_around(order: int, pix: int, radius: float) -> np.ndarray:
    """Other pixels that may touch the disc about a pixel's centre (a superset)."""
    ra, dec = pix2ang(order, pix)
    near = query_disc(order, float(ra), float(dec), radius, inclusive=True)
    return near[near != pix]


def is_polar(order: int, pix: int) -> tuple[bool, str]:
    """Does the pixel touch a pole, and which?"""
    x, y, f = (int(v) for v in pix2xyf(order, pix))
    top = order2nside(order) - 1
    if f < 4 and x == y == top:
        return True, "North"
    return (True, "South") if f >= 8 and x == y == 0 else (False, "")


#: Edges and corners of a pixel by number: NE, E, SE, S, SW, W, NW, N; where x or y is at its end.
EDGES = ((1, None), (1, 0), (None, 0), (0, 0), (0, None), (0, 1), (None, 1), (1, 1))


def edge_pixels(dk: int, pix: int, edge: int) -> np.ndarray:
    """Pixels ``dk`` orders deeper along an edge (2 ** dk of them) or in a corner of a pixel."""
    ex, ey = EDGES[edge]
    n = 1 << dk
    run = np.arange(n)
    x = run if ex is None else np.array([ex * (n - 1)])
    y = run if ey is None else np.array([ey * (n - 1)])
    x, y = np.broadcast_arrays(x, y)
    return (np.int64(pix) << 2 * dk) | spread(x.astype(np.int64)) | (spread(y.astype(np.int64)) << 1)


def margin_pixels(order: int, pix: int, dk: int) -> np.ndarray:
    """Pixels ``dk`` orders deeper that border the pixel from outside, sorted."""
    rim = np.unique(np.concatenate([edge_pixels(dk, pix, e) for e in range(8)]))
    around = np.unique(neighbours(order + dk, rim))
    return around[(around >= 0) & (around >> 2 * dk != pix)]


def polar_margin_pixels(order: int, pix: int, dk: int) -> np.ndarray:
    """Of a polar pixel's margin, the pixels that touch its pole."""
    polar, pole = is_polar(order, pix)
    around = margin_pixels(order, pix, dk)
    return around[[is_polar(order + dk, int(p)) == (True, pole) for p in around]] if polar else around[:0]


def margin_scale(order: int, margin: float) -> float:
    """By how much a pixel's area grows with a margin all around."""
    return (resolution(order) + margin) ** 2 / pixel_area(order)
