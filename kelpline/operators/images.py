"""Decoded frames and masks as arrays: change, components, thinning, distance, skeleton paths, flow.

Functions take one small array (a mask, a frame) and return arrays; the DataFrame forms at the end apply them to rows of
bytes. Nothing here decodes video: frames come from the seams.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def shifted(a: np.ndarray, dy: int, dx: int, fill=0) -> np.ndarray:
    """``out[y, x] = a[y + dy, x + dx]``, ``fill`` beyond the edge."""
    out = np.full_like(a, fill)
    h, w = a.shape[:2]
    ys, xs = slice(max(-dy, 0), min(h - dy, h)), slice(max(-dx, 0), min(w - dx, w))
    out[ys, xs] = a[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
    return out


def changed_fraction(before: np.ndarray, frame: np.ndarray, threshold: int = 25, stamp: tuple[float, float] = (0.88, 0.60)) -> float:
    """Share of pixels that differ by more than the threshold; a clock in the lower right corner doesn't count."""
    change = np.abs(frame.astype(np.int16) - before.astype(np.int16))
    if change.ndim == 3:
        change = change.mean(axis=2)
    h, w = change.shape
    change[int(h * stamp[0]) :, int(w * stamp[1]) :] = 0
    return float((change > threshold).mean())


def is_grey(frame: np.ndarray, least: float = 6.0) -> bool:
    """Channels that hardly differ on average: an infrared frame."""
    f = frame.astype(np.int16)
    return bool(np.mean([np.abs(f[..., a] - f[..., b]).mean() for a, b in ((0, 1), (1, 2), (0, 2))]) < least)


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest elements on another grid."""
    y = np.minimum(((np.arange(height) + 0.5) * a.shape[0] / height).astype(int), a.shape[0] - 1)
    x = np.minimum(((np.arange(width) + 0.5) * a.shape[1] / width).astype(int), a.shape[1] - 1)
    return a[y][:, x]


def components(mask: np.ndarray) -> np.ndarray:
    """8-connected components: labels from 1 by first pixel, 0 outside."""
    m = mask.astype(bool)
    label = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), 0)
    while True:
        least = label.copy()
        for dy, dx in NEIGHBOURS:
            other = shifted(label, dy, dx)
            least = np.where(m & (other > 0), np.minimum(least, other), least)
        flat = least.ravel()
        jumped = np.where(m, flat[np.maximum(least - 1, 0)], 0)  # a label is a place: go on to the label there
        if (jumped == label).all():
            break
        label = jumped
    kinds, which = np.unique(label, return_inverse=True)
    return which.reshape(m.shape) + (0 if kinds[0] == 0 else 1)


def largest_component(mask: np.ndarray) -> np.ndarray:
    label = components(mask)
    if not label.any():
        return np.zeros(mask.shape, bool)
    return label == np.bincount(label[label > 0]).argmax()


def segmented(probability: np.ndarray, threshold: float, height: int, width: int) -> np.ndarray:
    """The largest component above the threshold, on the frame's grid."""
    return largest_component(resized(probability >= threshold, height, width))


def filled(mask: np.ndarray) -> np.ndarray:
    """A mask without holes: what the outside doesn't reach."""
    outside = np.pad(~mask.astype(bool), 1, constant_values=True)
    reach = np.zeros_like(outside)
    reach[0, :] = reach[-1, :] = reach[:, 0] = reach[:, -1] = True
    while True:
        more = reach.copy()
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            more |= shifted(reach, dy, dx)
        more &= outside
        if (more == reach).all():
            return ~reach[1:-1, 1:-1]
        reach = more


def thinned(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton by the two alternating passes of Zhang and Suen."""
    m = np.pad(mask.astype(np.uint8), 1)
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    while True:
        changed = False
        for first in (True, False):
            p = [shifted(m, dy, dx) for dy, dx in ring]
            n = sum(p)
            turns = sum((p[i] == 0) & (p[(i + 1) % 8] == 1) for i in range(8))
            a, b = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if first else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
            gone = (m == 1) & (n >= 2) & (n <= 6) & (turns == 1) & (a == 0) & (b == 0)
            if gone.any():
                m[gone] = 0
                changed = True
        if not changed:
            return m[1:-1, 1:-1].astype(bool)


def degree(skeleton: np.ndarray) -> np.ndarray:
    s = skeleton.astype(np.int8)
    return np.where(skeleton, sum(shifted(s, dy, dx) for dy, dx in NEIGHBOURS), 0)


def without_spurs(skeleton: np.ndarray, shortest: int) -> np.ndarray:
    """A skeleton without branches of fewer than so many pixels between an end and a fork."""
    out = skeleton.copy()
    deg = degree(out)
    for y, x in np.argwhere(deg == 1):
        path, at, seen = [], (int(y), int(x)), set()
        while len(path) < shortest:
            path.append(at)
            seen.add(at)
            ahead = [(at[0] + dy, at[1] + dx) for dy, dx in NEIGHBOURS if 0 <= at[0] + dy < out.shape[0] and 0 <= at[1] + dx < out.shape[1] and out[at[0] + dy, at[1] + dx]]
            ahead = [q for q in ahead if q not in seen]
            if len(ahead) != 1:
                break
            at = ahead[0]
            if deg[at] > 2:
                break
        if len(path) < shortest and deg[at] > 2:
            for q in path:
                out[q] = deg[q] > 2
    return out


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest one outside; beyond the edge is outside."""
    m = np.pad(mask.astype(bool), 1)
    h, w = m.shape
    down = np.zeros((h, w))
    for y in range(1, h):
        down[y] = np.where(m[y], down[y - 1] + 1, 0)
    for y in range(h - 2, -1, -1):
        down[y] = np.minimum(down[y], np.where(m[y], down[y + 1] + 1, 0))
    x = np.arange(w)
    apart = (x[:, None] - x) ** 2
    return np.sqrt(np.stack([(row**2 + apart).min(axis=1) for row in down]))[1:-1, 1:-1]


def body_parts(mask: np.ndarray, apart: float = 1.0) -> dict[str, tuple[int, int] | None]:
    """Mantle: the deepest pixel. Head: the deepest one beyond ``apart`` mantle radii, where the way between narrows."""
    d = distance(mask)
    if not mask.any():
        return {"mantle": None, "head": None}
    mantle = tuple(int(v) for v in np.unravel_index(d.argmax(), d.shape))
    y, x = np.indices(d.shape)
    far = np.where(np.hypot(y - mantle[0], x - mantle[1]) > apart * d[mantle], d, 0)
    if far.max() <= 0:
        return {"mantle": mantle, "head": None}
    head = tuple(int(v) for v in np.unravel_index(far.argmax(), d.shape))
    steps = int(max(abs(head[0] - mantle[0]), abs(head[1] - mantle[1]))) + 1
    way = d[np.linspace(mantle[0], head[0], steps).round().astype(int), np.linspace(mantle[1], head[1], steps).round().astype(int)]
    return {"mantle": mantle, "head": head if way.min() < far.max() else None}


def shortest_tree(skeleton: np.ndarray, root: tuple[int, int], clearance: np.ndarray) -> tuple[dict, dict]:
    """(cost, predecessor) of skeleton pixels from the root; a step costs its length over one plus the clearance there."""
    cost, back, heap = {root: 0.0}, {root: None}, [(0.0, root)]
    while heap:
        c, at = heapq.heappop(heap)
        if c > cost[at]:
            continue
        for dy, dx in NEIGHBOURS:
            q = (at[0] + dy, at[1] + dx)
            if 0 <= q[0] < skeleton.shape[0] and 0 <= q[1] < skeleton.shape[1] and skeleton[q]:
                new = c + float(np.hypot(dy, dx)) / (1.0 + float(clearance[q]))
                if new < cost.get(q, np.inf):
                    cost[q], back[q] = new, at
                    heapq.heappush(heap, (new, q))
    return cost, back


def nearest_pixel(skeleton: np.ndarray, to: tuple[int, int]) -> tuple[int, int]:
    at = np.argwhere(skeleton)
    return tuple(int(v) for v in at[((at - np.array(to)) ** 2).sum(axis=1).argmin()])


def arm_paths(skeleton: np.ndarray, root: tuple[int, int], clearance: np.ndarray, *, most: int = 8, shortest: float = 8.0, own: float = 0.3, tips_apart: float = 6.0) -> list[list[tuple[int, int]]]:
    """Paths from the root to ends of the skeleton, longest first: long enough, with a share of pixels no longer path has, and
    with a tip away from other tips."""
    _, back = shortest_tree(skeleton, root, clearance)
    paths = []
    for y, x in np.argwhere(degree(skeleton) == 1):
        at, path = (int(y), int(x)), []
        if at not in back or at == root:
            continue
        while at is not None:
            path.append(at)
            at = back[at]
        paths.append(path[::-1])
    kept, used = [], set()
    for path in sorted(paths, key=lambda p: (-length(np.array(p, float)), p[-1])):
        fresh = [q for q in path if q not in used]
        tip = np.array(path[-1])
        if length(np.array(path, float)) < shortest or len(fresh) < own * len(path) or any(np.hypot(*(tip - np.array(k[-1]))) < tips_apart for k in kept):
            continue
        kept.append(path)
        used.update(path)
        if len(kept) == most:
            break
    return kept


def length(points: np.ndarray) -> float:
    return float(np.hypot(*np.diff(points, axis=0).T).sum()) if len(points) > 1 else 0.0


def resampled_curve(points: np.ndarray, n: int, rounds: int = 2) -> np.ndarray:
    """n points at even arc lengths of a curve smoothed by cutting corners; ends stay."""
    p = np.asarray(points, float)
    for _ in range(rounds if len(p) > 2 else 0):
        a, b = p[:-1], p[1:]
        p = np.concatenate([p[:1], np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], axis=1).reshape(-1, 2), p[-1:]])
    s = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    at = np.linspace(0, s[-1], n)
    return np.stack([np.interp(at, s, p[:, k]) for k in range(2)], axis=1)


def around(paths: list[list[tuple[int, int]]], root: tuple[int, int]) -> list[list[tuple[int, int]]]:
    """Paths in order of their tips' angle around the root."""
    return sorted(paths, key=lambda p: (float(np.arctan2(p[-1][0] - root[0], p[-1][1] - root[1])), p[-1]))


def skeleton_graph(mask: np.ndarray, *, points: int = 5, spur: int = 4, **gates) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(nodes, edges) of a mask: mantle, head and ``points`` nodes an arm from base to tip, edges between neighbours."""
    m = filled(largest_component(mask))
    columns = ["node_key", "branch_id", "x", "y", "is_center", "is_head", "is_tip"]
    nodes, edges = [], []
    if m.any():
        skeleton, clearance, parts = without_spurs(thinned(m), spur), distance(m), body_parts(m)
        root = nearest_pixel(skeleton, parts["mantle"])
        nodes.append(("MantleCenter", 0, root[1], root[0], True, False, False))
        if parts["head"]:
            nodes.append(("Head", 0, parts["head"][1], parts["head"][0], False, True, False))
            edges.append(("MantleCenter", "Head"))
        for k, path in enumerate(around(arm_paths(skeleton, root, clearance, **gates), root), 1):
            before = "MantleCenter"
            for i, (y, x) in enumerate(resampled_curve(np.array(path), points + 1)[1:], 1):
                name = f"Arm{k}_{'Tip' if i == points else f'P{i}'}"
                nodes.append((name, k, float(x), float(y), False, False, i == points))
                edges.append((before, name))
                before = name
    return pd.DataFrame(nodes, columns=columns), pd.DataFrame(edges, columns=["a", "b"])


def block_flow(before: np.ndarray, frame: np.ndarray, block: int = 8, reach: int = 4) -> np.ndarray:
    """(dy, dx) of each block of ``before``: where in ``frame``, within reach, its pixels stand with the least absolute difference;
    the smallest move among equals."""
    h, w = (before.shape[0] // block) * block, (before.shape[1] // block) * block
    a, best, flow = before[:h, :w].astype(float), np.full((h // block, w // block), np.inf), np.zeros((h // block, w // block, 2), int)
    moves = sorted(((dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)), key=lambda m: (m[0] ** 2 + m[1] ** 2, m))
    for dy, dx in moves:
        gap = np.abs(shifted(frame.astype(float), dy, dx, np.inf)[:h, :w] - a).reshape(h // block, block, w // block, block).sum(axis=(1, 3))
        closer = gap < best
        best[closer], flow[closer] = gap[closer], (dy, dx)
    return flow


def consistent_flow(before: np.ndarray, frame: np.ndarray, block: int = 8, reach: int = 4, most: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """(flow, whether the way there and back ends within ``most`` pixels of where it began)."""
    there, back = block_flow(before, frame, block, reach), block_flow(frame, before, block, reach)
    y, x = np.indices(there.shape[:2])
    ty = np.clip(np.round((y * block + there[..., 0]) / block).astype(int), 0, there.shape[0] - 1)
    tx = np.clip(np.round((x * block + there[..., 1]) / block).astype(int), 0, there.shape[1] - 1)
    return there, np.hypot(*np.moveaxis(there + back[ty, tx], -1, 0)) <= most


def warped(mask: np.ndarray, flow: np.ndarray, block: int = 8) -> np.ndarray:
    """A mask moved block by block."""
    out = np.zeros_like(mask)
    for by, bx in np.ndindex(flow.shape[:2]):
        for y, x in np.argwhere(mask[by * block : (by + 1) * block, bx * block : (bx + 1) * block]):
            q = y + by * block + flow[by, bx, 0], x + bx * block + flow[by, bx, 1]
            if 0 <= q[0] < out.shape[0] and 0 <= q[1] < out.shape[1]:
                out[q] = mask[y + by * block, x + bx * block]
    return out


def warped_median(frames: list[np.ndarray], values: list[np.ndarray], at: int, half: int = 2, block: int = 8) -> np.ndarray:
    """Per-pixel median of the neighbours' values, each moved along its flow to frame ``at``."""
    near = range(max(at - half, 0), min(at + half + 1, len(frames)))
    return np.median([values[k] if k == at else warped(values[k], block_flow(frames[k], frames[at], block), block) for k in near], axis=0)


def mask_agreement(predicted: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """(IoU, relative area error) on the truth's grid; two empty masks agree."""
    p, t = resized(predicted.astype(bool), *truth.shape), truth.astype(bool)
    either = (p | t).sum()
    return float((p & t).sum() / either) if either else 1.0, float(abs(int(p.sum()) - int(t.sum())) / max(int(t.sum()), 1))


def solidity(mask: np.ndarray) -> float:
    """Area over that of the convex hull of the pixels' corners."""
    y, x = np.nonzero(mask)
    if not len(x):
        return 0.0
    pts = sorted({(int(a) + i, int(b) + j) for a, b in zip(x, y, strict=True) for i in (0, 1) for j in (0, 1)})
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    hull: list = []
    for side in (pts, pts[::-1]):
        own: list = []
        for p in side:
            while len(own) > 1 and turn(own[-2], own[-1], p) <= 0:
                own.pop()
            own.append(p)
        hull += own[:-1]
    h = np.array(hull, float)
    area = abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2
    return float(len(x) / area)


# --- rows ---------------------------------------------------------------------------


def frame_changes(frames: DataFrame, group: str, t: str, frame: str, shape: tuple[int, ...]) -> DataFrame:
    """group, t, changed: the changed fraction to the frame before; 0 for a group's first. A group is one clip's frames."""

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        own = [np.frombuffer(f, np.uint8).reshape(shape) for f in pdf[frame]]
        return pd.DataFrame({group: pdf[group], t: pdf[t], "changed": [0.0, *(changed_fraction(a, b) for a, b in zip(own[:-1], own[1:], strict=True))]})

    kind = {c: frames.schema[c].dataType.simpleString() for c in (group, t)}
    return frames.select(group, t, frame).groupBy(group).applyInPandas(measure, f"{group} {kind[group]}, {t} {kind[t]}, changed double")


def averaged_masks(masks: DataFrame, group: str, t: str, mask: str, shape: tuple[int, int], alpha: float = 0.45, threshold: float = 0.5) -> DataFrame:
    """group, t, mask: exponentially averaged masks of a clip, cut at the threshold, their largest component (bytes)."""

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, out = pdf.sort_values(t), None, []
        for raw in pdf[mask]:
            now = np.frombuffer(raw, np.uint8).reshape(shape).astype(float)
            held = now if held is None else alpha * now + (1 - alpha) * held
            out.append(largest_component(held >= threshold).astype(np.uint8).tobytes())
        return pd.DataFrame({group: pdf[group], t: pdf[t], mask: out})

    kind = {c: masks.schema[c].dataType.simpleString() for c in (group, t)}
    return masks.select(group, t, mask).groupBy(group).applyInPandas(smooth, f"{group} {kind[group]}, {t} {kind[t]}, {mask} binary")


def graphs(masks: DataFrame, keys: list[str], mask: str, shape: tuple[int, int], build: Callable[[np.ndarray], tuple[pd.DataFrame, pd.DataFrame]] = skeleton_graph) -> DataFrame:
    """Nodes of every mask's skeleton graph with the mask's keys; a mask a row, no grouping."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                nodes, _ = build(np.frombuffer(getattr(row, mask), np.uint8).reshape(shape).astype(bool))
                yield nodes.assign(**{k: getattr(row, k) for k in keys})[[*keys, *nodes.columns]]

    kinds = ", ".join(f"{k} {masks.schema[k].dataType.simpleString()}" for k in keys)
    return masks.select(*keys, mask).mapInPandas(run, f"{kinds}, node_key string, branch_id int, x double, y double, is_center boolean, is_head boolean, is_tip boolean")
