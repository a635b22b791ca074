"""The few vectorised helpers for which there is no built-in expression."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _segments(points) -> tuple[np.ndarray, np.ndarray]:
    p = np.array([(q["x"], q["y"]) for q in points], float).reshape(-1, 2)
    return (p, p) if len(p) == 1 else (p[:-1], p[1:])


def _point_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    d = b - a
    t = np.clip(((p[:, None] - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    return float(np.sqrt((((a + t[..., None] * d) - p[:, None]) ** 2).sum(-1)).min())


def _cross(a, b, c):
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def polygon_line_distance(ring, line) -> float | None:
    """0 where they touch or the line lies inside."""
    if ring is None or line is None or not len(ring) or not len(line):
        return None
    closed = list(ring) + [ring[0]]
    a, b = _segments(closed)
    c, d = _segments(line)
    s1, s2 = _cross(a[:, None], b[:, None], c[None]), _cross(a[:, None], b[:, None], d[None])
    s3, s4 = _cross(c[None], d[None], a[:, None]), _cross(c[None], d[None], b[:, None])
    if ((s1 * s2 < 0) & (s3 * s4 < 0)).any():
        return 0.0
    x, y = c[0]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / np.where(spans, b[:, 1] - a[:, 1], 1)
    if (spans & (x < at)).sum() % 2:
        return 0.0
    ends = np.concatenate((c, d[-1:]))
    return min(_point_segment(ends, a, b), _point_segment(a, c, d))


def ring_line_distance(ring: str, line: str):
    @F.pandas_udf("double")
    def run(r: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([polygon_line_distance(x, y) for x, y in zip(r, s, strict=True)], dtype="float64")

    return run(ring, line)


def cell_marks(xs: list, ys: list, wide: np.ndarray, cx0: np.ndarray, cx1: np.ndarray, cy0: np.ndarray, cy1: np.ndarray) -> list[np.ndarray]:
    """For each ring and the cells (cx, cy) of its box, cx first: 1 if an edge may touch the
    cell, give or take a 64th of its side, 2 if the ring holds it whole, else 0."""
    m, high = np.array([len(v) for v in xs]), cy1 - cy0 + 1
    n = (cx1 - cx0 + 1) * high
    x, y = np.concatenate(xs).astype(float), np.concatenate(ys).astype(float)
    first = np.cumsum(m) - m
    ahead = np.arange(1, len(x) + 1)
    ahead[first + m - 1] = first
    row = np.repeat(np.arange(len(m)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    cx, cy, side = cx0[row] + at // high[row], cy0[row] + at % high[row], wide[row]
    start = np.cumsum(m[row]) - m[row]
    c = np.repeat(np.arange(len(row)), m[row])
    e = np.repeat(first[row] - start, m[row]) + np.arange(len(c))
    ax, ay, bx, by = x[e], y[e], x[ahead[e]], y[ahead[e]]
    left, low = (cx * side - side / 64)[c], (cy * side - side / 64)[c]
    right, top = left + (side * (33 / 32))[c], low + (side * (33 / 32))[c]
    beside = (np.maximum(ax, bx) < left) | (np.minimum(ax, bx) > right) | (np.maximum(ay, by) < low) | (np.minimum(ay, by) > top)
    dx, dy = bx - ax, by - ay
    turns = [dx * (v - ay) - dy * (u - ax) for u in (left, right) for v in (low, top)]
    apart = (turns[0] > 0) & (turns[1] > 0) & (turns[2] > 0) & (turns[3] > 0) | (turns[0] < 0) & (turns[1] < 0) & (turns[2] < 0) & (turns[3] < 0)
    touched = np.logical_or.reduceat(~(beside | apart), start)
    mx, my = ((cx + 0.5) * side)[c], ((cy + 0.5) * side)[c]
    spans = (ay > my) != (by > my)
    inside = np.add.reduceat(spans & (mx < dx * (my - ay) / np.where(spans, dy, 1.0) + ax), start, dtype=int) % 2 == 1
    return np.split(np.where(touched, 1, np.where(inside, 2, 0)).astype(np.int8), np.cumsum(n)[:-1])


#: Pairs of an edge and a cell or box that are held at a time (the least is one ring's).
PAIRS = 1_000_000


def ring_marks(*columns: str):
    """cell_marks() of rows of xs, ys, wide, cx0, cx1, cy0, cy1."""

    @F.pandas_udf("array<tinyint>")
    def run(xs: pd.Series, ys: pd.Series, wide: pd.Series, cx0: pd.Series, cx1: pd.Series, cy0: pd.Series, cy1: pd.Series) -> pd.Series:
        rows = pd.DataFrame({"xs": xs, "ys": ys, "wide": wide, "cx0": cx0, "cx1": cx1, "cy0": cy0, "cy1": cy1})
        pairs = (xs.map(len) * (cx1 - cx0 + 1) * (cy1 - cy0 + 1)).cumsum()
        marks = [cell_marks(list(g["xs"]), list(g["ys"]), *(g[k].to_numpy() for k in ("wide", "cx0", "cx1", "cy0", "cy1"))) for _, g in rows.groupby(pairs // PAIRS)]
        return pd.Series([v for g in marks for v in g], dtype=object)

    return run.asNondeterministic()(*columns)  # else it is also evaluated where the rows are read, to filter empty arrays


def box_bounds(xs: list, ys: list, k: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each ring and its k boxes: how near the box comes to what the ring holds (0 where they
    touch, or where it is not known), and how far the point (px, py) lies from that: 0 only inside,
    where polygon_line_distance() gives 0 for a line that begins there; infinite if not known."""
    m = np.array([len(v) for v in xs])
    x, y = np.concatenate(xs).astype(float), np.concatenate(ys).astype(float)
    first = np.cumsum(m) - m
    ahead = np.arange(1, len(x) + 1)
    ahead[first + m - 1] = first
    row = np.repeat(np.arange(len(m)), k)
    start = np.cumsum(m[row]) - m[row]
    c = np.repeat(np.arange(len(row)), m[row])
    e = np.repeat(first[row] - start, m[row]) + np.arange(len(c))
    ax, ay, bx, by = x[e], y[e], x[ahead[e]], y[ahead[e]]
    dx, dy = bx - ax, by - ay
    square = np.maximum(dx * dx + dy * dy, 1e-300)

    def apart(u, v):
        t = np.clip(((u - ax) * dx + (v - ay) * dy) / square, 0, 1)
        return np.sqrt((ax + t * dx - u) ** 2 + (ay + t * dy - v) ** 2)

    def holds(u, v):
        spans = (ay > v) != (by > v)
        return np.add.reduceat(spans & (u < ax + (v - ay) * dx / np.where(spans, dy, 1)), start, dtype=int) % 2 == 1

    left, right, low, top = x0[c], x1[c], y0[c], y1[c]
    beside = (np.maximum(ax, bx) < left) | (np.minimum(ax, bx) > right) | (np.maximum(ay, by) < low) | (np.minimum(ay, by) > top)
    corners = [(u, v) for u in (left, right) for v in (low, top)]
    turns = [dx * (v - ay) - dy * (u - ax) for u, v in corners]
    aside = np.logical_and.reduce([t > 0 for t in turns]) | np.logical_and.reduce([t < 0 for t in turns])
    gap = np.hypot(np.maximum(0, np.maximum(left - ax, ax - right)), np.maximum(0, np.maximum(low - ay, ay - top)))
    for u, v in corners:
        gap = np.minimum(gap, apart(u, v))
    lower = np.minimum.reduceat(np.where(beside | aside, gap, 0.0), start)
    upper = np.maximum(np.minimum.reduceat(apart(px[c], py[c]), start), 1e-9)
    lower = np.where(holds(left, low) | np.isnan(lower), 0.0, lower)
    return lower, np.where(holds(px[c], py[c]), 0.0, np.where(np.isnan(upper), np.inf, upper))


def ring_box_bounds(*columns: str):
    """box_bounds() of rows of xs, ys and the arrays x0, x1, y0, y1, px, py."""

    @F.pandas_udf("lower array<double>, upper array<double>")
    def run(xs: pd.Series, ys: pd.Series, x0: pd.Series, x1: pd.Series, y0: pd.Series, y1: pd.Series, px: pd.Series, py: pd.Series) -> pd.DataFrame:
        k, lower, upper = x0.map(len), [], []
        pairs = (xs.map(len) * k).cumsum() // PAIRS
        for _, at in pairs.groupby(pairs).groups.items():
            n = k[at].to_numpy()
            if n.sum():
                with np.errstate(all="ignore"):
                    got = box_bounds(list(xs[at]), list(ys[at]), n, *(np.concatenate(list(v[at])).astype(float) for v in (x0, x1, y0, y1, px, py)))
            else:
                got = np.empty(0), np.empty(0)
            lower += np.split(got[0], np.cumsum(n)[:-1])
            upper += np.split(got[1], np.cumsum(n)[:-1])
        return pd.DataFrame({"lower": pd.Series(lower, dtype=object), "upper": pd.Series(upper, dtype=object)})

    return run.asNondeterministic()(*columns)


_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: Messages whose digests are made at a time.
MESSAGES = 32768


def md5_heads(words: list[np.ndarray | None]) -> np.ndarray:
    """The first 32 bits of the MD5 of messages of one block, in the order of the hex digests;
    words: the 16 words of a block, padding and length included, as uint32 arrays (None: 0)."""
    a, b, c, d = (np.full(len(words[0]), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three steps do not change the first word
        if i < 32:
            p, q, r, w = (c, d, b, i) if i < 16 else (b, c, d, (5 * i + 1) % 16)
            np.bitwise_xor(p, q, out=f)
            f &= r
            f ^= q
        elif i < 48:
            w = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            w = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if words[w] is not None:
            f += words[w]
        f += np.uint32(_SINES[i])
        np.left_shift(f, np.uint32(_TURNS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    b += np.uint32(0x67452301)
    return b.byteswap()


def _blocks(texts: list[bytes], shift: int) -> np.ndarray:
    """A row of little-endian words for each text, which begins at byte `shift`."""
    width = (shift + max(map(len, texts)) + 3) // 4 * 4
    return np.frombuffer(b"".join((b"\0" * shift + t).ljust(width, b"\0") for t in texts), "<u4").reshape(len(texts), -1).astype(np.uint32)


def least_digests(heads: list[bytes], tails: list[bytes], near) -> list[int]:
    """For each head, the place of the tail whose MD5 of head + tail is least among those that
    near(place of the head) lists (equal texts: the first listed); -1 if it lists none."""
    found = [-1] * len(heads)
    if not tails:
        return found
    digest = lambda i, j: hashlib.md5(heads[i] + tails[j], usedforsecurity=False).digest()
    longest = max(map(len, tails))
    by_length: dict[int, list[int]] = {}
    for i, h in enumerate(heads):
        by_length.setdefault(len(h), []).append(i)
    for size, group in by_length.items():
        if size + longest > 55:  # more than a block
            for i in group:
                found[i] = min(near(i).tolist(), key=lambda j: digest(i, j), default=-1)  # noqa: B023
            continue
        first, shift = divmod(size, 4)
        ends = _blocks([t + b"\x80" for t in tails], shift)
        bits = np.array([(size + len(t)) * 8 for t in tails], np.uint32)
        begins = _blocks([heads[i] for i in group], 0)

        def settle(batch, lists):
            at, j = np.repeat(batch, [len(v) for v in lists]), np.concatenate(lists)  # noqa: B023
            words = [begins[at, w] if w < begins.shape[1] else None for w in range(14)] + [bits[j], None]  # noqa: B023
            for w in range(ends.shape[1]):  # noqa: B023
                more = ends[j, w]  # noqa: B023
                words[first + w] = more if words[first + w] is None else words[first + w] | more  # noqa: B023
            got = md5_heads(words)
            starts = np.cumsum([0, *(len(v) for v in lists[:-1])])
            least = np.flatnonzero(got == np.repeat(np.minimum.reduceat(got, starts), [len(v) for v in lists]))
            for i, j in zip(at[least].tolist(), j[least].tolist(), strict=True):
                i = group[i]  # noqa: B023
                if found[i] < 0 or digest(i, j) < digest(i, found[i]):
                    found[i] = j

        batch, lists, held = [], [], 0
        for k, i in enumerate(group):
            some = near(i)
            for at in range(0, len(some), MESSAGES):
                part = some[at : at + MESSAGES]
                if held + len(part) > MESSAGES:
                    settle(batch, lists)
                    batch, lists, held = [], [], 0
                batch.append(k)
                lists.append(part)
                held += len(part)
        if held:
            settle(batch, lists)
    return found


def draw_near(centers: pd.DataFrame, points: pd.DataFrame, radius: float, seed: int) -> pd.DataFrame:
    """(center_id, h, poi_id): of the points within radius of a centre the one of the least h, the
    MD5 of center_id#poi_id#seed (ties by poi_id)."""
    points = points.sort_values("poi_id")
    x, y, ids = points["x"].to_numpy(float), points["y"].to_numpy(float), points["poi_id"].tolist()
    cx, cy, keys = centers["cx"].to_numpy(float), centers["cy"].to_numpy(float), centers["center_id"].tolist()

    def near(i):
        dx, dy = x - cx[i], y - cy[i]
        return np.flatnonzero(dx * dx + dy * dy <= radius * radius)

    heads, tails = [f"{k}#".encode() for k in keys], [f"{v}#{seed}".encode() for v in ids]
    rows = [(keys[i], hashlib.md5(heads[i] + tails[j], usedforsecurity=False).hexdigest(), ids[j]) for i, j in enumerate(least_digests(heads, tails, near)) if j >= 0]
    return pd.DataFrame(rows, columns=["center_id", "h", "poi_id"])


def rank_near(centers: pd.DataFrame, points: pd.DataFrame, radius: float, limit: int) -> pd.DataFrame:
    """(center_id, prefix, poi_id, distance): the nearest `limit` points of each prefix within
    radius of each centre, ties by poi_id."""
    points = points.sort_values(["prefix", "poi_id"])
    x, y, prefix, ids = points["x"].to_numpy(float), points["y"].to_numpy(float), points["prefix"].to_numpy(), points["poi_id"].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1], [True])))
    at, found, far = [], [], []
    for i, (cx, cy) in enumerate(zip(centers["cx"].to_numpy(float), centers["cy"].to_numpy(float), strict=True)):
        dx, dy = cx - x, cy - y
        distance = np.sqrt(dx * dx + dy * dy)
        inside = np.flatnonzero(distance <= radius)
        cuts, near = np.searchsorted(inside, starts).tolist(), distance[inside]
        for a, b in zip(cuts, cuts[1:]):
            if b == a:
                continue
            d, j = near[a:b], inside[a:b]
            if b - a > limit:
                few = np.flatnonzero(d <= np.partition(d, limit - 1)[limit - 1])
                d, j = d[few], j[few]
            order = np.argsort(d, kind="stable")[:limit]
            at.append(np.full(len(order), i))
            found.append(j[order])
            far.append(d[order])
    if not at:
        return pd.DataFrame([], columns=["center_id", "prefix", "poi_id", "distance"])
    at, found = np.concatenate(at), np.concatenate(found)
    return pd.DataFrame({"center_id": centers["center_id"].to_numpy()[at], "prefix": prefix[found], "poi_id": ids[found], "distance": np.concatenate(far)})


def box_counts(x: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """How many of the points (x, y) lie strictly inside each box.

    By x a box is an interval of the points in that order, by y one of ranks.  Bit by bit from
    the top, points are parted by that bit of their rank, keeping their order, and each box
    counts those below its rank: a wavelet matrix, made and asked at once."""
    order = np.argsort(x, kind="stable")
    at, ranks = x[order], np.sort(y)
    left = np.searchsorted(at, x0, "right")
    right = np.maximum(left, np.searchsorted(at, x1, "left"))
    low = np.searchsorted(ranks, y0, "right")
    below = np.concatenate((low, np.maximum(low, np.searchsorted(ranks, y1, "left"))))
    left, right, total = np.tile(left, 2), np.tile(right, 2), np.zeros(2 * len(x0), np.int64)
    now = np.searchsorted(ranks, y[order], "left")
    for bit in reversed(range(len(x).bit_length())):
        one = (now >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        l0, r0, up = zeros[left], zeros[right], (below >> bit & 1).astype(bool)
        total += np.where(up, r0 - l0, 0)
        left, right = np.where(up, zeros[-1] + left - l0, l0), np.where(up, zeros[-1] + right - r0, r0)
        now = np.concatenate((now[~one], now[one]))
    return total[len(x0) :] - total[: len(x0)]


def count_boxes(boxes: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """(aoi_id, points) of box_counts(); boxes with none are left out."""
    n = box_counts(*(points[k].to_numpy(float) for k in ("x", "y")), *(boxes[k].to_numpy(float) for k in ("x0", "x1", "y0", "y1")))
    return pd.DataFrame({"aoi_id": boxes["aoi_id"].to_numpy(), "points": n})[n > 0]


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def bleu(reference: list[str], candidate: list[str], order: int = 4, epsilon: float = 0.1) -> float:
    """Sentence BLEU with uniform weights; a zero count becomes epsilon."""
    if not candidate or not reference:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        have, want = _grams(candidate, n), _grams(reference, n)
        total = max(1, sum(have.values()))
        match = sum(min(c, want[g]) for g, c in have.items())
        if n == 1 and not match:
            return 0.0
        logs += math.log((match or epsilon) / total) / order
    short = 1.0 if len(candidate) > len(reference) else math.exp(1 - len(reference) / len(candidate))
    return short * math.exp(logs)


def rouge_n(reference: list[str], candidate: list[str], n: int) -> float:
    """F measure of shared n-grams."""
    have, want = _grams(candidate, n), _grams(reference, n)
    match = sum((have & want).values())
    return 2 * match / (sum(have.values()) + sum(want.values())) if match else 0.0


def rouge_l(reference: list[str], candidate: list[str]) -> float:
    """F measure of the longest common subsequence."""
    if not reference or not candidate:
        return 0.0
    row = [0] * (len(candidate) + 1)
    for a in reference:
        before = 0
        for j, b in enumerate(candidate):
            before, row[j + 1] = row[j + 1], before + 1 if a == b else max(row[j + 1], row[j])
    return 2 * row[-1] / (len(reference) + len(candidate))


def words(text: str | None) -> list[str]:
    """Words by white space; each character of a text without white space and with
    characters beyond Latin counts by itself."""
    text = text or ""
    parts = text.split()
    return list(text.strip()) if len(parts) <= 1 and any(ord(c) > 0x2E80 for c in text) else parts


def similarity_scores(pred: str, ref: str):
    @F.pandas_udf("bleu4 double, rouge1 double, rouge2 double, rougel double")
    def run(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(p, r, strict=True):
            c, w = words(a), words(b)
            rows.append((bleu(w, c), rouge_n(w, c, 1), rouge_n(w, c, 2), rouge_l(w, c)))
        return pd.DataFrame(rows, columns=["bleu4", "rouge1", "rouge2", "rougel"]).round(6)

    return run(pred, ref)


def best_option_of(text: str | None, options) -> int:
    """Place (from 0) of the option that a text names: equal, else the best BLEU over
    0.01 (ties: more different characters shared, then the first); -1 for none."""
    text = (text or "").strip()
    options = [o or "" for o in (options if options is not None else [])]
    if text in options:
        return options.index(text)
    scored = [(bleu(words(o), words(text)), len(set(o) & set(text)), -i) for i, o in enumerate(options)]
    best = max(scored, default=(0.0, 0, 0))
    return -best[2] if best[0] > 0.01 else -1


def best_option(text: str, options: str):
    @F.pandas_udf("long")
    def run(t: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([best_option_of(a, b) for a, b in zip(t, o, strict=True)], dtype="int64")

    return run(text, options)
