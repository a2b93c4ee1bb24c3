"""The flow peak against plain Python: ties, mirrored windows, nulls, more frames than are judged at a time."""

import math
import random
from collections import Counter, defaultdict

from gatewise.operators import motion

SCHEMA = "frame_id long, vx double, vy double, bin string, n long"


def peak(pixels):
    """(n_pixels, n_peak, dx, dy) of one frame's (vx, vy)."""
    placed = []
    for vx, vy in pixels:
        b = math.floor((vy + 64.0) / 0.02) if vy is not None and abs(vy) >= 0.15 else -1
        if 0 <= b < 6400:
            placed.append((b, vx or 0.0, vy))
    hist = Counter(b for b, _, _ in placed)

    def span(c):
        half = int(max(0.25, 0.2 * abs((c + 0.5) * 0.02 - 64.0)) / 0.02)
        return max(0, c - half), min(6400, c + half + 1)

    def count(c):
        low, high = span(c)
        return sum(k for b, k in hist.items() if low <= b < high)

    near = sorted({c for b in hist for c in range(max(0, b - 700), min(6400, b + 701))})
    best = max(near, key=lambda c: (count(c), -c), default=None)
    if best is None or count(best) < max(0.03 * len(pixels), 2.0 * count(6399 - best), 1):
        return len(pixels), None, None, None
    low, high = span(best)
    inside = [(x, y) for b, x, y in placed if low <= b < high]
    return len(pixels), len(inside), round(sum(x for x, _ in inside) / len(inside) / 0.25, 6), round(sum(y for _, y in inside) / len(inside) / 0.25, 6)


def test_flow_peak(spark):
    r, frames = random.Random(4), defaultdict(list)
    for f in [None, *range(5)]:
        for _ in range(40):
            frames[f].append((r.choice([None, r.uniform(-2, 2)]), r.choice([None, 0.1, r.gauss(1.5, 0.2), r.gauss(9, 0.3), r.uniform(-70, 70)])))
    frames[5] = [(1.0, 2.0), (1.0, -2.0)]  # as much one way as the other
    frames[6] = [(None, None), (1.0, 0.0)]  # nothing moves
    frames[7] = [(0.5, 3.0)] + [(0.0, 0.0)] * 40  # too few
    frames[8] = [(0.0, 1.0), (4.0, 40.0)]  # windows of equal count
    for f in range(9, 9 + motion.FRAMES):
        frames[f] = [(0.25, 0.5 + f / 100)]
    data = [(f, x, y, "x", 7) for f, pixels in frames.items() for x, y in pixels]
    df = spark.createDataFrame(data, SCHEMA)
    got = {x.frame_id: (x.n_pixels, x.n_peak, *(None if v is None else round(v, 6) for v in (x.dx, x.dy))) for x in motion.flow_peak(df.coalesce(1)).collect()}
    assert got == {f: peak(p) for f, p in frames.items()}
    assert motion.flow_peak(df.limit(0)).collect() == []
