"""Step functions of the two order-dependent machines, shared by batch and streaming jobs.

Times are microseconds. States are small dictionaries that survive a JSON round trip.
"""

from __future__ import annotations

STATE, CLOCK, FRAME, DISCONNECT = 0, 1, 2, 3


def lane_start(n_loops: int) -> dict:
    return {"levels": [False] * n_loops, "anchor": None, "times": [], "frames": 0}


def _close(s: dict, at: int, clear: int | None, capped: bool, n_loops: int) -> dict:
    done = {
        "entry": s["times"][0],
        "engage": s["times"][-1] if len(s["times"]) == n_loops else None,
        "clear": clear,
        "ended": at,
        "n_loop_times": len(s["times"]),
        "frame_cap_hit": capped,
    }
    s["times"], s["frames"] = [], 0
    # Loops are level-triggered: an entry loop still engaged starts the next debounce at once.
    s["anchor"] = at if s["levels"][0] else None
    return done


def _engage(s: dict, at: int, n_loops: int) -> None:
    while len(s["times"]) < n_loops and s["levels"][len(s["times"])]:
        s["times"].append(at)


def _settle(s: dict, now: int, cfg: dict, out: list) -> None:
    """Everything that falls due by ``now`` with the levels as they stand."""
    n = cfg["n_loops"]
    while True:
        if s["times"]:
            limit = s["times"][0] + cfg["max_us"]
            if limit > now:
                return
            out.append(_close(s, limit, None, False, n))
        else:
            if s["anchor"] is None or s["anchor"] + cfg["debounce_us"] > now:
                return
            entry = s["anchor"] + cfg["debounce_us"]
            s["times"], s["anchor"], s["frames"] = [entry], None, 0
            _engage(s, entry, n)


def advance_lane(state: dict | None, rows, cfg: dict) -> tuple[list, dict]:
    """Fold ordered (ts, kind, loops) rows of one lane into passes.

    Entry fires when loop 0 stays engaged for the debounce; the pass advances through the loops in
    order, completes when the exit loop clears and otherwise ends at the time limit or frame cap.
    """
    n = cfg["n_loops"]
    s = state or lane_start(n)
    out: list = []
    for r in rows:
        ts, kind = int(r["ts"]), r["kind"]
        _settle(s, ts, cfg, out)
        if kind == FRAME:
            if s["times"]:
                s["frames"] += 1
                if s["frames"] >= cfg["max_frames"]:
                    out.append(_close(s, ts, None, True, n))
            continue
        if kind == CLOCK:
            continue
        loops = [False] * n if kind == DISCONNECT else r["loops"]
        given = len(loops)
        s["levels"] = [
            bool(loops[i]) if i < given and loops[i] is not None else s["levels"][i] for i in range(n)
        ]
        if not s["times"]:
            s["anchor"] = (ts if s["anchor"] is None else s["anchor"]) if s["levels"][0] else None
        elif len(s["times"]) == n:
            if not s["levels"][-1]:
                out.append(_close(s, ts, ts, False, n))
        else:
            _engage(s, ts, n)
    return out, s


# Net rows that lock the travel direction, and the most backward motion remembered.
LOCK_ROWS, DEBT_ROWS = 24.0, 48.0


def _owed(go: int, due: float, dy: float) -> tuple[int, float]:
    """Direction and rows owed after one more frame; without a direction yet, rows owed are signed."""
    if go:
        return go, max(due + go * dy, -DEBT_ROWS)
    net = due + dy
    return (0, net) if abs(net) < LOCK_ROWS else (1 if net > 0 else -1, abs(net))


def next_strip(go: int, due: float, moved: float | None) -> tuple[int, float, int]:
    """Direction, rows still owed and whole rows that join the image after one more frame."""
    go, due = _owed(go, due, float(moved) if moved is not None and moved == moved else 0.0)
    whole = int(due) if go and due >= 1 else 0
    return go, due - whole, whole


def strip_rows(whole: int, frame_rows: int | None) -> int:
    """Half a frame at most."""
    return whole if frame_rows is None else min(whole, int(frame_rows) // 2)


def fold_strips(state: dict | None, rows, cfg: dict) -> tuple[list, dict]:
    """The stream's form of the strip plan: ordered (seq, frame_rows, dy) rows of one pass to strips.

    The first row of a pass only serves as reference.
    """
    rows = list(rows)
    go, due = (cfg["direction"], 0.0) if state is None else (state["go"], state["due"])
    strips = []
    for row in rows if state else rows[1:]:
        go, due, whole = next_strip(go, due, row["dy"])
        if whole:
            strips.append({"seq": int(row["seq"]), "rows": strip_rows(whole, row["frame_rows"]), "at_top": go > 0})
    return strips, ({"go": go, "due": due} if rows or state else None)
