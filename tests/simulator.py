"""A sequential model of the attribution rules, for tests only."""

from __future__ import annotations


def simulate(events, lateness, window):
    """``events``: dicts with kind, id, user_id, ts, p, in order of arrival.
    Returns emitted views (id -> click id) and late ids."""
    latest, pending, clicks, out, late = {}, {}, {}, {}, []
    for e in events:
        p = e["p"]
        if p in latest and e["ts"] < latest[p] - lateness:
            late.append(e["id"])
            continue
        latest[p] = max(latest.get(p, e["ts"]), e["ts"])
        if e["kind"] == "click":
            clicks.setdefault(e["user_id"], []).append((e["ts"], e["id"]))
        else:
            pending.setdefault(p, {})[e["id"]] = e
        for id_, v in sorted(pending.get(p, {}).items(), key=lambda x: (x[1]["ts"], x[0])):
            if v["ts"] <= latest[p] - lateness:
                near = [c for c in clicks.get(v["user_id"], []) if v["ts"] - window <= c[0] <= v["ts"]]
                out[id_] = max(near)[1] if near else None
                del pending[p][id_]
    return out, late
