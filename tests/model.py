"""The merge replayed row by row in plain Python, as the yardstick of the tests."""

from __future__ import annotations

import zlib

NOW = 1_717_200_000_000_000
DAY = 86_400_000_000.0


def replay(src: dict, dst: dict) -> dict:
    """Merge dicts of row dicts; returns tables, id maps and counters."""
    out = {name: {r["id"]: dict(r) for r in dst[name]} for name in ("origins", "places", "visits")}
    stats = dict.fromkeys(
        [
            "origins_read", "origins_inserted", "origins_merged", "places_read",
            "places_inserted", "places_merged", "visits_read", "visits_inserted", "visits_skipped",
        ],
        0,
    )

    def add(table: str, row: dict) -> int:
        new = max(out[table], default=0) + 1
        out[table][new] = {**row, "id": new}
        return new

    by_id = lambda rows: sorted(rows, key=lambda r: r["id"])
    known = {(o["prefix"], o["host"]): o["id"] for o in by_id(dst["origins"])}
    origin_ids = {}
    for o in by_id(src["origins"]):
        stats["origins_read"] += 1
        key = (o["prefix"], o["host"])
        stats["origins_merged" if key in known else "origins_inserted"] += 1
        if key not in known:
            known[key] = add("origins", o)
        origin_ids[o["id"]] = known[key]

    known = {(p["url_hash"], p["url"] or ""): p["id"] for p in by_id(dst["places"])}
    place_ids = {}
    for p in by_id(src["places"]):
        stats["places_read"] += 1
        key = (p["url_hash"], p["url"] or "")
        origin = origin_ids.get(p["origin_id"])
        if key in known:
            stats["places_merged"] += 1
            d = out["places"][known[key]]
            d["visit_count"] += p["visit_count"]
            d["hidden"] = d["hidden"] or p["hidden"]
            d["typed"] = max(d["typed"], p["typed"])
            d["foreign_count"] += p["foreign_count"]
            dates = [x for x in (d["last_visit_date"], p["last_visit_date"]) if x is not None]
            d["last_visit_date"] = max(dates, default=None)
            d["origin_id"] = d["origin_id"] if origin is None else origin
            d["recalc_frecency"] = 1
        else:
            stats["places_inserted"] += 1
            row = {**p, "url": p["url"] or ""}
            row["origin_id"] = p["origin_id"] if origin is None else origin
            row["url_hash"] = zlib.crc32(row["url"].encode() + b"\xff")
            known[key] = add("places", row)
        place_ids[p["id"]] = known[key]

    key_of = lambda v: (v["place_id"], v["visit_date"], v["visit_type"])
    present = {key_of(v) for v in dst["visits"]}
    for v in by_id(src["visits"]):
        stats["visits_read"] += 1
        moved = {**v, "place_id": place_ids.get(v["place_id"], v["place_id"])}
        if key_of(moved) in present:
            stats["visits_skipped"] += 1
            continue
        stats["visits_inserted"] += 1
        present.add(key_of(moved))
        add("visits", moved)

    for p in out["places"].values():
        if p["recalc_frecency"] == 1:
            if p["last_visit_date"] is None or p["visit_count"] == 0:
                p["frecency"] = -1
            else:
                age = (NOW - p["last_visit_date"]) / DAY
                p["frecency"] = int(p["visit_count"] * 1000.0 / (age + 1))
            p["recalc_frecency"] = 0
    return {**out, "origin_ids": origin_ids, "place_ids": place_ids, "stats": stats}
