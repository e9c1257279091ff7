"""Gluing in order, one pair at a time, with links to neighbours."""

from __future__ import annotations

from heapq import heapify, heappop, heappush


def glue_rows(rows: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Glues instances (block_id, sign, chr, start, end) until nothing can be glued.

    The smallest block that can be glued goes first, takes up the block that always
    follows it and keeps its id. The order matters: other orders can end elsewhere.
    Instances are linked to their neighbours, so a step costs what it changes.
    """
    rows = sorted(rows, key=lambda r: (r[2], r[3], r[4], r[0]))
    block, sign = [r[0] for r in rows], [r[1] for r in rows]
    start, end = [r[3] for r in rows], [r[4] for r in rows]
    n = len(rows)
    before = [i - 1 if i and rows[i - 1][2] == rows[i][2] else -1 for i in range(n)]
    after = [i + 1 if i + 1 < n and rows[i + 1][2] == rows[i][2] else -1 for i in range(n)]
    places: dict[int, list[int]] = {}
    for i, b in enumerate(block):
        places.setdefault(b, []).append(i)

    def follower(b: int) -> int | None:
        """The signed block that always follows b, if b can be glued to it."""
        found = None
        for i in places.get(b, ()):
            j = after[i] if sign[i] > 0 else before[i]
            own = None if j < 0 else sign[i] * sign[j] * block[j]
            if own is None or abs(own) == b or (found is not None and own != found):
                return None
            found = own
        return found if found is not None and len(places[abs(found)]) == len(places[b]) else None

    ready = [b for b in places if follower(b) is not None]
    heapify(ready)
    while ready:
        b = heappop(ready)
        other = follower(b)
        if other is None:
            continue
        touched = {b}
        for i in places[b]:
            j = after[i] if sign[i] > 0 else before[i]
            start[i], end[i] = min(start[i], start[j]), max(end[i], end[j])
            if sign[i] > 0:
                after[i] = after[j]
                if after[j] >= 0:
                    before[after[j]] = i
            else:
                before[i] = before[j]
                if before[j] >= 0:
                    after[before[j]] = i
            touched.update(block[k] for k in (before[i], after[i]) if k >= 0)
        del places[abs(other)]
        for t in touched:
            if follower(t) is not None:
                heappush(ready, t)
    return [(b, sign[i], rows[i][2], start[i], end[i]) for b, at in places.items() for i in at]
