"""The rules of the detectors as one pass over messages in order, for comparison with the operators."""

from collections import defaultdict
from statistics import median


def origins(ops):
    """ops: (seq, op, key, origin); yields (seq, previous, origin, changed, distinct)."""
    state = {}
    for seq, op, key, origin in ops:
        if op == "W":
            state.pop(key, None)
            continue
        if origin is None:
            continue
        last, seen = state.get(key, (None, []))
        fresh = origin not in seen
        if fresh and len(seen) < 16:
            seen = [*seen, origin]
        yield seq, last, origin, last is not None and fresh, len(seen)
        state[key] = (origin, seen)


def edges(paths, ttl, sweep):
    """paths: (us, path); yields up (a, b, us) and down (lo, hi, us), sweeps up to the last message."""
    last = {}
    out = []
    tick = None

    def sweep_to(now):
        nonlocal tick
        tick = tick if tick is not None else 0
        while tick < now:
            for key, seen in sorted(last.items()):
                if seen < tick - ttl:
                    out.append(("down", *key, tick))
                    del last[key]
            tick += sweep

    for us, path in paths:
        sweep_to(us)
        for a, b in zip(path, path[1:], strict=False):
            if a == b:
                continue
            key = (min(a, b), max(a, b))
            if key not in last:
                out.append(("up", a, b, us))
            last[key] = us
    return out


def leaks(messages, rel, window):
    """messages: (seq, us, path); rel(a, b); yields (seq, offender, violations, reported)."""
    before = {}
    for seq, us, path in messages:
        hits = []
        for i in range(len(path) - 2, 0, -1):
            y = path[i]
            into, out = rel(y, path[i + 1]), rel(y, path[i - 1])
            if into in ("customer", "peer") and out in ("customer", "peer"):
                hits.append(y)
        if hits:
            old = before.get(hits[0])
            before[hits[0]] = us
            yield seq, hits[0], len(hits), old is None or us - old >= window


def churn(ops, window, k, floor, min_updates, capacity=1024, min_samples=32):
    """ops: (seq, us, prefix, peer); yields (seq, count, threshold) where an episode begins."""
    times, latch, ring = defaultdict(list), {}, []
    for seq, us, prefix, peer in ops:
        key = (prefix, peer)
        times[key] = [t for t in times[key] if t >= us - window] + [us]
        n = len(times[key])
        ring = [*ring, n][-capacity:]
        above = False
        if n >= min_updates:
            threshold = floor
            if len(ring) >= min_samples:
                m = median(ring)
                threshold = max(m + k * 1.4826 * median(abs(x - m) for x in ring), floor)
            above = n > threshold
            if above and not latch.get(key):
                yield seq, n, threshold
        latch[key] = above
