"""A replay of changelogs in plain Python: what the folds must leave."""

from __future__ import annotations

import random


def replay_value(log):
    state = {}
    for r in sorted(log, key=lambda r: r["seq"]):
        if r["op"] == "DELETE":
            state.pop(r["k"], None)
        else:
            state[r["k"]] = r["value"]
    return state


def replay_list(log, key=lambda r: r["k"]):
    state = {}
    for r in sorted(log, key=lambda r: r["seq"]):
        if r["op"] == "DELETE":
            state.pop(key(r), None)
        elif r["op"] == "PUT":
            state[key(r)] = [r["value"]]
        else:
            state.setdefault(key(r), []).append(r["value"])
    return state


def replay_map(log, key=lambda r: r["k"]):
    state = {}
    for r in sorted(log, key=lambda r: r["seq"]):
        if r["op"] == "CLEAR":
            state.pop(key(r), None)
        elif r["op"] == "DELETE":
            state.get(key(r), {}).pop(r["uk"], None)
        else:
            state.setdefault(key(r), {})[r["uk"]] = r["value"]
    return {k: m for k, m in state.items() if m}


def replay_timers(log):
    state = set()
    for r in sorted(log, key=lambda r: r["seq"]):
        (state.add if r["op"] == "PUT" else state.discard)((r["ts"], r["k"]))
    return state


def random_log(seed, mix, rows=10_000, universe=30):
    """Writes over small universes of keys, namespaces and user keys, so that they collide; ``mix``: verb to weight."""
    rng = random.Random(seed)
    keys, spaces, users = ([f"{c}{i}" for i in range(universe)] for c in "knu")
    verbs, weights = zip(*mix.items())
    made = [(rng.choice(keys), rng.choice(spaces), rng.choice(users), rng.choices(verbs, weights)[0], float(rng.randrange(1000))) for _ in range(rows)]
    order = rng.sample(range(rows * 2), rows)
    return [dict(zip(("k", "ns", "uk", "op", "value", "seq"), (*m, s))) for m, s in zip(made, order)]
