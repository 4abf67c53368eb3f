"""The simulation against a loop written from its definition, on random data."""

import math
import random
from collections import defaultdict

from tacitra.operators import curves as V
from tacitra.operators import simulate as S

RAMP = [0.40, 0.55, 0.65, 0.75, 0.82, 0.88, 0.93, 0.96, 0.98, 1.0, 1.0, 1.0]


def half_even(x, places):
    return round(round(x, 9), places)


def expected(departed, profile, edges, roles):
    """(log, months, losses) by plain loops over dictionaries."""
    know0, count = {(p, t): s for p, t, _, s in profile}, {(p, t): c for p, t, c, _ in profile}
    topics_of, holders = defaultdict(list), defaultdict(list)
    for p, t in sorted(know0):
        topics_of[p].append(t)
        holders[t].append(p)
    near = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    room = {p: 0.0 for p, _ in know0}
    log, months, losses = [], {}, []
    bandwidth = {r.person: r.bandwidth for r in roles["bandwidth"]}
    schedule = {(r.departed, r.topic): r.n_requests for r in roles["schedule"]}
    for d in departed:
        first = {q for q, w in near[d].items() if w >= 5}
        second = {r for q in first for r, w in near[q].items() if w >= 3 and r != d} - first
        most = max(near[d].values(), default=0)
        memory, know, index = defaultdict(float), dict(know0), {}
        ready = {}
        for t in topics_of[d]:
            index[t] = sorted((p for p in holders[t] if p != d), key=lambda p: (-know0[p, t], p))
            for p in index[t]:
                shared = len(set(topics_of[d]) & set(topics_of[p]))
                r = 0.4 * know0[p, t] + 0.3 * shared / len(topics_of[d]) + 0.3 * (near[d].get(p, 0) / most if most else 0)
                same = roles["role"].get(d, "Administration") == roles["role"].get(p, "Administration")
                ready[t, p] = half_even(r if same else min(r, 0.15), 4)
        low = defaultdict(dict)
        for month in range(1, 13):
            used, total, lost, n_all = defaultdict(int), 0.0, 0, 0
            for t in topics_of[d]:
                n, q = schedule[d, t], 0.0
                for _ in range(n):
                    best = {}
                    for p in index[t]:
                        tier = 1 if p in first else 2 if p in second else 3
                        if used[p] >= bandwidth[p]:
                            continue
                        eff = min(1.0, know[p, t] + memory[p, t]) * {1: 1.0, 2: 0.7, 3: 0.4}[tier]
                        if eff > 0.4 and (tier not in best or eff > best[tier][0]):
                            best[tier] = (eff, p)
                    n_all += 1
                    if not best:
                        lost += 1
                        log.append((d, month, t, None, 4))
                        continue
                    tier = min(best)
                    eff, p = best[tier]
                    ratio = min(1.0, min(1.0, know[p, t] + memory[p, t]) / know0[d, t]) * ready[t, p] * RAMP[month - 1]
                    q += ratio
                    used[p] += 1
                    memory[p, t] = min(1.0, memory[p, t] + (0.03 if eff > 0.7 else 0.015))
                    if memory[p, t] >= 0.30 and memory[p, t] > know[p, t]:
                        know[p, t] = memory[p, t]
                        index[t].sort(key=lambda x: -know[x, t])
                    log.append((d, month, t, p, tier))
                low[t][month] = q / n
                total += q
            months[d, month] = (n_all, n_all - lost, lost, half_even(total / n_all, 4), half_even(lost / n_all, 4))
        for t, q in low.items():
            month = next((m for m in range(6, 13) if all(q[k] < 0.30 for k in range(m - 5, m + 1))), None)
            if month:
                losses.append((d, t, month))
    return log, months, losses


def test_against_the_loop(spark):
    rnd = random.Random(12)
    persons = [f"p{i:02d}" for i in range(24)]
    profile = [(p, t, rnd.randrange(1, 60), round(rnd.choice([rnd.random(), 0.3, 0.5, 1.0]), 3)) for p in persons for t in range(12) if rnd.random() < 0.45]
    edges = [(a, b, float(rnd.choice([1, 2, 3, 4, 5, 6, 9]))) for i, a in enumerate(persons) for b in persons[i + 1 :] if rnd.random() < 0.35]
    role = {p: rnd.choice(["Legal", "Trading", "Research"]) for p in persons[:18]}
    departed = sorted(set(persons[:8]) & {p for p, *_ in profile})
    P = spark.createDataFrame(profile, "person string, topic int, cnt bigint, score double")
    E = spark.createDataFrame(edges, "src string, dst string, weight double")
    ready = S.readiness(spark.createDataFrame([(p,) for p in departed], "person string"), P, E, spark.createDataFrame(list(role.items()), "person string, role string"))
    from tacitra.operators.expertise import bandwidth, request_schedule

    own = P.where(P.person.isin(departed)).withColumnsRenamed({"person": "departed", "score": "dep_score"})
    given = {"role": role, "bandwidth": bandwidth(P).collect(), "schedule": request_schedule(own.select("departed", "topic", "dep_score", "cnt")).collect()}
    assert all(r.n_requests >= 1 for r in given["schedule"]) and all(math.isfinite(r.bandwidth) for r in given["bandwidth"])
    log, months, losses = expected(departed, profile, edges, given)
    got = S.simulate(S.candidates(ready, P, E)).cache()
    assert sorted((r.departed, r.month, r.topic, r.agent or "", r.step) for r in got.collect()) == sorted((d, m, t, p or "", s) for d, m, t, p, s in log)
    assert {r[3] for r in log} - {None} and any(s == 4 for *_, s in log) and any(s == 2 for *_, s in log)
    lines = {(r.departed, r.month): (r.n_requests, r.n_recovered, r.n_lost, r.recovery_rate, r.loss_rate) for r in S.timeline(got).collect()}
    assert lines.keys() == months.keys()
    for k, (n, done, lost, rate, loss) in months.items():
        assert lines[k][:3] == (n, done, lost) and abs(lines[k][3] - rate) <= 1.01e-4 and abs(lines[k][4] - loss) <= 1.01e-4
    assert sorted((r.person, r.topic, r.month) for r in V.permanent_loss(S.topic_quality(got)).collect()) == sorted(losses) and losses
