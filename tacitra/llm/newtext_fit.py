"""Fits the sequence model of ``newtext`` on a bounded sample of mails.

No table holds labelled lines, so the sample is labelled by rules of high precision: each cue has a score under each
label, set by hand, and neighbouring labels have scores too. The model is an averaged structured perceptron with a margin
over the features of ``newtext`` that starts from those scores; while it learns, cues that rest on word lists are hidden at
random, so that shape, neighbours and position must tell what such a line is, and mails are cut to random stretches of
lines, so that short ones are seen too.

    python -m tacitra.llm.newtext_fit MAILS.parquet [HELD_OUT.parquet]

writes newtext_model.json beside this module and prints the share of lines labelled alike on mails outside the sample,
with all cues and with all worded cues hidden.
"""

from __future__ import annotations

import json
import os
import random
import sys
from collections import defaultdict

import xxhash

from tacitra.llm.newtext import NEW, NOTICE, WORDED, Model, _cues, line_features, neighbour_features, own_features, place_features

#: The most mails that are labelled and learned from; those with the smallest hashes of their row id.
MOST_MAILS = 10000
EPOCHS, HIDDEN, MARGIN, CUT, PRIOR = 12, 0.12, 4.0, 0.3, 4.0

# Scores of each cue under (new, quoted, signature, notice).
SCORES = {
    "prefixed": (-9.0, 9.0, -9.0, -9.0),
    "indented": (-5.0, 6.0, -5.0, -5.0),
    "attribution": (-9.0, 9.0, -9.0, -9.0),
    "history": (-30.0, 30.0, -30.0, -30.0),
    "closing": (-2.0, -3.0, 4.0, -6.0),
    "name": (-1.0, -3.0, 1.5, -4.0),
    "initials": (-1.0, -3.0, 1.5, -4.0),
    "contact": (-2.0, -3.0, 2.5, -4.0),
    "starred": (-2.0, -3.0, 4.0, -4.0),
    "rule": (-2.0, -3.0, 1.5, 1.5),
    "device": (-2.0, -3.0, 5.0, -4.0),
    "notice": (-3.0, -3.0, -2.0, 6.0),
    "legal": (-3.0, -3.0, -2.0, 6.0),
    "titled": (-0.5, -3.0, 1.0, -4.0),
    "answer": (2.5, -3.0, -4.0, -4.0),
    "sentence": (2.5, -3.0, -4.0, -1.0),
}
START = [0.0, -1.0, -1.5, -3.0]
# from label (row) to label (column): a signature is not left for new text, a notice is left for nothing but history
STEPS = [[0.0, -1.0, -0.5, -1.0], [0.0, 0.5, -0.5, -1.0], [-6.0, -0.5, 0.5, 0.0], [-9.0, -0.5, -3.0, 3.0]]
RULES = Model({}, START, STEPS)


def parts_of(text: str) -> tuple[list[int], list[str], list[str], list[str], list[int]] | None:
    """(rows, lines, lines without outer blanks, cues of the rows, words in small letters of the rows)."""
    lines = text.split("\n")
    body = [x.strip() for x in lines]
    rows = [i for i in range(len(lines)) if body[i]]
    if not rows:
        return None
    cues, plain = _cues(lines, body)
    return rows, lines, body, [cues[i] for i in rows], [plain[i] for i in rows]


def rule_labels(cues: list[str]) -> list[int]:
    """The best labelling by the scores; a notice begins only at its first worded line or the rule above that."""
    labels = RULES.decode([SCORES[c] for c in cues])
    k = next((i for i, s in enumerate(labels) if s == NOTICE), len(labels))
    first = k
    while first < len(labels) and labels[first] == NOTICE and cues[first] not in ("notice", "rule"):
        first += 1
    if k < first:
        labels[:first] = RULES.decode([SCORES[c] for c in cues[:first]]) if NOTICE not in RULES.decode([SCORES[c] for c in cues[:first]]) else [NEW] * first
    return labels


def _features(parts: tuple, cues: list[str]) -> list[list[str]]:
    rows, lines, body, _, plain = parts
    return [own_features(*a) + neighbour_features(*b) + place_features(*c) for a, b, c in line_features(rows, lines, body, cues, plain)]


def hide(cues: list[str], share: float, rnd: random.Random) -> list[str]:
    return ["sentence" if c in WORDED and rnd.random() < share else c for c in cues]


def fit(texts: list[str], epochs: int = EPOCHS, hidden: float = HIDDEN, seed: int = 7) -> Model:
    rnd = random.Random(seed)
    mails = [(p, rule_labels(p[3])) for p in map(parts_of, texts) if p]
    weights: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
    sums: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
    for cue, scores in SCORES.items():
        weights[f"c={cue}"] = [PRIOR * x for x in scores]
    start, steps = [PRIOR * x for x in START], [[PRIOR * x for x in row] for row in STEPS]
    start_sum, steps_sum = [0.0] * 4, [[0.0] * 4 for _ in range(4)]
    now = 0
    model = Model(weights, start, steps)
    for _ in range(epochs):
        rnd.shuffle(mails)
        for parts, gold in mails:
            now += 1
            if rnd.random() < CUT:
                a = rnd.randrange(len(gold))
                b = rnd.randrange(a, len(gold)) + 1
                parts = (parts[0][a:b], parts[1], parts[2], parts[3][a:b], parts[4][a:b])
                gold = rule_labels(parts[3])
            rows = _features(parts, hide(parts[3], hidden if rnd.random() < 0.7 else 0.0, rnd))
            emissions = []
            for features, g in zip(rows, gold):
                known = [weights[f] for f in features if f in weights]
                emissions.append(tuple(sum(w[s] for w in known) + MARGIN * (s != g) for s in range(4)))
            found = model.decode(emissions)
            if found == gold:
                continue
            for features, g, s in zip(rows, gold, found):
                if g != s:
                    for f in features:
                        w, z = weights[f], sums[f]
                        w[g] += 1
                        w[s] -= 1
                        z[g] += now
                        z[s] -= now
            for table, total, pairs in ((start, start_sum, ((gold[0], found[0]),)),):
                for g, s in pairs:
                    table[g] += 1
                    table[s] -= 1
                    total[g] += now
                    total[s] -= now
            for (g0, g1), (s0, s1) in zip(zip(gold, gold[1:]), zip(found, found[1:])):
                steps[g0][g1] += 1
                steps[s0][s1] -= 1
                steps_sum[g0][g1] += now
                steps_sum[s0][s1] -= now
    # averages over all steps; what never changed keeps its first score
    mean = lambda w, z: [round(a - b / (now + 1), 3) for a, b in zip(w, z)]
    averaged = {f: mean(w, sums[f]) for f, w in sorted(weights.items())}
    return Model({f: w for f, w in averaged.items() if any(w)}, mean(start, start_sum), [mean(a, b) for a, b in zip(steps, steps_sum)])


def agreement(model: Model, texts: list[str], hidden: float = 0.0) -> tuple[int, int]:
    """(lines labelled as the rules do, lines); ``hidden``: the share of worded cues that the model does not see."""
    rnd, same, n = random.Random(1), 0, 0
    for parts in filter(None, map(parts_of, texts)):
        gold = rule_labels(parts[3])
        found = model.decode([tuple(sum(model.weights[f][s] for f in fs if f in model.weights) for s in range(4)) for fs in _features(parts, hide(parts[3], hidden, rnd))])
        same += sum(map(int.__eq__, gold, found))
        n += len(gold)
    return same, n


def main(path: str, held_out: str | None = None) -> None:
    import pyarrow.parquet as pq

    order = lambda r: xxhash.xxh3_64_intdigest(str(r["row_id"]))
    rows = sorted((r for r in pq.read_table(path, columns=["row_id", "body"]).to_pylist() if r["body"]), key=order)
    model = fit([r["body"] for r in rows[:MOST_MAILS]])
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "newtext_model.json"), "w", encoding="utf-8") as f:
        json.dump({"weights": model.weights, "start": model.start, "steps": model.steps}, f, separators=(",", ":"))
    rest = rows[MOST_MAILS:] if held_out is None else [r for r in pq.read_table(held_out, columns=["row_id", "body"]).slice(0, 20000).to_pylist() if r["body"]]
    for hidden in (0.0, 1.0):
        same, n = agreement(model, [r["body"] for r in rest[:20000]], hidden)
        print(f"worded cues hidden: {hidden:.0%}; lines labelled alike {same} of {n} ({same / max(n, 1):.5f})")


if __name__ == "__main__":
    main(*sys.argv[1:])
