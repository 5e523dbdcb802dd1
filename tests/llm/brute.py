"""Plain versions of operators, for small fixtures."""

import hashlib
import math
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """{source: target} by resharing what stops at most times its size until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s], rest = most * sizes[s], rest - most * sizes[s]
        free -= over
    return out


def mix(docs, seed="mix", long=1024, most=2.0):
    """Copies of each of docs [(doc_id, source, text)], by the definition of the operator."""
    rows, seen = [], {}
    for at, (i, s, t) in enumerate(docs):
        copy = seen[i, s, t or ""] = seen.get((i, s, t or ""), -1) + 1
        rows.append((at, s, len(words(t)), i, hashlib.md5((t or "").encode()).hexdigest(), copy))
    sizes, out = {}, [0] * len(rows)
    for _, s, n, *_ in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes)
    klass = lambda n: max(0, math.floor(math.log2(max(n, 1) / long)))
    for source, target in goal.items():
        own = [r for r in rows if r[1] == source]
        by = {}
        for _, _, n, *_ in own:
            by[klass(n)] = by.get(klass(n), 0) + n
        ks, expected, used = sorted(by), {}, 0.0
        for j, k in enumerate(ks):
            tail = sum(by[q] * 2 ** (-0.5 * q) for q in ks[j:])
            alpha = (target - most * used) / tail if tail else None
            if target >= most * sizes[source] or (alpha is not None and alpha * 2 ** (-0.5 * k) >= most):
                expected[k] = most
                used += by[k]
            else:
                for q in ks[j:]:
                    expected[q] = max(0.0, min(most, (alpha or 0.0) * 2 ** (-0.5 * q)))
                break
        sure = {k: int(e) for k, e in expected.items()}
        missing = target - sum(by[k] * sure[k] for k in ks)
        ranked = []
        for at, _, n, i, digest, copy in own:
            p = expected[klass(n)] - sure[klass(n)]
            out[at] = sure[klass(n)]
            if p > 0:
                name = f"{'null' if i is None else i}:{seed}:{digest}:{copy}"
                u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 16**13
                ranked.append(((u / (1 - u)) / (p / (1 - p)), i is not None, i or 0, n, digest, copy, at))
        ranked.sort()
        reach, cut = 0, 0
        while cut < len(ranked) and reach + ranked[cut][3] <= missing:
            reach += ranked[cut][3]
            out[ranked[cut][-1]] += 1
            cut += 1
        gap = missing - reach
        later = [(abs(r[3] - gap), r) for r in ranked[cut:] if abs(r[3] - gap) < gap]
        if later:
            out[min(later)[1][-1]] += 1
    return out
