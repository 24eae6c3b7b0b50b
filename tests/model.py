"""A plain Python model of the miner, written from the survey's description of the semantics."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def tokens(line: str, separator: str = "[ ]+", cap: int = 512) -> list[str]:
    if line == "":
        return []
    out, rest = [], line
    while len(out) < cap:
        m = re.search(separator, rest)
        if m is None:
            if rest != "" or not out:
                out.append(rest)
            break
        out.append(rest[: m.start()])
        rest = rest[m.end() :]
        if rest == "":
            break
    return out[:cap]


def mine(lines, support, derive=None, aggrsup=False, wweight=0.0, weightf=1):
    """patterns {text: support}, outlier line numbers, and intermediate results."""
    split = [tokens(x) for x in lines]
    derived = [[derive(t) if derive and t else None for t in ts] for ts in split]
    df = Counter()
    for ts, ds in zip(split, derived):
        df.update({t for t in ts if t} | {d for d in ds if d is not None})
    frequent = {w for w, n in df.items() if n >= support}

    def reduce(ts, ds):
        words, gaps, gap = [], [], 0
        for t, d in zip(ts, ds):
            word = t if t and t in frequent else d if t and d is not None and d in frequent else None
            if word is None:
                gap += 1
            else:
                words.append(word)
                gaps.append(gap)
                gap = 0
        return tuple(words), gaps, gap

    found, first = {}, {}
    for i, (ts, ds) in enumerate(zip(split, derived)):
        words, gaps, tail = reduce(ts, ds)
        if not words:
            continue
        now = [*gaps, tail]
        if words in found:
            n, lo, hi = found[words]
            found[words] = (n + 1, list(map(min, lo, now)), list(map(max, hi, now)))
        else:
            found[words], first[words] = (1, now, now), i
    own = {w: x[0] for w, x in found.items()}
    supports = dict(own)
    if aggrsup:
        supports = {c: own[c] + sum(own[d] for d in found if d != c and absorbs(c, found[c], d, found[d])) for c in found}
    clusters = {w: supports[w] for w in found if supports[w] >= support}
    outliers = [i for i, ts in enumerate(split) if not frequent or reduce(ts, [None] * len(ts))[0] not in clusters]
    if not frequent:
        outliers = []
    patterns = Counter()
    if wweight <= 0:
        for w, n in clusters.items():
            patterns[render([(x,) for x in w], [False] * len(w), *found[w][1:])] += n
    else:
        both = Counter()
        for w, n in own.items():
            for a in set(w):
                for b in set(w):
                    both[a, b] += n
        dep = lambda a, b: both[a, b] / both[a, a]
        groups = defaultdict(list)
        for w in clusters:
            weak = [weight(w, i, dep, weightf) < wweight for i in range(len(w))]
            groups[tuple(None if m else x for m, x in zip(weak, w)) if any(weak) else ("", w)].append((w, weak))
        for members in groups.values():
            weak = members[0][1]
            los = [min(c) for c in zip(*(found[w][1] for w, _ in members))]
            his = [max(c) for c in zip(*(found[w][2] for w, _ in members))]
            options = []
            for i in range(len(weak)):
                last = defaultdict(int)
                for w, _ in members:
                    last[w[i]] = max(last[w[i]], first[w])
                options.append(tuple(sorted(last, key=lambda x: (last[x], x))))
            patterns[render(options, weak, los, his)] += sum(clusters[w] for w, _ in members)
    return {"patterns": dict(patterns), "outliers": outliers, "df": dict(df), "own": own, "supports": supports}


def weight(words, i, dep, function):
    if function == 1:
        return sum(dep(w, words[i]) for w in words) / len(words)
    unique = list(dict.fromkeys(words))
    return 1.0 if len(unique) == 1 else (sum(dep(u, words[i]) for u in unique) - 1) / (len(unique) - 1)


def render(options, weak, los, his):
    out = ""
    for o, lo, hi in zip(options, los, his):
        if hi:
            out += f"*{{{lo},{hi}}} "
        out += (f"({'|'.join(o)})" if len(o) > 1 else o[0]) + " "
    return out + (f"*{{{los[-1]},{his[-1]}}}" if his[-1] else "")


def path(words, lo, hi):
    out = []
    for i, w in enumerate(words):
        if hi[i]:
            out.append((None, lo[i], hi[i]))
        out.append((w, 1, 1))
    if hi[-1]:
        out.append((None, lo[-1], hi[-1]))
    return out


def absorbs(c, cf, d, df):
    _, clo, chi = cf
    k = len(c)
    if not any(chi):
        return False
    p = next((i for i in range(k) if chi[i]), k)
    nodes = path(d, *df[1:])
    if [n[0] for n in nodes[:p]] != list(c[:p]):
        return False
    j, lo, hi, ok = p, 0, 0, False
    for w, a, b in nodes[p:]:
        lo, hi, ok = lo + a, hi + b, False
        if j < k:
            if lo - 1 < clo[j]:
                continue
            if hi - 1 > chi[j]:
                return False
            if w == c[j]:
                ok = j == k - 1 and (chi[k] == 0 or clo[k] == 0)
                j, lo, hi = j + 1, 0, 0
        else:
            if chi[k] == 0:
                return False
            if lo < clo[k]:
                continue
            if hi > chi[k]:
                return False
            ok = True
    return ok
