"""Plain Python versions that the tests compare with."""

import hashlib
import re
from collections import defaultdict


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def components_of(rows, words, n, percent):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    index = {}
    for i in ids:
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    for a in ids:
        for b in {x for s in sets[a] for x in index[s] if x > a}:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")


def live_looking(v):
    return len(v) >= 12 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not re.search(r"(.)\1{3}", v)


def placeholder(v):
    core = re.sub("^(AKIA)+", "", v)
    low = v.lower()
    m = re.fullmatch("([a-z]{0,26})([0-9]{0,10})", low)
    in_order = m and m[1] in "abcdefghijklmnopqrstuvwxyz" and m[2] in "01234567890"
    return len(set(core)) <= 2 or in_order or not re.sub("password|passwd|secret|token|api_?key|[^a-z0-9]", "", low)


def secrets_of(rows):
    """rows: (id, text, owner)"""
    found, owners, named = [], defaultdict(set), set()
    for i, t, owner in rows:
        t = t or ""
        base = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        tokens = [(m.start(), 3, m.end(), m[0]) for m in TOKEN.finditer(t) if len(m[0]) >= 20 and re.search("[0-9]", m[0])]
        found.append((i, t, sorted(base), tokens))
        for s in base + tokens:
            owners[s[3]].add(owner or "")
        named |= {s[3] for s in base if not placeholder(s[3])}
    live = {v for v, o in owners.items() if len(o) < 3 and (v in named or live_looking(v))}
    kinds = ("assign", "access", "hex", "token")
    write = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b, _ in spans)
    out, texts = [], {}
    for i, t, base, tokens in found:
        values = {(b - len(v), b) for _, _, b, v in base}
        added = [s for s in tokens if s[3] in live and (s[0], s[2]) not in values]
        cut = sorted((b - len(v), b) for _, _, b, v in base + tokens if v in live)
        new, at = "", 0
        for a, b in cut:
            if a >= at:
                new += t[at:a] + "[secret]"
            at = max(at, b)
        texts[i] = new + t[at:] if cut else t
        n = [sum(s[1] == k for s in base) for k in range(3)]
        out.append((i, *n, hashlib.sha256(write(base).encode()).hexdigest(), write(sorted(base + added)), len(cut)))
    return out, texts
