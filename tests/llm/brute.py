"""Plain versions of the operators, for small fixtures."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def find(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def repeats(texts, n):
    raw, count = [(t or "").encode() for t in texts], Counter()
    for b in raw:
        count.update(b[p : p + n] for p in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def shingle_components(rows, n=3, num=9, den=10):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                    a, b = find(parent, i), find(parent, j)
                    parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(parent, k)
            least[r] = min(least.get(r, i), i)
    return [(rows[k][0], len(sets[k]), least.get(find(parent, k))) for k in range(len(rows))], [find(parent, k) for k in range(len(rows))]


def contaminated(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = WORD.findall(lower(t)), set(), set()
        for n in range(1, window + 1):
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    names |= x
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), ",".join(sorted(names)), bool(hit)))
    return out


def near_vectors(rows, threshold=0.98):
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def cosine(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))

    fine = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and cosine(rows[i][1], rows[j][1]) >= threshold:
                degree[i] += 1
                degree[j] += 1
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return [(rows[i][0], degree[i], rows[find(parent, i)][0], rows[i][0] == rows[find(parent, i)][0]) for i in range(len(rows))]


def personal(t):
    from sievework.llm import pii

    t, s = t or "", []
    s += [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    s += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    s += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    s += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(s, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def secrets(t):
    from sievework.llm import secret_scan

    t, s = t or "", []
    s += [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    s += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(s, key=lambda x: (x[0], secret_scan.KINDS.index(x[2])))


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def judged(u, rules):
    u = u or ""
    if "://" not in u:
        return "", "", None, "allow"
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path, host, best = re.match(r"[^?#]*", rest[len(host) :])[0], lower(host), None
    for v, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1] + best[2])):
            best = (v, h, p)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def licensed(t, phrases, templates, threshold=0.9):
    """Base places and labels, and all labels and the score, by sets of words in windows; of short templates in runs of their length."""
    w, starts, base, labels, score = WORD.findall(lower(t)), [], set(), set(), 0.0
    for p, label in phrases:
        p = p.split(" ")
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += here
        base |= {label} if here else set()
    for label, text in templates:
        own = WORD.findall(lower(text))
        size, tokens = 8, set(own)
        while size < len(own):
            size *= 2
        need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
        for i in range(0, max(1, len(w) - size), size):
            block = w[i : i + 2 * size]
            run = len(block) if size > 16 else math.ceil(len(own) / threshold - 1e-9)
            both = max(len(tokens & set(block[k : k + run])) for k in range(max(1, len(block) - run + 1)))
            if both >= need:
                labels.add(label)
                score = max(score, both / len(tokens))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if starts else score


def packed(items, capacity):
    """Best fit by looking at every bin; items: size, source (negative: none), cluster."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and (source < 0 or source not in b["s"]) and cluster not in b["c"]]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            i = len(bins) - 1
        b = bins[i]
        out.append((i, capacity - b["left"]))
        b["left"] -= size
        b["s"] |= {source} if source >= 0 else set()
        b["c"].add(cluster)
    return out


def trie(rows, family=5, heads=9):
    """conv_id, turn, role, text; every prefix as a tuple."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))

    def signed(h):
        return [int.from_bytes(bytes.fromhex(h[k : k + 16]), signed=True) for k in (0, 16)]

    own = {c: [x[3:] for x in sorted(v, key=lambda x: (x[:2], signed(x[2])))] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        donor, h = c - int(math.fmod(c, family)), zlib.crc32(str(c).encode()) % heads
        full[c] = own.get(donor, [])[:h] + v[h:]
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = {}
    for path, m in members.items():
        out[path] = {"n": len(m), "c": min(m), "children": 0, "leaves": 0, "saved": 0, "ends": ",".join(map(str, sorted(c for c in m if len(full[c]) == len(path))))}
    for path in sorted(out, key=len, reverse=True):
        x = out[path]
        x["leaves"] += x["children"] == 0
        x["saved"] += (x["n"] - 1) * (len(path[-1][1].encode()) if path else 0)
        if path:
            up = out[path[:-1]]
            up["children"] += 1
            up["leaves"] += x["leaves"]
            up["saved"] += x["saved"]
    return [(x["c"], len(p), out[p[:-1]]["c"] if p else None, x["n"], x["children"], x["leaves"], x["saved"], hashlib.sha256(x["ends"].encode()).hexdigest()) for p, x in out.items()]


def archived(rows, least=0):
    """page_id, url, html: id, bytes, digest, kind and what it refers to."""
    groups = {}
    for i, u, t in rows:
        groups.setdefault(t or "", []).append((i is not None, i or 0, u is not None, u or "", i))
    out = []
    for t, g in groups.items():
        raw = t.encode()
        g = sorted(g, reverse=True)
        for k, x in enumerate(g):
            again = k > 0 and len(raw) >= least
            out.append((x[4], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", g[0][4] if again else None))
    return out


def middle(i, t):
    """Units, form, code points of prefix and middle, and output."""
    t = t or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return len(units), "plain", None, None, t
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
