"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def best_entropy(s, window):
    def bits(w):
        return -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())

    return max(bits(s[i : i + window]) for i in range(len(s) - window + 1))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return out


def greedy_pieces(word, first, rest):
    """Longest match from the left; -1 where a word can't be spelled."""
    at = n = 0
    while at < len(word):
        pieces = rest if at else first
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


def lm_scores(docs, train, order, mu):
    """Scores by the recursive definition, from a list of texts and their training marks."""

    def words(text):
        return [w.lower() for w in (text or "").encode().split()] + ["</s>"]

    grams, starts = Counter(), 0
    for text, t in zip(docs, train, strict=True):
        if t:
            ws = ["<s>", *words(text)]
            starts += 1
            for n in range(1, order + 1):
                grams.update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    tokens = sum(c for g, c in grams.items() if len(g) == 1 and g != ("<s>",))
    types = sum(1 for g in grams if len(g) == 1 and g != ("<s>",))

    def p(w, h):
        if not h:
            return (grams[(w,)] + 1) / (tokens + types + 1)
        return (grams[(*h, w)] + mu * p(w, h[1:])) / (grams[h] + mu)

    out = []
    for text in docs:
        ws = ["<s>", *words(text)]
        score = sum(math.log10(p(ws[i], tuple(ws[max(0, i - order + 1) : i]))) for i in range(1, len(ws)))
        base = sum(math.log10((grams[(w,)] + 1) / (tokens + types + 1)) for w in ws[1:])
        out.append((len(ws) - 1, sum(grams[(w,)] > 0 for w in ws[1:]), tokens, base, score))
    return out


def simhash(text, size):
    import xxhash

    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] or [b" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Smallest member reachable, for each node."""
    nodes, out = sorted(nodes), {}
    for n in nodes:
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += [y for y in nodes if y not in out and linked(x, y)]
    return out


def repeats(docs, match):
    """{id: (bytes, removed, spans, digest)} of (id, text) rows, by looking up every string."""
    least = {}
    for i, t in docs:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - match + 1):
                s = b[k : k + match]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - match + 1):
            if i is not None and least[b[k : k + match]] < i:
                gone[k : k + match] = [True] * match
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
