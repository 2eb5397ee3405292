"""Plain versions of the operators, a note at a time and all pairs."""

import re
from collections import Counter

BASE_PRIVATE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
BASE_SECRETS = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
                ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += sum(divmod(int(c) * (1 + i % 2), 10))
    return total % 10 == 0


def private(text):
    out = []
    for kind, pattern in BASE_PRIVATE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15
                    or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def secrets(text):
    least = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    out = [(m.start(), i, kind, m.end()) for i, (kind, pattern) in enumerate(BASE_SECRETS)
           for m in re.finditer(pattern, text or "", re.ASCII) if least[kind](m)]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def split(text):
    return (text or "").encode().split()


def removed(rows, window):
    """(id, words, words removed, kept note) for each row."""
    last = float("inf")
    first = {}
    for key, text in rows:
        words = split(text)
        for i in range(len(words) - window + 1):
            run = tuple(words[i:i + window])
            first[run] = min(first.get(run, last), last if key is None else key)
    out = []
    for key, text in rows:
        words = split(text)
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i:i + window])] < (last if key is None else key):
                gone.update(range(i, i + window))
        out.append((key, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return Counter(out)


def near(rows, size, percent):
    """(id, shingles, component, kept) for each row; ids are distinct or rows repeat whole."""
    sets = {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        runs = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
        sets[key] = runs or ({tuple(words)} if words else set())
    above = {k: k for k in sets}

    def top(k):
        while above[k] != k:
            k = above[k]
        return k

    keys = [k for k in sets if k is not None]
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    return Counter((k, len(sets[k]), None if k is None else top(k), k is None or top(k) == k) for k, _ in rows)


def items_in(text, items, window):
    """(words, hit word places, item ids) of a note."""
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for item, passage in items:
        own = fold(passage)
        m = min(window, len(own))
        runs = {tuple(own[i:i + m]) for i in range(len(own) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if tuple(words[i:i + m]) in runs:
                hit.update(range(i, i + m)), found.add(str(item))
    return len(words), hit, sorted(found)
