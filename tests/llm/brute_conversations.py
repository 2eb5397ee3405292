"""A plain version of conversation repair, a conversation at a time."""

import hashlib
import re
import zlib

START, SYSTEM, USER, ASSISTANT = range(4)
SPACE = r"[\x20\x09-\x0D]"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(name.encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def by_turn(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).digest())


def cheapest(rows):
    """(cost, audit) by trying every edit, from the last row on: ``rows`` are (initial, must go, truncated)."""
    turned = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
    fits = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}

    def inserted(ways):
        for _ in range(4):
            ways = {q: min(ways[q], (ways[turned[q]][0] + 2, "I" + ways[turned[q]][1])) for q in range(4)}
        return ways

    never = (10**9, "")
    after = inserted({START: (0, ""), ASSISTANT: (0, ""), SYSTEM: never, USER: never})
    for initial, gone, short in reversed(rows):
        ways = {}
        for state in range(4):
            ways[state] = (after[state][0] + 3, "D" + after[state][1])
            if not gone:
                if (initial, state) in fits:
                    cost, audit = after[fits[initial, state]]
                    ways[state] = min(ways[state], (cost + short, "K" + audit))
                cost, audit = after[turned[state]]
                ways[state] = min(ways[state], (cost + 2 + short, "R" + audit))
        after = inserted(ways)
    return after[START]


def repaired(rows, audit):
    out, i, state = [], 0, START
    for letter in audit:
        to = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}[state]
        if letter == "D":
            i += 1
            continue
        role, text = (to, "") if letter == "I" else rows[i][2:] if letter == "K" else (to, rows[i][3])
        i += letter != "I"
        out.append((role, text))
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
    assert i == len(rows) and state in (START, ASSISTANT)
    return out


def verdict(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's damaged rows."""
    rows = sorted(rows, key=by_turn)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        tail = re.sub(SPACE + r"+\Z", "", text)
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        judged.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    cost, audit = cheapest(tuple(judged))
    told = "\n".join(f"{r}:{t}" for r, t in repaired(rows, audit))
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest())
