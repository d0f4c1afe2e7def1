"""Conversation repair, written out: cheapest edits with whole strings in every cell."""

import hashlib
import re
import zlib

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit) of rows (role, fault): in each cell the least (cost, letters, role initials) by role initials' state."""

    def put(cells, roles, value):
        state = roles[-1:] if roles else ""
        if state not in cells or value < cells[state]:
            cells[state] = value

    def inserted(cells):
        for _ in range(4):
            for state, (cost, letters) in list(cells.items()):
                add = "a" if state == "u" else "u"
                put(cells, add, (cost + 3, letters + "I"))

    cells = {"": (0, "")}
    inserted(cells)
    for role, fault in rows:
        after = {}
        for state, (cost, letters) in cells.items():
            put(after, state, (cost + 4, letters + "D"))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            first = role[:1]
            if first and (state + first in ("su", "ua", "au") or state == "" and first in "su"):
                put(after, first, (cost + more, letters + "K"))
            put(after, "a" if state == "u" else "u", (cost + 3 + more, letters + "R"))
        inserted(after)
        cells = after
    return min(v for s, v in cells.items() if s in ("", "a"))


def texts(rows, audit):
    out, state, i = [], "", 0
    for letter in audit:
        if letter != "I":
            role, text = rows[i]
            i += 1
        if letter == "D":
            continue
        state = role[:1] if letter == "K" else "a" if state == "u" else "u"
        out.append(f"{role if letter == 'K' else ROLE[state]}:{'' if letter == 'I' else text}")
    assert i == len(rows)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repair(rows, convs, tie):
    by = {c: [] for c in convs}
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), *tie(r[2])))
        plain = [(role, text) for _, role, text in own]
        found = faults(plain)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for role, _ in plain]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest([(role, f) for (role, _), f in zip(plain, found, strict=True)])
        fixed = texts(plain, audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in fixed))
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out
