"""Plain Python versions of the contracts, over lists of rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict

import xxhash


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def warc(rows):
    """rows: (page_id, html) -> multiset of result rows."""
    by = defaultdict(list)
    for page, html in rows:
        by[(html or "").encode()].append(page)
    out = []
    for payload, pages in by.items():
        pages = sorted(pages, key=lambda p: (p is None, p or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i, page in enumerate(pages):
            out.append((page, len(payload), digest, "revisit" if i else "response", pages[0] if i else None))
    return out


def decontaminate(docs, items, window=10):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        if w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                grams[tuple(w[i : i + n])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        named = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(named).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(named), digest, bool(hit)))
    return out


def secrets(docs):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = []
    for doc, text in docs:
        text = text or ""
        spans = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        kinds = ["assign", "access", "hex"]
        spans.sort(key=lambda s: (s[1], kinds.index(s[0])))
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        out.append((doc, *[sum(s[0] == k for s in spans) for k in kinds], hashlib.sha256(base.encode()).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        spans = []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
            spans.append(("email", m.start(), m.end()))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(p) <= 255 for p in m[0].split(".")):
                spans.append(("ip", m.start(), m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
        kinds = ["email", "ip", "card", "phone"]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        out.append((doc, *[sum(s[0] == k for s in spans) for k in kinds], hashlib.sha256(base.encode()).hexdigest()))
    return out


def licenses(docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    out = []
    for doc, text in docs:
        w, places = words(text), []
        for phrase, label in phrases.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in places]
        labels = ",".join(sorted({x for _, x in places}))
        out.append((doc, len(w), len(places), min(at, default=None), max(at, default=None), labels))
    return out


def notices(text):
    """Labels and score, every place of a text tried for every notice."""
    from captionloom.llm.licenses import COVER, GAP, TEMPLATES

    (_, _, n_base, _, _, labels), w = licenses([(0, text)])[0], words(text)
    found, best = set(filter(None, labels.split(","))), 0.0
    for label, body, key in TEMPLATES:
        body, key = body.split(), key.split()
        key_at = next(i for i in range(len(body)) if body[i : i + len(key)] == key)
        for place in range(len(w)):
            if w[place : place + len(key)] != key:
                continue
            at = [place - key_at + k for k in range(len(body))]
            cover = sum(x in w[max(i - GAP, 0) : max(i + GAP + 1, 0)] for x, i in zip(body, at)) / len(body)
            if cover >= COVER:
                found.add(label)
                best = max(best, cover)
    return ",".join(sorted(found)), 1.0 if n_base else best


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def simhash(docs):
    prints = [fingerprint(t) for _, t in docs]
    nodes = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4]
    roots = components(nodes, links)
    first = {}
    for (doc, _), p in zip(docs, prints):
        if doc is not None:
            first[roots[p]] = min(first.get(roots[p], doc), doc)
    return [(doc, f"{p:016x}", first.get(roots[p])) for (doc, _), p in zip(docs, prints)]


def crc(text):
    return None if text is None else zlib.crc32(text.encode())


def damaged(rows):
    """rows: (conv, turn, role, text) -> {conv: turns in order}, with every conversation of ``rows``."""
    out = {conv: [] for conv, _, _, _ in rows}
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, turns in out.items():
        name = "-" if conv is None else f"={conv}"
        digest = lambda r: hashlib.md5(f"{name}\n{len(r[1])}\n{r[1]}{r[2]}".encode()).digest()
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """(cost, audit, lines) by trying every edit, with whole audits and any number of inserted turns up to two at a place."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    word = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(2):
            more = dict(states)
            for state, (cost, audit, lines) in states.items():
                to = follows[state]
                option = (cost + 5, audit + "I", [*lines, word[to] + ":"])
                more[to] = min(more.get(to, option), option)
            states = more
        return states

    states = {"": (0, "", [])}
    for (_, role, text), fault in zip(turns, found):
        after = {}

        def offer(state, option):
            after[state] = min(after.get(state, option), option)

        for state, (cost, audit, lines) in inserted(states).items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            to = follows[state]
            offer(to, (cost + 1, audit + "R", [*lines, f"{word[to]}:{text}"]))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                offer(role[:1], (cost, audit + "K", [*lines, f"{role}:{text}"]))
        states = after
    states = inserted(states)
    return min(states[s] for s in ("", "a") if s in states)


def dialogue(rows):
    out = []
    for conv, turns in damaged(rows).items():
        known = {t for t, _, _ in turns if t is not None}
        found = faults(turns)
        cost, audit, lines = cheapest(turns, found)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out.append((
            conv, max(known) - min(known) + 1 - len(known) if known else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return out


def differencing(groups, parts):
    """Sizes of all parts, largest first, by plain differencing of (bytes, name) groups: every part written out."""
    left = [(n, [size] + [0] * (parts - 1)) for n, (size, _) in enumerate(sorted(groups, key=lambda g: (-g[0], g[1])))]
    made = len(left)
    while len(left) > 1:
        left.sort(key=lambda p: (p[1][-1] - p[1][0], p[0]))
        (_, a), (_, b), *left = left
        left.append((made, sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)))
        made += 1
    return left[0][1]


def decode(margins, langs, codewords, trust):
    """The language whose codeword costs least, first by name, with its score: bit by bit."""
    losses = []
    for word in codewords:
        losses.append(sum(t * max(0.0, 1 - m * bit) for m, bit, t in zip(margins, word, trust)))
    best = min(losses)
    full = 2 * sum(trust)
    score = 1 / sum(math.exp(max(-50.0, (best - loss) * 20 / full)) for loss in losses)
    return langs[losses.index(best)], score
