"""Plain, slow versions of the operators, for small fixtures."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
UNSPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None, pattern=UNSPACED, lower=True) -> list[bytes]:
    data = (text or "").encode()
    return pattern.findall(data.translate(LOWER) if lower else data)


def removed(rows: list[tuple[object, str | None]], size: int = 200) -> list[tuple]:
    """doc_id, bytes, removed, runs and digest of the rest, by a table of all strings."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(t[k : k + size] for _, t in texts for k in range(len(t) - size + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if times[t[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        runs = sum(1 for value, _ in itertools.groupby(gone) if value)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), runs, sha(kept)))
    return out


def shingles(text: str | None) -> frozenset:
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """doc_id, set size, least reachable doc_id, kept, from all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {n: n for n in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        s, t = sets[a][1], sets[b][1]
        if s and t and 100 * len(s & t) >= 85 * len(s | t):
            root[find(a)] = find(b)
    least: dict[int, int] = defaultdict(lambda: 2**62)
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least[find(n)], i)
    return [(i, len(s), least[find(n)], i == least[find(n)]) for n, (i, s) in enumerate(sets)]


def hits(rows, items, width: int = 10) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            windows[tuple(w[k : k + width])].add(item)
    out = []
    for doc, text in rows:
        w = words(text, ALNUM)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), sha(names), bool(hit)))
    return out


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def base_spans(text: str | None) -> str:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def quality(text: str | None) -> tuple:
    """Words, their characters, symbols, repeated lines, words in repeated runs, base verdict."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if runs[tuple(w[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(again), failed,
    )


def em_posteriors(votes: list[tuple], rounds: int) -> list[float]:
    """Chance of being good of each document, by two-coin EM document by document."""
    good = [(0.9, 0.6, 0.1)[min(sum(v < 0 for v in row), 2)] for row in votes]
    for _ in range(rounds):
        share = (sum(good) + 2) / (len(votes) + 4)
        sums = []
        for rule in range(len(votes[0])):
            spoken = [(row[rule], g) for row, g in zip(votes, good) if row[rule]]
            yes_good = sum(g for v, g in spoken if v > 0) + 3.6
            no_bad = sum(1 - g for v, g in spoken if v < 0) + 2
            sums.append((
                yes_good / (sum(g for _, g in spoken) + 4),
                no_bad / (sum(1 - g for _, g in spoken) + 4),
            ))
        before, good = good, []
        for row in votes:
            ratio = share / (1 - share)
            for vote, (right, caught) in zip(row, sums):
                if vote > 0:
                    ratio *= right / (1 - caught)
                elif vote < 0:
                    ratio *= (1 - right) / caught
            good.append(ratio / (1 + ratio))
        if max(abs(a - b) for a, b in zip(before, good)) < 1e-9:
            break
    return good


def backoff_scores(rows) -> list[tuple]:
    """doc_id, words, shortened, unseen, log score by counts of the other rows."""
    docs = [(i, words(t)) for i, t in rows]
    one, two = Counter(), Counter()
    for _, w in docs:
        one.update(w)
        two.update(zip(w, w[1:]))
    out = []
    for i, w in docs:
        own, pairs = Counter(w), Counter(zip(w, w[1:]))
        total, short, unseen = 0.0, 0, 0
        others = max(sum(one.values()) - len(w), 1)
        for k, x in enumerate(w):
            unseen += one[x] == own[x]
            pair = (w[k - 1], x) if k else None
            if pair and two[pair] > pairs[pair]:
                total += math.log((two[pair] - pairs[pair]) / (one[pair[0]] - own[pair[0]]))
            else:
                total += math.log(max(one[x] - own[x], 1) / others) + (math.log(0.4) if k else 0)
                short += k > 0
        out.append((i, len(w), short, unseen, round(total, 6)))
    return out


def archived(rows) -> list[tuple]:
    """page_id, payload bytes, digest, record type and what it refers to."""
    last: dict[str, int] = {}
    for page, html in rows:
        last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, html in rows:
        data = (html or "").encode()
        revisit = page < last[html or ""]
        out.append((
            page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
            "revisit" if revisit else "response", last[html or ""] if revisit else None,
        ))
    return out
