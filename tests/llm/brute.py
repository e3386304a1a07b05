"""Plain restatements of the operators' rules, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def substring(docs: list[tuple[int, str | None]], width: int = 50) -> dict[int, tuple]:
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, ws in words.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[d] = (len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def suffix(docs: list[tuple[int, str | None]], width: int = 200) -> dict[int, tuple]:
    data = {d: (t or "").encode() for d, t in docs}
    seen = Counter(hash(b[i : i + width]) for b in data.values() for i in range(len(b) - width + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[hash(b[i : i + width])] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rules(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def components(fps: dict[int, int], bits: int = 3) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
