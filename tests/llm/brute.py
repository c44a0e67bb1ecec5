"""What operators should give, by trying everything on few rows."""

from __future__ import annotations

import collections
import itertools
import re
from fractions import Fraction
from math import ceil, floor

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def brute_lines(rows: list[tuple[int, str]], threshold: float = 0.8) -> dict[int, list[int]]:
    """Line numbers that go, of documents with different ids."""
    found, earlier = collections.defaultdict(list), []
    for doc, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            words = frozenset(w for w in BLANK.split(line) if w)
            if words:
                if any(len(words & o) >= threshold * len(words | o) for o in earlier):
                    found[doc].append(k)
                earlier.append(words)
    return found


def brute_alike(rows: list[tuple[int, str | None]]) -> list[int]:
    """The ids that stay of documents with different ids."""
    sets = []
    for _, text in rows:
        words = [w for w in BLANK.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)] if words else []))
    root = [*range(len(rows))]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            old, new = root[i], root[j]
            root = [new if r == old else r for r in root]
    return sorted(min(d for (d, _), r in zip(rows, root, strict=True) if r == k) for k in set(root))


def brute_slots(rows: list[tuple[int, str | None, int, int]], weights: dict[str | None, float], block_chars: int) -> dict[int, int]:
    """The slot of each document (id, source, hash, size): blocks by running sums, and each slot to the released block of earliest deadline."""
    block, count = {}, {}
    for source in {r[1] for r in rows}:
        at = 0
        for doc, _, _, size in sorted((r for r in rows if r[1] == source), key=lambda r: (r[2], r[0])):
            block[doc] = (source, at // block_chars)
            at += size
        count[source] = (at - 1) // block_chars + 1
    total = sum(Fraction(weights[s]) for s in count)
    share = {s: Fraction(weights[s]) / total for s in count}
    done, slots, time, place = dict.fromkeys(count, 0), {}, 0, 0
    while any(done[s] < count[s] for s in count):
        open_ = [s for s in count if done[s] < count[s]]
        released = [s for s in open_ if floor(done[s] / share[s]) <= time]
        if not released:
            time = min(floor(done[s] / share[s]) for s in open_)
            continue
        s = min(released, key=lambda s: (ceil((done[s] + 1) / share[s]), s is not None, s or ""))
        slots[s, done[s]] = place
        done[s], time, place = done[s] + 1, time + 1, place + 1
    return {doc: slots[b] for doc, b in block.items()}
