"""BPE on token sequences within a task: many merges of a bounded set of sequences, their replay on a word, and encoding."""

from __future__ import annotations

import heapq
from collections import defaultdict

#: Hex digits in falling order; "~" ends a key, so that of two tokens the greater bytes come first in a heap of least keys.
_FALL = str.maketrans("0123456789ABCDEF", "FEDCBA9876543210")


def _key(count: int, pair: tuple[str, str]) -> tuple[int, str, str]:
    return -count, pair[0].translate(_FALL) + "~", pair[1].translate(_FALL) + "~"


def replaced(tokens: list[str], a: str, b: str) -> list[str]:
    """tokens with each a followed by b, from the left, as one token."""
    out, k, n = [], 0, len(tokens)
    while k < n:
        if tokens[k] == a and k + 1 < n and tokens[k + 1] == b:
            out.append(a + b)
            k += 2
        else:
            out.append(tokens[k])
            k += 1
    return out


def next_merges(sequences: list[tuple[list[str], int]], most: int, floor: int, known: set[str]) -> list[tuple[str, str, int]]:
    """The next merges (a, b, count) of sequences with their counts, best first, as long as the best count is above `floor`.

    An inverted table gives the sequences of a pair; only these change with its merge, and the counts of pairs go by the
    difference. The list ends after a merge that makes a token of `known` bytes once more: pairs of that token are then counted
    together, also with those that stand outside of these sequences.
    """
    own = [list(s) for s, _ in sequences]
    counts: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, (tokens, n) in enumerate(sequences):
        for pair in zip(tokens, tokens[1:], strict=False):
            counts[pair] += n
            where[pair].add(k)
    heap = [_key(c, p) + (p,) for p, c in counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str, int]] = []
    known = set(known)
    while heap and len(merges) < most:
        fall, _, _, pair = heapq.heappop(heap)
        count = counts.get(pair, 0)
        if -fall != count:  # an entry from before a change; the count of now has one too
            continue
        if count <= floor:
            break
        a, b = pair
        merges.append((a, b, count))
        changed: set[tuple[str, str]] = set()
        for k in where.pop(pair):
            was, n = own[k], sequences[k][1]
            now = replaced(was, a, b)
            if len(now) == len(was):
                continue  # lost the pair by an earlier merge
            own[k] = now
            for p in zip(was, was[1:], strict=False):
                counts[p] -= n
                changed.add(p)
            for p in zip(now, now[1:], strict=False):
                counts[p] += n
                where[p].add(k)
                changed.add(p)
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(heap, _key(counts[p], p) + (p,))
            else:
                del counts[p]
                where.pop(p, None)
        if a + b in known:
            break
        known.add(a + b)
    return merges


def replay(tokens: list[str], merges: dict[tuple[str, str], int]) -> list[str]:
    """tokens after merges (pair to place) of a list, one after the other, each applied once."""
    done = -1
    while len(tokens) > 1:
        found = min((k for p in zip(tokens, tokens[1:], strict=False) if (k := merges.get(p, -1)) > done), default=None)
        if found is None:
            break
        done = found
        a, b = next(p for p in zip(tokens, tokens[1:], strict=False) if merges.get(p) == found)
        tokens = replaced(tokens, a, b)
    return tokens


#: Tokens of a word that is scanned for each of its merges.
SHORT_WORD = 32


def encode(tokens: list, ranks: dict[tuple, int]) -> list:
    """Merges the pair of the lowest rank, the leftmost first, until none is known.

    Neighbours are linked, and a heap holds the pairs by rank and place, so a merge costs the logarithm of the length
    however long the word is.
    """
    n = len(tokens)
    if n < 2:
        return tokens
    own: list = list(tokens)
    if n <= SHORT_WORD:  # a scan for each merge is less work than links and a heap
        rank = [ranks.get(p) for p in zip(own, own[1:], strict=False)]
        while known := [(r, k) for k, r in enumerate(rank) if r is not None]:
            k = min(known)[1]
            own[k : k + 2] = [own[k] + own[k + 1]]
            del rank[k]
            if k:
                rank[k - 1] = ranks.get((own[k - 1], own[k]))
            if k < len(rank):
                rank[k] = ranks.get((own[k], own[k + 1]))
        return own
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, own[k], own[k + 1]) for k in range(n - 1) if (r := ranks.get((own[k], own[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        j = after[k]
        if own[k] != a or j >= n or own[j] != b:
            continue  # one of the two is part of another token by now
        own[k], own[j] = a + b, None
        after[k] = after[j]
        if after[j] < n:
            before[after[j]] = k
        for i, m in ((before[k], k), (k, after[k])):
            if i >= 0 and m < n and (r := ranks.get((own[i], own[m]))) is not None:
                heapq.heappush(heap, (r, i, own[i], own[m]))
    return [t for t in own if t is not None]
