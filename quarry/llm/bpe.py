"""Byte-pair encodings of words by dynamic programming over prefixes.

The encoding of a prefix ends with some token; what stands before that token is itself encoded as that shorter prefix
is, and the last two tokens together are encoded as themselves. The reverse holds, too: merges inside two tokens go in
the same relative order whatever surrounds them, so a row of tokens is an encoding if each neighbouring pair is. Each
prefix therefore has one last token, found by trying the tokens that end there. Sorted words walk a trie depth-first
and share the states of common prefixes.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator

PAIRS_KEPT = 400_000


class PrefixBPE:
    """vocab: token (str or bytes) to id. rank: of two neighbouring tokens, the order in which they merge, or None.
    Units without a token of their own never merge and count as unknown."""

    def __init__(self, vocab: dict, rank: Callable):
        self.vocab, self.rank = vocab, rank
        self.size = len(vocab) + 2
        self.pairs: dict[int, bool] = {}
        ends: dict = {}
        for t in vocab:
            if len(t) > 1:
                ends.setdefault(t[-2:], {1}).add(len(t))
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}

    def merged(self, text) -> list:
        """Tokens of text by merges, the least rank and then the leftmost first."""
        n = len(text)
        part = [text[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (r := self.rank(part[i], part[j])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j >= n or part[i] != a or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            right[j] = n
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in part if p is not None]

    def fits(self, a, b, key: int) -> bool:
        """Whether a and b side by side stay as they are; a None: whether b alone does."""
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.merged(b) == [b] if a is None else self.rank(a, b) is None and self.merged(a + b) == [a, b]
            self.pairs[key] = known
        return known

    def walk(self, words: Iterable) -> Iterator[tuple[list, list[int], list[int]]]:
        """For each of the sorted words: (last token, its id or -1, number of tokens) at every prefix, from 0. The lists
        are the walk's own and hold until the next word."""
        token, ident, count = [None], [0], [0]
        before = None
        get, ends, pairs, size, one = self.vocab.get, self.ends, self.pairs, self.size, (1,)
        for w in words:
            n, same = len(w), 0
            if before is not None:
                top = min(n, len(before))
                while same < top and w[same] == before[same]:
                    same += 1
            del token[same + 1 :], ident[same + 1 :], count[same + 1 :]
            for i in range(same + 1, n + 1):
                for length in ends.get(w[i - 2 : i], one) if i > 1 else one:
                    at = i - length
                    if at < 0:
                        continue
                    t = w[at:i]
                    k = get(t)
                    if k is None:
                        continue
                    # a word's start and an unknown unit before are alike: nothing there merges with t
                    key = (ident[at] + 1 if at else 0) * size + k
                    ok = pairs.get(key)
                    if ok is None:
                        ok = self.fits(token[at] if at and ident[at] >= 0 else None, t, key)
                    if ok:
                        break
                else:
                    t, k, at = w[i - 1 : i], -1, i - 1
                token.append(t)
                ident.append(k)
                count.append(count[at] + 1)
            before = w
            yield token, ident, count


def path(token: list, ident: list[int]) -> list[tuple]:
    """(token, id) of the encoding that the states of a word tell."""
    out, i = [], len(token) - 1
    while i > 0:
        out.append((token[i], ident[i]))
        i -= len(token[i])
    return out[::-1]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are their own letters, the rest
    follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(path_: str) -> tuple[PrefixBPE, tuple[str, ...]]:
    """(encoder, special strings) of a byte-level BPE file of the tokenizers library."""
    with open(path_, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    to_bytes = lambda s: bytes(letters[c] for c in s)
    specials = tuple(a["content"] for a in spec.get("added_tokens", []))
    vocab = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in specials}
    ranks = {}
    for i, m in enumerate(spec["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        ranks.setdefault((to_bytes(a), to_bytes(b)), i)
    return PrefixBPE(vocab, lambda a, b: ranks.get((a, b))), specials
