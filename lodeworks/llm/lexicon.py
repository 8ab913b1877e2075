"""A minimal acyclic transducer over byte strings, laid out flat so that executors can memory-map it.

States with equal futures are shared (incremental construction from sorted words). Every arc carries a number; the
numbers on a word's path add up to the word's rank, and the rank leads to the word's token ids.
"""

from __future__ import annotations

import json
import mmap

import numpy as np

_MAGIC = b"LWLEX1\n\0"


def _automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Minimal automaton of sorted distinct words; state 0 is the start."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    free: list[int] = []
    path = [0]  # states along the last word
    last = b""

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            child = path.pop()
            label = last[len(path) - 1]
            shape = (final[child], tuple(arcs[child].items()))
            same = register.setdefault(shape, child)
            if same != child:
                arcs[path[-1]][label] = same
                free.append(child)

    for word in words:
        common = 0
        for a, b in zip(word, last, strict=False):
            if a != b:
                break
            common += 1
        close(common)
        for byte in word[common:]:
            if free:
                state = free.pop()
                arcs[state], final[state] = {}, False
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    close(0)
    return arcs, final


def build(words: list[bytes], ids: list[list[int]]) -> bytes:
    """Compile distinct ``words`` with their id sequences into one file image."""
    order = sorted(range(len(words)), key=words.__getitem__)
    arcs, final = _automaton([words[i] for i in order])
    # how many words start at a state, children first
    below = [-1] * len(arcs)
    stack = [0]
    while stack:
        s = stack[-1]
        waiting = [t for t in arcs[s].values() if below[t] < 0]
        if waiting:
            stack.extend(waiting)
        else:
            below[s] = final[s] + sum(below[t] for t in arcs[s].values())
            stack.pop()
    live = [s for s in range(len(arcs)) if below[s] >= 0]
    # place the arcs of a state at base + byte, where nothing else stands
    size = 2 * sum(len(arcs[s]) for s in live) + 1024
    taken = bytearray(size)
    base = np.zeros(len(arcs), np.int32)
    check = np.full(size, -1, np.int32)
    target = np.zeros(size, np.int32)
    output = np.zeros(size, np.int32)
    first_free = tail = 0
    for s in sorted(live, key=lambda s: -len(arcs[s])):
        if not arcs[s]:
            continue
        labels = sorted(arcs[s])
        while taken[first_free]:
            first_free += 1
        slot, tries = max(first_free, labels[0]), 0
        while True:
            slot = taken.find(0, slot) if tries < 50 else max(tail, labels[0])  # after that, past all that stands
            if slot < 0 or slot + 256 >= size:
                taken.extend(bytes(size))
                check = np.concatenate([check, np.full(size, -1, np.int32)])
                target, output = (np.concatenate([x, np.zeros(size, np.int32)]) for x in (target, output))
                slot, size = max(slot, 0), 2 * size
                slot, tries = (slot, tries) if slot else (max(tail, labels[0]), 50)
                continue
            at = slot - labels[0]
            if not any(taken[at + c] for c in labels):
                break
            slot += 1
            tries += 1
        tail = max(tail, at + labels[-1] + 1)
        base[s] = at
        passed = int(final[s])
        for c in labels:
            taken[at + c] = 1
            check[at + c], target[at + c], output[at + c] = s, arcs[s][c], passed
            passed += below[arcs[s][c]]
    ends = np.zeros(len(words) + 1, np.int64)
    ends[1:] = np.cumsum([len(ids[i]) for i in order])
    flat = np.fromiter((x for i in order for x in ids[i]), np.uint32, int(ends[-1]))
    parts = {"base": base, "check": check, "target": target, "output": output, "final": np.array(final, np.uint8), "ends": ends, "ids": flat}
    head = json.dumps({"n": len(words), "states": len(live), "longest": max(map(len, words), default=0), "parts": {k: [v.dtype.str, len(v)] for k, v in parts.items()}}).encode()
    out = [_MAGIC, len(head).to_bytes(8, "little"), head]
    at = len(_MAGIC) + 8 + len(head)
    for v in parts.values():
        out.append(bytes(-at % 8))
        out.append(v.tobytes())
        at += len(out[-2]) + len(out[-1])
    return b"".join(out)


class Lexicon:
    """A compiled file, memory-mapped or held; ``lookup`` walks all given words through it side by side."""

    def __init__(self, data) -> None:
        view = memoryview(data)
        if bytes(view[:8]) != _MAGIC:
            raise ValueError("not a lexicon file")
        n = int.from_bytes(view[8:16], "little")
        self.head = json.loads(bytes(view[16 : 16 + n]))
        at = 16 + n
        for name, (kind, count) in self.head["parts"].items():
            at += -at % 8
            array = np.frombuffer(view, kind, count, at)
            setattr(self, name, array)
            at += array.nbytes
        self._ids = self.ids.astype("<u4", copy=False).tobytes()
        self._ends = (self.ends * 4).tolist()

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for words that the lexicon lacks."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        result = np.full(n, -1, np.int64)
        inside = np.flatnonzero(lengths <= self.head["longest"])
        if not len(inside) or not self.head["n"]:
            return result
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = inside[np.argsort(lengths[inside], kind="stable")]
        starts, ends = starts[order], lengths[order]
        state = np.zeros(len(order), np.int32)
        total = np.zeros(len(order), np.int64)
        alive = np.arange(len(order))
        for depth in range(int(ends[-1]) + 1):
            over = ends[alive] == depth
            if over.any():
                done = alive[over]
                good = done[self.final[state[done]] == 1]
                result[order[good]] = total[good]
                alive = alive[~over]
            if not len(alive):
                break
            s = state[alive]
            slot = self.base[s] + text[starts[alive] + depth]
            ok = self.check[slot] == s
            alive, slot = alive[ok], slot[ok]
            total[alive] += self.output[slot]
            state[alive] = self.target[slot]
        return result

    def lookup(self, words: list[bytes]) -> list[bytes | None]:
        """Packed little-endian ids of each word, None for words that the lexicon lacks."""
        ids, ends = self._ids, self._ends
        return [None if r < 0 else ids[ends[r] : ends[r + 1]] for r in self.ranks(words).tolist()]
