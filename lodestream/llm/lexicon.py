"""A minimal acyclic transducer from words to token ids, built from sorted words and read from a memory map.

States are shared wherever their right languages are equal (incremental construction over sorted input), and each
transition carries a number such that the numbers along a word's path add up to the word's rank; the rank finds its
ids. The file holds, after a header of six 32-bit counts, the arrays in the order of `_PARTS`.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

#: Arrays of the file: name, type, index of its count in the header.
_PARTS = (("first", "<u4", 1), ("target", "<u4", 2), ("add", "<u4", 2), ("offset", "<u4", 4), ("ids", "<u4", 5), ("final", "u1", 3), ("label", "u1", 2))
_HEAD = struct.Struct("<6I")
_BYTES = [bytes([b]) for b in range(256)]


class _State:
    __slots__ = ("edges", "final", "number", "words")

    def __init__(self):
        self.edges: list[tuple[int, _State]] = []
        self.final = False
        self.number = -1
        self.words = 0

    def key(self):
        return (self.final, *((b, id(s)) for b, s in self.edges))


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The file's bytes for distinct words with their ids. Memory is in proportion to the entries: bound their number."""
    entries = sorted(entries)
    root, register = _State(), {}

    def settle(path: list[_State], depth: int) -> None:
        """Replace the states of the last word below depth by registered equals."""
        while len(path) > depth + 1:
            state = path.pop()
            parent = path[-1]
            parent.edges[-1] = (parent.edges[-1][0], register.setdefault(state.key(), state))

    path, last = [root], b""
    for word, _ in entries:
        depth = 0
        while depth < min(len(last), len(word)) and last[depth] == word[depth]:
            depth += 1
        settle(path, depth)
        for b in word[depth:]:
            state = _State()
            path[-1].edges.append((b, state))
            path.append(state)
        path[-1].final = True
        last = word
    settle(path, 0)

    order: list[_State] = []  # children before parents
    stack = [(root, False)]
    while stack:
        state, done = stack.pop()
        if done:
            if state.number < 0:
                state.number = len(order)
                state.words = state.final + sum(s.words for _, s in state.edges)
                order.append(state)
        elif state.number < 0:
            stack.append((state, True))
            stack += [(s, False) for _, s in state.edges if s.number < 0]
    first, target, add, label = [0], [], [], bytearray()
    for state in order:
        passed = int(state.final)
        for b, s in state.edges:
            label.append(b)
            target.append(s.number)
            add.append(passed)
            passed += s.words
        first.append(len(target))
    parts = {
        "first": first, "target": target, "add": add, "final": [int(s.final) for s in order], "label": np.frombuffer(bytes(label), "u1"),
        "offset": np.cumsum([0] + [len(ids) for _, ids in entries]), "ids": [i for _, ids in entries for i in ids],
    }
    head = _HEAD.pack(root.number, len(first), len(target), len(order), len(entries) + 1, len(parts["ids"]))
    return head + b"".join(np.asarray(parts[name], dtype=kind).tobytes() for name, kind, _ in _PARTS)


class Lexicon:
    """Words looked up in a lexicon file that is mapped, not read: the processes of one machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = _HEAD.unpack_from(self._map)
        self._root, at, view = head[0], _HEAD.size, memoryview(self._map)
        for name, kind, count in _PARTS:
            size = head[count] * np.dtype(kind).itemsize
            setattr(self, "_" + name, view[at : at + size].cast("I" if kind == "<u4" else "B"))
            if name == "label":
                self._labels_at = at
            at += size
        self.states, self.words = head[3], head[4] - 1

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers, or None."""
        state, rank, first, find = self._root, 0, self._first, self._map.find
        base, add, target = self._labels_at, self._add, self._target
        for b in word:
            at = find(_BYTES[b], base + first[state], base + first[state + 1]) - base
            if at < 0:
                return None
            rank += add[at]
            state = target[at]
        if not self._final[state]:
            return None
        return self._ids[self._offset[rank] : self._offset[rank + 1]].tobytes()
