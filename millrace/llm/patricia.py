"""A compressed radix trie over byte strings whose terminal nodes own a group of equal strings.

The trie holds at most ``max_bytes`` of labels. Beyond that its largest subtree goes to a task-local
spill file, together with every later string below the same prefix; spilled subtrees are then built and
read back one after another, so a partition of any size is resolved in bounded memory.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Callable, Iterator

_HEAD = struct.Struct("<qqq?")
#: What a node costs besides its label.
NODE_BYTES = 200


class _Node:
    __slots__ = ("children", "copies", "label", "owner")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.owner, self.copies = label, {}, None, 0


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``, by bisection over memory compares."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """``choose`` picks the owner of two identifiers (``min`` or ``max``); a null identifier loses to any other."""

    def __init__(self, choose: Callable[[int, int], int] = min, max_bytes: int = 128 << 20) -> None:
        self.choose, self.max_bytes = choose, max_bytes
        self.root, self.held, self.spilled = _Node(b""), 0, {}

    def _own(self, node: _Node, owner: int | None, copies: int) -> None:
        node.copies += copies
        if owner is not None:
            node.owner = owner if node.owner is None else self.choose(node.owner, owner)

    def insert(self, text: bytes, owner: int | None, copies: int = 1) -> None:
        for prefix, file in self.spilled.items():
            if text.startswith(prefix):
                self._put(file, text, owner, copies)
                return
        node, at, size = self.root, 0, len(text)
        while at < size:
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                self.held += size - at + NODE_BYTES
                node = child
                break
            label = child.label
            if not text.startswith(label, at):
                k = _common(label, text, at)
                middle = _Node(label[:k])
                child.label = label[k:]
                middle.children[child.label[0]] = child
                node.children[text[at]] = child = middle
                self.held += NODE_BYTES
            node, at = child, at + len(child.label)
        self._own(node, owner, copies)
        if self.held > self.max_bytes:
            self._spill()

    @staticmethod
    def _put(file, text: bytes, owner: int | None, copies: int) -> None:
        file.write(_HEAD.pack(len(text), owner or 0, copies, owner is None))
        file.write(text)

    def _walk(self, node: _Node, before: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        todo = [(node, before)]
        while todo:
            node, before = todo.pop()
            text = before + node.label
            if node.copies:
                yield text, node.owner, node.copies
            todo += [(x, text) for x in node.children.values()]

    @staticmethod
    def _weight(node: _Node) -> int:
        total, todo = 0, [node]
        while todo:
            node = todo.pop()
            total += len(node.label) + NODE_BYTES
            todo += node.children.values()
        return total

    def _spill(self) -> None:
        """Move the largest subtree below the first branching node to a file."""
        node, before = self.root, b""
        while len(node.children) == 1 and not node.copies and next(iter(node.children.values())).children:
            node = next(iter(node.children.values()))
            before += node.label
        if len(node.children) + bool(node.copies) < 2:
            return  # one string only: it has to be held anyway
        key, child = max(node.children.items(), key=lambda x: self._weight(x[1]))
        self.held -= self._weight(child)
        file = tempfile.TemporaryFile()
        for text, owner, copies in self._walk(child, before):
            self._put(file, text, owner, copies)
        del node.children[key]
        self.spilled[before + bytes([key])] = file

    def groups(self) -> Iterator[tuple[bytes, int | None, int]]:
        """(string, owner, copies) of every distinct string, once; empties the trie."""
        yield from self._walk(self.root, b"")
        self.root, self.held = _Node(b""), 0
        spilled, self.spilled = self.spilled, {}
        for file in spilled.values():
            with file:
                file.seek(0)
                below = PatriciaTrie(self.choose, self.max_bytes)
                while head := file.read(_HEAD.size):
                    size, owner, copies, none = _HEAD.unpack(head)
                    below.insert(file.read(size), None if none else owner, copies)
            yield from below.groups()
