"""Adaptive radix trees over byte keys of fixed-width ids: nodes that grow with their children, and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

LAYOUTS = (4, 16, 48, 256)  # children that a node of each layout holds


class Node:
    """A node with the bytes `path` that lead to it from its parent, and `value` if a key ends here.

    With 4 and 16 children, `keys` are their sorted first bytes; with 48, `keys` maps each of 256 bytes to a slot (0: none);
    with 256, children stand at their byte.
    """

    __slots__ = ("path", "value", "layout", "keys", "children", "size")

    def __init__(self, path: bytes, value: int | None = None):
        self.path, self.value = path, value
        self.layout, self.keys, self.children, self.size = 4, bytearray(), [], 0

    def child(self, byte: int) -> Node | None:
        if self.layout == 256:
            return self.children[byte]
        if self.layout == 48:
            slot = self.keys[byte]
            return self.children[slot - 1] if slot else None
        at = bisect_left(self.keys, byte)
        return self.children[at] if at < self.size and self.keys[at] == byte else None

    def put(self, byte: int, node: Node) -> None:
        """Adds or replaces the child for `byte`; a full node takes the next layout first."""
        if self.layout <= 16:
            at = bisect_left(self.keys, byte)
            if at < self.size and self.keys[at] == byte:
                self.children[at] = node
                return
        elif self.child(byte) is not None:
            if self.layout == 48:
                self.children[self.keys[byte] - 1] = node
            else:
                self.children[byte] = node
            return
        if self.size == self.layout:
            self._grow()
        if self.layout <= 16:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.children.insert(at, node)
        elif self.layout == 48:
            self.children.append(node)
            self.keys[byte] = len(self.children)
        else:
            self.children[byte] = node
        self.size += 1

    def _grow(self) -> None:
        pairs = list(self.items())
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]
        if self.layout == 16:
            return
        if self.layout == 48:
            self.keys, self.children = bytearray(256), [n for _, n in pairs]
            for slot, (byte, _) in enumerate(pairs):
                self.keys[byte] = slot + 1
        else:
            self.keys, self.children = bytearray(), [None] * 256
            for byte, node in pairs:
                self.children[byte] = node

    def items(self) -> Iterator[tuple[int, Node]]:
        """Children in the order of their bytes."""
        if self.layout <= 16:
            yield from zip(self.keys, self.children)
        elif self.layout == 48:
            yield from ((b, self.children[s - 1]) for b, s in enumerate(self.keys) if s)
        else:
            yield from ((b, n) for b, n in enumerate(self.children) if n is not None)


class Tree:
    """A radix tree of whole keys; a key may begin another."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: int) -> int:
        """Adds `key` with `value` if it is not there, and gives the value that it has."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.value is None:
                    node.value = value
                return node.value
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at:], value))
                return value
            path = below.path
            if key.startswith(path, at):
                node, at = below, at + len(path)
                continue
            same = 0
            while same < len(path) and at + same < len(key) and path[same] == key[at + same]:
                same += 1
            between = Node(path[:same])  # the compressed path parts here
            below.path = path[same:]
            between.put(below.path[0], below)
            node.put(key[at], between)
            node, at = between, at + same
