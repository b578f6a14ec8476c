"""An adaptive radix tree over byte keys: node layouts that grow with their children, compressed paths."""

from __future__ import annotations

from collections.abc import Iterator


class Sorted:
    """Up to `most` children, their bytes in a small sorted array."""

    __slots__ = ("most", "labels", "children")

    def __init__(self, most: int = 4):
        self.most = most
        self.labels = bytearray()
        self.children: list[Node] = []

    def get(self, label: int) -> Node | None:
        at = self.labels.find(label)
        return self.children[at] if at >= 0 else None

    def put(self, label: int, child: Node) -> Sorted | Indexed:
        """The layout that holds the child: this one, or a larger one if it is full."""
        if len(self.labels) == self.most:
            wider = Sorted(16) if self.most == 4 else Indexed()
            for old, node in self:
                wider.put(old, node)
            return wider.put(label, child)
        at = sum(old < label for old in self.labels)
        self.labels.insert(at, label)
        self.children.insert(at, child)
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return zip(self.labels, self.children, strict=True)


class Indexed:
    """Up to 48 children, found through 256 one-byte places."""

    __slots__ = ("places", "children")
    most = 48

    def __init__(self):
        self.places = bytearray(256)
        self.children: list[Node] = []

    def get(self, label: int) -> Node | None:
        place = self.places[label]
        return self.children[place - 1] if place else None

    def put(self, label: int, child: Node) -> Indexed | Direct:
        if len(self.children) == self.most:
            wider = Direct()
            for old, node in self:
                wider.put(old, node)
            return wider.put(label, child)
        self.children.append(child)
        self.places[label] = len(self.children)
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((label, self.children[place - 1]) for label, place in enumerate(self.places) if place)


class Direct:
    """One place for each of the 256 bytes."""

    __slots__ = ("children",)
    most = 256

    def __init__(self):
        self.children: list[Node | None] = [None] * 256

    def get(self, label: int) -> Node | None:
        return self.children[label]

    def put(self, label: int, child: Node) -> Direct:
        self.children[label] = child
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((label, node) for label, node in enumerate(self.children) if node is not None)


class Node:
    """The bytes of a path that all keys below share, what ends after them, and the children by next byte."""

    __slots__ = ("path", "items", "below")

    def __init__(self, path: bytes):
        self.path = path
        self.items: list = []
        self.below: Sorted | Indexed | Direct = Sorted()

    def put(self, label: int, child: Node) -> None:
        self.below = self.below.put(label, child)


def shared_length(a: bytes, b: bytes) -> int:
    """Number of leading bytes that are equal."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    apart = int.from_bytes(a[:most], "big") ^ int.from_bytes(b[:most], "big")
    return most - (apart.bit_length() + 7) // 8


class RadixTree:
    """Keys of any length with any number of items each; one key may be the beginning of another."""

    def __init__(self):
        self.root: Node | None = None

    def add(self, key: bytes, item) -> None:
        if self.root is None:
            self.root = Node(key)
            self.root.items.append(item)
            return
        node, above, label, rest = self.root, None, 0, key
        while True:
            same = shared_length(node.path, rest)
            if same < len(node.path):
                fork = Node(node.path[:same])
                fork.put(node.path[same], node)
                node.path = node.path[same + 1 :]
                if above is None:
                    self.root = fork
                else:
                    self._swap(above, label, fork)
                node = fork
            rest = rest[same:]
            if not rest:
                node.items.append(item)
                return
            child = node.below.get(rest[0])
            if child is None:
                leaf = Node(rest[1:])
                leaf.items.append(item)
                node.put(rest[0], leaf)
                return
            above, label, node, rest = node, rest[0], child, rest[1:]

    @staticmethod
    def _swap(above: Node, label: int, child: Node) -> None:
        below = above.below
        if isinstance(below, Sorted):
            below.children[below.labels.find(label)] = child
        elif isinstance(below, Indexed):
            below.children[below.places[label] - 1] = child
        else:
            below.children[label] = child

    def aligned(self, width: int) -> Iterator[tuple[int, list]]:
        """(length, items at or below) for every key beginning whose length is a positive multiple of `width`.

        Deeper ones come before the ones they begin with. A list is shared between
        the lengths of one path and is only valid until the next step.
        """
        if self.root is None:
            return
        # Entries: node, bytes above it, its remaining children, items so far.
        stack = [(self.root, 0, None, [])]
        while stack:
            node, above, children, items = stack.pop()
            if children is None:
                children = (child for _, child in node.below)
                items.extend(node.items)
            child = next(children, None)
            end = above + len(node.path)
            if child is not None:
                stack.append((node, above, children, items))
                stack.append((child, end + 1, None, []))
                continue
            first = above - (1 if above else 0)  # the byte that leads here belongs to this path
            for length in range(end - end % width, first, -width):
                yield length, items
            if stack:
                stack[-1][3].extend(items)
