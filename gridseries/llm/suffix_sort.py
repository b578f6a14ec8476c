"""Deep-shallow sorting of byte strings, with the common prefixes of neighbours.

Multikey quicksort orders the strings by single bytes down to a shallow depth.
Strings that still agree there probably agree for long; a blind trie orders
them: it stores only the places where strings branch, is searched without
looking at what lies between, and compares in full just once per string.
"""

from __future__ import annotations

SHALLOW = 24


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix; the first `start` bytes are known to agree."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        middle = (low + high) // 2 + 1
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class BlindTrie:
    """Branching places only: a node is [depth, {byte: child}], a leaf a list of equal strings."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth = strings, depth
        self.root = None

    def _byte(self, i: int, at: int) -> int:
        return self.strings[i][at] if at < len(self.strings[i]) else -1

    def add(self, i: int) -> None:
        if self.root is None:
            self.root = ([i], None, None)
            return
        node = self.root
        while node[0] is None:  # blind descent; any child will do where the byte is missing
            children = node[2]
            node = children.get(self._byte(i, node[1])) or next(iter(children.values()))
        other = node[0][0]
        same = common(self.strings[i], self.strings[other], self.depth)
        if same == len(self.strings[i]) == len(self.strings[other]):
            node[0].append(i)
            return
        above, node = None, self.root
        while node[0] is None and node[1] < same:
            above, node = (node, self._byte(i, node[1])), node[2][self._byte(i, node[1])]
        if node[0] is None and node[1] == same:
            node[2][self._byte(i, same)] = ([i], None, None)
            return
        fork = (None, same, {self._byte(i, same): ([i], None, None), self._byte(other, same): node})
        if above is None:
            self.root = fork
        else:
            above[0][2][above[1]] = fork

    def walk(self) -> tuple[list[int], list[int]]:
        """Strings in order, and the common prefix of each with the one before it (the first: the start depth)."""
        order, prefixes, todo = [], [], [(self.root, self.depth)]
        while todo:
            (leaf, depth, children), shared = todo.pop()
            if leaf is not None:
                order += leaf
                prefixes += [shared, *[len(self.strings[leaf[0]])] * (len(leaf) - 1)]
            else:
                first, *rest = sorted(children)
                todo += [(children[byte], depth) for byte in reversed(rest)]
                todo.append((children[first], shared))
        return order, prefixes


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings, and the common prefix of each with the one before it (0 for the first)."""
    order: list[int] = []
    prefixes: list[int] = []
    todo = [(list(range(len(strings))), 0, 0)]
    while todo:
        members, depth, shared = todo.pop()
        if len(members) == 1:
            order += members
            prefixes.append(shared)
        elif depth >= shallow:
            trie = BlindTrie(strings, depth)
            for i in members:
                trie.add(i)
            found, inner = trie.walk()
            order += found
            prefixes += [shared, *inner[1:]]
        else:
            pivot = strings[members[len(members) // 2]][depth : depth + 1]
            less, equal, more = [], [], []
            for i in members:
                byte = strings[i][depth : depth + 1]
                (equal if byte == pivot else less if byte < pivot else more).append(i)
            parts = [(less, depth, depth), (equal, depth + 1, depth) if pivot else (equal, shallow, depth), (more, depth, depth)]
            parts = [part for part in parts if part[0]]
            parts[0] = (*parts[0][:2], shared)
            todo += reversed(parts)
    return order, prefixes
