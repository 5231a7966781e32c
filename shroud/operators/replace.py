"""Many literal values replaced in the parts of one document, in one pass over each part.

The result is that of replacing every value in turn, in the given order, all its occurrences from the left
(``str.replace``): a replacement may be hit by a later value. An Aho-Corasick automaton over the document's values
finds every occurrence in a part at once. The occurrences are then visited in the values' order; a replacement
joins the text as new characters, and only its surroundings, as far as the longest value reaches, are searched
again. So a part costs about its length plus its occurrences, not its length times the values.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left


class Replacer:
    """The ordered (original, replacement) pairs of a document; empty originals are ignored."""

    def __init__(self, pairs: list[tuple[str, str]]):
        import ahocorasick

        self.pairs = pairs
        self.reach = max((len(o) for o, _ in pairs), default=0) - 1
        self.automaton = ahocorasick.Automaton()
        for i, (original, _) in enumerate(pairs):
            if original and not self.automaton.exists(original):
                self.automaton.add_word(original, i)
        if len(self.automaton):
            self.automaton.make_automaton()

    def _hits(self, text: str):
        """(value, start) of every occurrence of every value in ``text``."""
        for last, i in self.automaton.iter(text):
            yield i, last + 1 - len(self.pairs[i][0])

    def replace(self, text: str) -> str:
        if not len(self.automaton):
            return text
        found: dict[int, list] = {}
        for i, start in self._hits(text):
            found.setdefault(i, []).append(start)
        if not found:
            return text
        spliced = _Spliced(text)
        queue = list(found)
        heapq.heapify(queue)
        while queue:
            i = heapq.heappop(queue)
            original, new = self.pairs[i]
            for node in sorted(set(found.pop(i)), key=spliced.order):
                run = spliced.matches(node, original)
                if run is None:
                    continue
                window, nodes = spliced.splice(run, new, self.reach)
                for j, at in self._hits(window):
                    if j > i:
                        if j not in found:
                            found[j] = []
                            heapq.heappush(queue, j)
                        found[j].append(nodes[at])
        return spliced.text()


class _Spliced:
    """A text as linked characters: node k < n is character k of the text, n is its end, the later ones are new.

    Only changed links are kept, so the cost follows the replacements."""

    def __init__(self, text: str):
        self.original, self.n = text, len(text)
        self.new: list[str] = []
        self.after: dict[int, int] = {}
        self.before: dict[int, int] = {}
        self.gone: set[int] = set()
        self.place: list[tuple[int, ...]] = []  # of new nodes: the place they took, then their number
        self.head = 0

    def order(self, node: int) -> tuple[int, ...]:
        return (node,) if node <= self.n else self.place[node - self.n - 1]

    def _next(self, node: int) -> int:
        return self.after.get(node, node + 1)

    def _previous(self, node: int) -> int:
        return self.before.get(node, node - 1)

    def _char(self, node: int) -> str:
        return self.original[node] if node < self.n else self.new[node - self.n - 1]

    def matches(self, node: int, value: str) -> list[int] | None:
        """The nodes of ``value`` from ``node`` on, if it stands there."""
        if node in self.gone:
            return None
        run = []
        for c in value:
            if node == self.n or self._char(node) != c:
                return None
            run.append(node)
            node = self._next(node)
        return run

    def splice(self, run: list[int], value: str, reach: int) -> tuple[str, list[int]]:
        """Puts ``value`` in the place of the nodes; the new surroundings and their nodes."""
        first = self._previous(run[0]) if run[0] != self.head else -1
        end, place = self._next(run[-1]), self.order(run[0])
        fresh = range(self.n + 1 + len(self.new), self.n + 1 + len(self.new) + len(value))
        self.gone.update(run)
        self.new.extend(value)
        self.place.extend((*place, k) for k in range(len(value)))
        chain = [*fresh]
        for a, b in zip([first, *chain], [*chain, end]):
            if a < 0:
                self.head = b
            else:
                self.after[a] = b
            self.before[b] = a
        left, node = [], first
        while node >= 0 and len(left) < reach:
            left.append(node)
            node = self._previous(node) if node != self.head else -1
        right, node = [], end
        while node != self.n and len(right) < reach:
            right.append(node)
            node = self._next(node)
        nodes = [*reversed(left), *chain, *right]
        return "".join(map(self._char, nodes)), nodes

    def text(self) -> str:
        jumps = sorted(k for k in self.after if k < self.n)
        out, node = [], self.head
        while node != self.n:
            if node < self.n:  # original characters up to the next changed link
                at = bisect_left(jumps, node)
                last = jumps[at] if at < len(jumps) else self.n - 1
                out.append(self.original[node : last + 1])
                node = self._next(last)
            else:
                out.append(self._char(node))
                node = self._next(node)
        return "".join(out)
