"""A token sequence under edit: the k-th place of a kind, and replacements, in time that grows with the logarithm.

The ids are held in blocks of some BLOCK; for each kind of place a Fenwick tree holds how many of it
each block has. A place's kinds depend on its id and the next one, so an edit touches the flags of
the ids it puts in and of the one before them.
"""

from __future__ import annotations

from collections.abc import Callable

BLOCK = 64


class Places:
    """``kinds(id, next id or None)``: a bit mask of the kinds of a place; bit 0 is usually set for every place."""

    def __init__(self, ids: list[int], kinds: Callable[[int, int | None], int], n_kinds: int):
        self.kinds, self.n_kinds = kinds, n_kinds
        self.blocks = [list(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)] or [[]]
        flags = [kinds(a, b) for a, b in zip(ids, [*ids[1:], None], strict=False)]
        self.flags = [flags[i : i + BLOCK] for i in range(0, len(flags), BLOCK)] or [[]]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.trees = [[0] * (self.size + 1) for _ in range(n_kinds)]
        self.totals = [0] * n_kinds
        for b, row in enumerate(self.flags):
            for kind in range(n_kinds):
                self._add(kind, b, sum(f >> kind & 1 for f in row))

    def _add(self, kind: int, block: int, n: int) -> None:
        if n:
            tree, at = self.trees[kind], block + 1
            self.totals[kind] += n
            while at <= self.size:
                tree[at] += n
                at += at & -at

    def count(self, kind: int) -> int:
        return self.totals[kind]

    def find(self, kind: int, k: int) -> tuple[int, int]:
        """Block and offset of the k-th place (from 0) of a kind."""
        tree, at, step = self.trees[kind], 0, self.size
        while step:
            if at + step <= self.size and tree[at + step] <= k:
                at += step
                k -= tree[at]
            step >>= 1
        for j, f in enumerate(self.flags[at]):
            if f >> kind & 1:
                if not k:
                    return at, j
                k -= 1
        raise IndexError(k)

    def following(self, block: int, at: int, n: int) -> list[int]:
        """Up to n ids from a place on."""
        out = self.blocks[block][at : at + n]
        while len(out) < n and (block := block + 1) < len(self.blocks):
            out += self.blocks[block][: n - len(out)]
        return out

    def replace(self, block: int, at: int, width: int, new: list[int]) -> None:
        """Puts ``new`` where ``width`` ids stood from a place on."""
        ids = self.blocks[block]
        gone = min(width, len(ids) - at)
        self._cut(block, at, gone)
        ahead, left = block, width - gone
        while left:
            ahead += 1
            some = min(left, len(self.blocks[ahead]))
            self._cut(ahead, 0, some)
            left -= some
        ids[at:at] = new
        self.flags[block][at:at] = [0] * len(new)
        for j in range(at, at + len(new)):
            self._flag(block, j)
        if at:
            self._flag(block, at - 1)
        else:
            behind = block - 1
            while behind >= 0 and not self.blocks[behind]:
                behind -= 1
            if behind >= 0:
                self._flag(behind, len(self.blocks[behind]) - 1)

    def _cut(self, block: int, at: int, n: int) -> None:
        for f in self.flags[block][at : at + n]:
            for kind in range(self.n_kinds):
                self._add(kind, block, -(f >> kind & 1))
        del self.blocks[block][at : at + n], self.flags[block][at : at + n]

    def _flag(self, block: int, at: int) -> None:
        pair = self.following(block, at, 2)
        new, old = self.kinds(pair[0], pair[1] if len(pair) > 1 else None), self.flags[block][at]
        if new != old:
            self.flags[block][at] = new
            for kind in range(self.n_kinds):
                self._add(kind, block, (new >> kind & 1) - (old >> kind & 1))

    def ids(self) -> list[int]:
        return [i for block in self.blocks for i in block]
