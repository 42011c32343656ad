"""Smallest sets of options that meet every row: reductions, then branch and bound.

Each row lists the options that would deal with it. Three reductions shrink the problem without
changing what the smallest answer costs: a row that contains another row is met with it; an option
whose rows all belong to a better one is never needed; a row with one option forces that option.
What is left falls into independent parts. Each part is searched depth first on its shortest row,
with a lower bound from rows that share no option. ``EFFORT`` bounds the rows looked at by a whole
search; a part that runs out keeps the best set found so far and the answer counts as not proven.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field

EFFORT = 200_000


@dataclass
class Answer:
    """chosen: options in the order of preference; proven: no smaller set exists; unmet: rows without options."""

    chosen: list = field(default_factory=list)
    proven: bool = True
    unmet: int = 0


class _Search:
    def __init__(self, place: dict[Hashable, int], effort: int):
        self.place, self.left, self.proven = place, effort, True

    def reduced(self, rows: Iterable[frozenset]) -> tuple[set, set[frozenset]]:
        """Forced options, and the rows that are still open when nothing more can be left out."""
        forced: set = set()
        open_rows = set(rows)
        while True:
            single = {next(iter(r)) for r in open_rows if len(r) == 1}
            if single:
                forced |= single
                open_rows = {r for r in open_rows if not r & single}
                continue
            smaller = self._options_pruned(self._rows_pruned(open_rows))
            if smaller == open_rows:
                return forced, open_rows
            open_rows = smaller

    def _met(self, rows: Iterable[frozenset]) -> dict[Hashable, set[frozenset]]:
        met: dict[Hashable, set[frozenset]] = {}
        for row in rows:
            for option in row:
                met.setdefault(option, set()).add(row)
        return met

    def _rows_pruned(self, rows: set[frozenset]) -> set[frozenset]:
        kept: set[frozenset] = set()
        of: dict[Hashable, set[frozenset]] = {}
        for row in sorted(rows, key=len):
            if any(k <= row for option in row for k in of.get(option, ())):
                continue
            kept.add(row)
            # A row inside another one shares its best-placed option with it.
            of.setdefault(min(row, key=self.place.__getitem__), set()).add(row)
        return kept

    def _options_pruned(self, rows: set[frozenset]) -> set[frozenset]:
        met = self._met(rows)
        gone: set = set()
        for option in sorted(met, key=self.place.__getitem__, reverse=True):
            rarest = min(met[option], key=len)
            rivals = (o for o in rarest if o != option and o not in gone)
            if any(met[option] <= met[o] for o in rivals if len(met[o]) > len(met[option]) or self.place[o] < self.place[option]):
                gone.add(option)
        return {row - gone for row in rows} if gone else rows

    def parts(self, rows: set[frozenset]) -> list[set[frozenset]]:
        """Rows that share options, directly or through others, together."""
        met, left, out = self._met(rows), set(rows), []
        while left:
            part: set[frozenset] = set()
            todo = [left.pop()]
            while todo:
                row = todo.pop()
                part.add(row)
                near = {r for option in row for r in met[option]} & left
                left -= near
                todo += near
            out.append(part)
        return sorted(out, key=lambda p: min(self.place[o] for r in p for o in r))

    @staticmethod
    def bound(rows: Iterable[frozenset]) -> int:
        """Rows without a common option, short ones first: each needs an option of its own."""
        used: set = set()
        n = 0
        for row in sorted(rows, key=len):
            if not row & used:
                used |= row
                n += 1
        return n

    def first_answer(self, rows: set[frozenset]) -> set:
        chosen: set = set()
        while rows:
            met = self._met(rows)
            best = min(met, key=lambda o: (-len(met[o]), self.place[o]))
            chosen.add(best)
            rows = rows - met[best]
        return chosen

    def solve(self, rows: Iterable[frozenset], below: int) -> set | None:
        """A smallest set of fewer than ``below`` options, or None where there is none."""
        forced, left = self.reduced(rows)
        if len(forced) >= below:
            return None
        chosen = set(forced)
        parts = self.parts(left)
        bounds = [self.bound(p) for p in parts]
        for i, part in enumerate(parts):
            found = self._branch(part, below - len(chosen) - sum(bounds[i + 1 :]), bounds[i])
            if found is None:
                return None
            chosen |= found
        return chosen if len(chosen) < below else None

    def _branch(self, rows: set[frozenset], below: int, bound: int) -> set | None:
        if bound >= below:
            return None
        first = self.first_answer(rows)
        best = first if len(first) < below else None
        below = min(below, len(first))
        met = self._met(rows)
        tried: set = set()
        row = min(rows, key=lambda r: (len(r), sorted(self.place[o] for o in r)))
        for option in sorted(row, key=lambda o: (-len(met[o]), self.place[o])):
            if bound >= below:
                break
            if self.left <= 0:
                self.proven = False
                break
            self.left -= len(rows)
            # Sets with an option that was tried before are known; they need not be met again.
            rest = {r - tried for r in rows - met[option]}
            tried.add(option)
            if frozenset() in rest:
                continue
            found = self.solve(rest, below - 1)
            if found is not None:
                best = found | {option}
                below = len(best)
        return best


def smallest_cover(rows: Iterable[Iterable[Hashable]], preference: Iterable[Hashable], effort: int = EFFORT) -> Answer:
    """rows: options of each row. preference: all options, the preferred first; it decides between
    options that serve equally well. Rows without options are counted as unmet and left aside."""
    place = {option: i for i, option in enumerate(preference)}
    sets = [frozenset(r) for r in rows]
    search = _Search(place, effort)
    chosen = search.solve({s for s in sets if s}, len(place) + 1)
    return Answer(sorted(chosen, key=place.__getitem__), search.proven, sum(not s for s in sets))
