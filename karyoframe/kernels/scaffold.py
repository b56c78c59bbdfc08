"""Order of scaffolds: longest run subsequences, and ways through scaffolds of two genomes that hold each other together."""

from __future__ import annotations

from itertools import groupby


def longest_runs(values: list) -> list[int]:
    """Places of a longest subsequence in which each value stands in one run only; the first values count of equal choices.

    Runs of the sequence are taken as wholes. A state is the set of values that are closed and the one that is open; of
    equal states the longer subsequence stays. There are at most as many states as subsets of values.
    """
    names = {v: k for k, v in enumerate(dict.fromkeys(values))}
    runs, at = [], 0
    for v, group in groupby(values):
        n = len(list(group))
        runs.append((names[v], at, n))
        at += n
    states: dict[tuple[int, int], tuple[int, tuple]] = {(0, -1): (0, ())}
    for name, begin, n in runs:
        new = dict(states)
        for (used, last), (length, path) in states.items():
            if last == name:
                key = (used, last)
            elif used >> name & 1:
                continue
            else:
                key = (used | 1 << name, name)
            if length + n > new.get(key, (-1,))[0]:
                new[key] = (length + n, (path, begin, n))
        states = new
    _, path = max(states.values(), key=lambda s: s[0])
    out: list[int] = []
    while path:
        path, begin, n = path
        out = [*range(begin, begin + n), *out]
    return out


def pruned(ref: dict, qry: dict, open_ends: bool) -> None:
    """Takes away, in place, partners of scaffolds that several others claim.

    ``ref`` and ``qry`` are {scaffold: {partner: (first bin, last bin, bins, strand)}}. A query scaffold in the middle of a
    reference one (with ``open_ends`` its ends are left out) that has other partners keeps this one if it holds more
    bins of it than all others together, else it leaves it. With ``open_ends`` reference scaffolds are then treated alike.
    """

    def one(a: dict, b: dict) -> None:
        for x in sorted(a):
            held = a[x]
            mine = sorted(held)
            if open_ends and held:
                ends = {min(mine, key=lambda y: held[y][0]), max(mine, key=lambda y: held[y][1])}
                mine = [y for y in mine if y not in ends]
            for y in mine:
                others = [z for z in b.get(y, {}) if z != x]
                if y not in held or not others:
                    continue
                gone = others if b[y][x][2] > sum(b[y][z][2] for z in others) else [x]
                for z in gone:
                    b[y].pop(z, None)
                    a.get(z, {}).pop(y, None)

    one(ref, qry)
    if open_ends:
        one(qry, ref)
    for side in (ref, qry):
        for x in [x for x, held in side.items() if not held]:
            del side[x]


def ways(ref: dict, qry: dict, ref_sizes: dict, qry_sizes: dict) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(reference scaffolds, query scaffolds) with strands along the best way through a component.

    A way enters a scaffold at one end, passes its partners in order, and goes on through the last partner that reaches
    beyond it to the next scaffold there. Of all beginnings the one counts whose way is longest, by the mean of the bases
    of both genomes, then the first by name. A scaffold stands where it is met first.
    """
    side, size = (ref, qry), (ref_sizes, qry_sizes)

    def walk(g: int, name: str, strand: int) -> tuple[list, list]:
        seen: tuple[dict, dict] = ({}, {})
        here: tuple | None = (g, name, strand)
        while here:
            g, name, strand = here
            seen[g].setdefault(name, strand)
            other, here = 1 - g, None
            order = sorted(side[g].get(name, {}), key=lambda y: (side[g][name][y][0], y))[::strand]
            for y in order:
                seen[other].setdefault(y, strand * side[g][name][y][3])
            for y in order[::-1]:
                turned = seen[other][y]
                line = sorted(side[other].get(y, {}), key=lambda z: (side[other][y][z][0], z))[::turned]
                after = line[line.index(name) + 1 :] if name in line else []
                fresh = [z for z in after if z not in seen[g]]
                if fresh:
                    here = (g, fresh[0], turned * side[other][y][fresh[0]][3])
                    break
        return list(seen[0].items()), list(seen[1].items())

    best, top = ([], []), -1.0
    for g in (0, 1):
        for name in sorted(side[g]):
            for strand in (1, -1):
                found = walk(g, name, strand)
                total = sum(size[0].get(n, 0) for n, _ in found[0]) / 2 + sum(size[1].get(n, 0) for n, _ in found[1]) / 2
                if total > top:
                    best, top = found, total
    return best
