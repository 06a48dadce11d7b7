"""Splice graph of transcripts that start at one place, its unbranched paths, and what kind of event each path is."""

from __future__ import annotations

from collections import defaultdict

#: Kinds of edges, one letter each: start site, exon, intron, end site; and the place before a start and after an end.
START, EXON, INTRON, END, OUTSIDE = "S", "E", "I", "T", -1
Exons = list[tuple[int, int]]


def edges_of(exons: Exons, forward: bool) -> list[tuple[int, int, str]]:
    """(from, to, kind) along a transcript in its own direction; an exon runs between its ends, an intron between the exons' bases beside it."""
    steps = exons if forward else [(b, a) for a, b in reversed(exons)]
    out = [(OUTSIDE, steps[0][0], START)]
    for i, (a, b) in enumerate(steps):
        out.append((a, b, EXON))
        if i + 1 < len(steps):
            out.append((b, steps[i + 1][0], INTRON))
    return [*out, (steps[-1][1], OUTSIDE, END)]


def paths(transcripts: dict[str, Exons], forward: bool) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(from, to, kinds, transcripts) of maximal paths between places where the graph branches or meets, in order."""
    ids: dict[tuple[int, int, str], set[str]] = defaultdict(set)
    for name, exons in transcripts.items():
        for edge in edges_of(exons, forward):
            ids[edge].add(name)
    following, meeting = defaultdict(list), defaultdict(int)
    for edge in ids:
        following[edge[0]].append(edge)
        meeting[edge[1]] += 1
    found, seen, stack = [], set(), [e for e in ids if e[2] == START]
    while stack:
        edge = first = stack.pop()
        kinds = edge[2]
        while edge[2] != END and meeting[edge[1]] == 1 and len(following[edge[1]]) == 1:
            edge = following[edge[1]][0]
            kinds += edge[2]
        found.append((first[0], edge[1], kinds, tuple(sorted(ids[first]))))
        if edge[2] != END:
            fresh = [e for e in following[edge[1]] if e not in seen]
            seen.update(fresh)
            stack += fresh
    return sorted(found)


def events(transcripts: dict[str, Exons], forward: bool) -> list[tuple[int, int, str, str, tuple[str, ...]]]:
    """(from, to, type, kinds, transcripts) of paths that leave a place with others.

    Two paths, one over an intron and one over an exon between introns, are a cassette exon skipped and included; three or
    more of exon and intron are alternative donors, of intron and exon alternative acceptors. Otherwise a path that ends
    is an alternative end, one that starts an alternative start, and any other is miscellaneous.
    """
    leaving = defaultdict(list)
    for path in paths(transcripts, forward):
        leaving[path[0]].append(path)
    out = []
    for own in leaving.values():
        if len(own) < 2:
            continue
        kinds = [k for _, _, k, _ in own]
        types = ["alt_tts" if k.endswith(END) else "alt_tss" if k.startswith(START) else "miscellaneous" for k in kinds]
        if sorted(kinds) == [INTRON, INTRON + EXON + INTRON]:
            types = ["skipped_cassette_exon" if k == INTRON else "included_cassette_exon" for k in kinds]
        elif len(own) > 2 and set(kinds) in ({EXON + INTRON}, {INTRON + EXON}):
            types = ["alt_donor" if kinds[0][0] == EXON else "alt_acceptor"] * len(own)
        out += [(a, b, t, k, ids) for (a, b, k, ids), t in zip(own, types, strict=True)]
    return sorted(out)
