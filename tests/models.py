"""What the operators must give, stated by definition over whole tables in memory."""

from __future__ import annotations

import re
from itertools import combinations

SEPARATOR = {"\t", "\n"}


def read_tsv(text: str) -> list[list[str]]:
    """A tab or newline separates if an even run of backslashes comes before it."""

    def run_before(at: int) -> int:
        return at - len(text[:at].rstrip("\\"))

    ends = [i for i, c in enumerate(text) if c in SEPARATOR and run_before(i) % 2 == 0]
    if not ends or ends[-1] != len(text) - 1 or text[-1] != "\n":
        ends.append(len(text))  # the last record may lack its newline
    rows, row = [], []
    for begin, end in zip([0, *(e + 1 for e in ends)], ends):
        row.append(re.sub(r"\\(.?)", r"\1", text[begin:end], flags=re.DOTALL))
        if end == len(text) or text[end] == "\n":
            rows.append(row)
            row = []
    return rows if text else []


def all_pairs(vectors: list[dict[str, float]], threshold: int) -> dict[tuple[int, int], int]:
    """Similarities in billionths of the pairs that share a term and reach the threshold."""
    nano = {
        (a, b): round(sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items()) * 1e9)
        for a, b in combinations(range(len(vectors)), 2)
        if not vectors[a].keys().isdisjoint(vectors[b])
    }
    return {pair: value for pair, value in nano.items() if value >= threshold}


def leader_of(earlier: list[tuple[int, int]], reassign: int) -> int:
    """Of ``(document, similarity)``: the last most similar one if that is similar enough to
    take over, else the first of all."""
    best = max(s for _, s in earlier)
    if best >= reassign:
        return max(a for a, s in earlier if s == best)
    return min(a for a, _ in earlier)


def takeovers(earlier: list[tuple[int, int]], reassign: int) -> int:
    """Those after the first that reach ``reassign`` and everything before them."""
    values = [s for _, s in sorted(earlier)]
    return sum(k > 0 and s >= reassign and s == max(values[: k + 1]) for k, s in enumerate(values))


def cluster(n: int, pairs: dict[tuple[int, int], int], reassign: int) -> dict:
    """One pass: every part by its definition over the table of pairs."""
    earlier = {b: [(a, s) for (a, x), s in pairs.items() if x == b] for b in range(n)}
    used = {d for pair in pairs for d in pair}
    centricity = {d: sum(s for pair, s in pairs.items() if d in pair) for d in used}
    leader = {b: leader_of(found, reassign) for b, found in earlier.items() if found}

    def rank(d: int) -> tuple[int, int]:
        return centricity[d], -d

    parent = {}
    for t in used:
        better = [d for d in used if leader.get(d) == t and rank(d) > rank(t)]
        if better:
            parent[t] = max(better, key=rank)
        elif t in leader and rank(leader[t]) > rank(t):
            parent[t] = leader[t]

    def root(d: int) -> int:
        return root(parent[d]) if d in parent else d

    medoids = {root(d) for d in parent}
    return {
        "centricity": centricity,
        "leader": leader,
        "parent": parent,
        "clusters": {m: sorted(d for d in parent if root(d) == m) for m in medoids},
        "order": sorted(medoids, key=rank),
        "reassigned": [takeovers(earlier[d], reassign) for d in range(n)],
        "splices": len(parent.keys() & set(parent.values())),
    }


def passes(vectors: dict[int, dict[str, float]], block_size: int, threshold: int, reassign: int):
    """Clusters after all passes, ``{medoid: members}``: with and without those that
    joined no other in the merge."""

    def one_pass(ids: list[int]) -> tuple[dict[int, set[int]], set[int]]:
        long_enough = [d for d in ids if len(vectors[d]) > 1]
        clusters: dict[int, set[int]] = {}
        rest: set[int] = set()
        while long_enough:
            block, long_enough = long_enough[:block_size], long_enough[block_size:]
            found = cluster(len(block), all_pairs([vectors[d] for d in block], threshold), reassign)
            clusters |= {block[m]: {block[d] for d in found["clusters"][m]} for m in found["order"]}
            rest |= set(block) - {block[d] for d in found["centricity"]}
        return clusters, rest

    blocks, rest = one_pass(sorted(vectors))
    every = blocks | one_pass(sorted(rest))[0]
    if len(every) > 1:
        joins, _ = one_pass(list(every))
        merged = {
            m: every[m].union(subs, *(every[s] for s in subs)) for m, subs in joins.items()
        }
        absorbed = set(joins).union(*joins.values())
        alone = {m: members for m, members in every.items() if m not in absorbed}
    else:
        merged, alone = every, {}
    return merged | alone, merged
