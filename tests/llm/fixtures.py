"""Small documents with every odd case, and plain versions of the operators."""

import collections
import re

SCHEMA = "doc_id long, text string, lang string, size long, shard string"


def odd_documents(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, -1, "x") for i, t in rows], SCHEMA)


def prose(seed: int, n: int) -> list[str]:
    return [f"w{(seed * 7919 + i * i * 31 + i) % 5003}" for i in range(n)]


ODD = [
    (0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "one two"), (5, " ".join(prose(1, 60))), (6, " ".join(prose(1, 60))),
    (7, " ".join(prose(1, 59) + ["Änderung"])), (8, " ".join(prose(2, 3000))), (9, " ".join(prose(2, 2999) + ["end"])),
    (10, "ÉTÉ naïve 日本語 😀 don't <|endoftext|> <s> 42"), (None, "null id text here"), (12, "x" * 5000), (5, " ".join(prose(1, 60))),
]


def shingle_sets(rows, k):
    out = []
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        out.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def brute_components(rows, k, num, den):
    """{doc_id: (set size, smallest reachable doc_id)} by comparing all pairs that share a shingle."""
    sets = shingle_sets(rows, k)
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for at, (i, s) in enumerate(sets):
        common = collections.Counter(o for g in s for o in holders[g])
        for o, n in common.items():
            if den * n >= num * (len(s) + len(sets[o][1]) - n):
                a, b = find(i), find(sets[o][0])
                up[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(at)
    return {i: (len(s), find(i)) for i, s in sets}
