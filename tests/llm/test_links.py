"""Links of large groups of near copies."""

import numpy as np

from touchline.llm import jaccard


def parts(n, links):
    of = list(range(n))
    for u, v in links:
        a, b = of[u], of[v]
        of = [a if x == b else x for x in of]
    return {frozenset(k for k in range(n) if of[k] == r) for r in of}


def test_blocks_are_joined_as_a_whole():
    """Random graphs over two blocks: with the blocks' own forests the links join what the graph joins, by one link a meeting of parts."""
    rng = np.random.default_rng(1)
    for n in (2, 5, 20, 40):
        for share in (0.02, 0.1, 0.5, 1.0):
            close = np.triu(rng.random((n, n)) < share, 1)
            close |= close.T
            own = np.arange(n) % 2
            inside = jaccard.forest(close & (own[:, None] == own[None, :]))
            across = jaccard.joining(close, own)
            assert parts(n, inside + across) == parts(n, jaccard.forest(close))
            assert len(inside) + len(across) <= n - 1 + (len(parts(n, inside)) - 1)
    assert len(jaccard.joining(close, own)) == 1


def test_links_of_a_group_grow_with_its_size(spark):
    """2,000 equal signatures are eight blocks: their pairs gave some 16,000 links."""
    sig = bytes(np.arange(jaccard.TREES * jaccard.DEEPEST, dtype=np.uint8))
    path = bytes(4 * jaccard.DEEPEST)
    rows = [(k, bytearray(sig), [bytearray(path)] * jaccard.TREES) for k in range(2000)]
    nodes = spark.createDataFrame(rows, "node long, sig binary, paths array<binary>")
    links = [tuple(r) for r in jaccard.candidates(nodes, 0.8).distinct().collect()]
    assert len(links) < 2 * len(rows)
    of = list(range(2000))
    def root(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x
    for a, b in links:
        of[root(a)] = root(b)
    assert len({root(x) for x in range(2000)}) == 1
