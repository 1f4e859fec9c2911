"""Leaves, roots, paths and multiproofs against a plain recursive tree."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewell.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, leaf double"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and for each leaf its steps."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            paths[k].append("-" if j >= len(nodes) else ("L" if j < i else "R") + nodes[j])
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def brute(rows, changed=lambda r: r):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), leaf_of(*changed(r))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    below = {x: tree([m[2] for m in sorted(groups[x])]) for x in langs}
    root, above = tree([below[x][0] for x in langs])
    out = []
    for x, up in zip(langs, above, strict=True):
        for (known, i, leaf, new), path in zip(sorted(groups[x]), below[x][1], strict=True):
            out.append((i if known else None, leaf, below[x][0], root, [*path, *up], merkle.fold(new, [*path, *up])))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 0.5) for r in rows], SCHEMA)


def proved(df, **options):
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.path, r.folded_root) for r in merkle.multiproof(df, **options).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_trees_of_many_widths(spark, levels):
    rng = random.Random(levels)
    langs = [None, "", "a", "ä", "z\U0001f642", "Z", "=", "b"]
    rows = [(k, f"text {k} é", x, rng.choice([None, "s"]), rng.choice([None, k])) for x, n in zip(langs, (1, 2, 3, 5, 8, 13, 21, 37), strict=True) for k in rng.sample(range(1000), n)]
    rows += [(None, None, None, None, None)] * 2 + [(7, "tie", "a", None, 1), (7, "other", "a", None, 2), (7, "tie", "a", None, 1)]
    rng.shuffle(rows)
    more = lambda r: (*r[:4], r[4] + 1 if r[4] is not None and r[4] % 3 == 0 else r[4])
    new = {"n_chars": F.when(F.col("n_chars") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = proved(merkle.leaves(frame(spark, rows).repartition(5), changed=new), levels=levels)
    assert got == brute(rows, more)
    assert {g[5] == g[3] for g in got} == {True, False}


def test_one_row_and_none(spark):
    row = (1, "x", "en", None, 1)
    assert proved(merkle.leaves(frame(spark, [row]))) == [(1, leaf_of(*row), leaf_of(*row), leaf_of(*row), [], leaf_of(*row))]
    assert proved(merkle.leaves(frame(spark, []))) == []


def test_multiproofs_are_enough_and_minimal():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 7, 16, 37, 100):
        nodes = [[sha(str(i)) for i in range(width)]]
        while len(nodes[-1]) > 1:
            nodes.append([sha(*nodes[-1][i : i + 2]) for i in range(0, len(nodes[-1]), 2)])
        for size in {1, 2, width // 2, width} - {0}:
            known = rng.choice(width, size=min(size, width), replace=False)
            need = merkle.missing(known, width)

            def derive(given, width=width, known=known, nodes=nodes):
                have = {(0, int(i)) for i in known} | set(given)
                for level, n in enumerate(merkle.heights(width)[:-1]):
                    for i in range(0, n, 2):
                        if (level, i) in have and (i + 1 >= n or (level, i + 1) in have):
                            have.add((level + 1, i // 2))
                return (len(nodes) - 1, 0) in have and all((level, (int(k) >> level) ^ 1) in have or (int(k) >> level) ^ 1 >= n for k in known for level, n in enumerate(merkle.heights(width)[:-1]))

            assert derive(need)
            assert not any(derive(need[:k] + need[k + 1 :]) for k in range(len(need)))
