"""The filter by similarity against brute force over all pairs."""

import numpy as np
import pytest

from tracewell.llm import simhash, similar
from tracewell.llm.common import looked_up

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pra", "sti", "vo") for b in ("n", "ra", "tel", "shu", "kig", "d")]


def brute_kept(rows):
    """Least id (null last) of each component of texts whose sets of five-word shingles are similar to 0.8."""
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    groups = {}
    for (k, text), r in zip(rows, root, strict=True):
        groups.setdefault(r, []).append((k is None, k or 0, k))
    return [min(g, key=lambda x: x[:2])[2:] for g in groups.values()]


def test_hot_keys_are_looked_up(spark):
    """Whatever the share of a key, the rows are those of a plain join."""
    rows = spark.createDataFrame([(i if i % 3 else 7, i) for i in range(900)] + [(None, 1)], "k long, v long")
    found = spark.createDataFrame([(7, 302, "hot"), (8, 1, "cool"), (10, 1, "cool")], "k long, records long, name string")
    for how in ("inner", "left"):
        got = looked_up(rows, found, ["k"], 901, how)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(found.drop("records"), "k", how).collect()))


def edited(words, r, n):
    out = list(words)
    for i in r.choice(len(out), n, replace=False):
        out[i] = f"edit{r.integers(1 << 40)}"
    return " ".join(out)


@pytest.mark.parametrize("hot", [2, 8])
def test_near_copies_of_similarity_80(spark, monkeypatch, hot):
    monkeypatch.setattr(similar, "HOT_BAND", hot)
    r, rows = np.random.default_rng(hot), []
    for k in range(30):
        words = list(r.choice(WORDS, 300))
        rows += [(10 * k, " ".join(words))] + [(10 * k + i, edited(words, r, n)) for i, n in ((1, 2), (2, 5), (3, 25))]
    base = list(r.choice(WORDS, 300))
    rows += [(1000, " ".join(base))] + [(1001 + i, edited(base, r, 4)) for i in range(40)]
    rows += [(5, "some other text"), (10, "a text with an id that is there twice"), (None, "no id"), (None, " ".join(base).upper()), (None, "NO  id"), (20, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((x["doc_id"] for x in kept.collect()), key=lambda x: (x is None, x or 0))
    assert got == sorted((x[0] for x in brute_kept(rows)), key=lambda x: (x is None, x or 0))
    assert simhash.keep_first(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("cell", "grams"), [(256, 1 << 20), (4, 1 << 20), (256, 700)])
def test_links_within_bands_that_many_share(spark, monkeypatch, cell, grams):
    """Edits of texts that are not there themselves, about as similar as asked for: chains of links, found whatever their band's size and cells."""
    monkeypatch.setattr(similar, "HOT_BAND", 2)
    monkeypatch.setattr(similar, "CELL", cell)
    monkeypatch.setattr(similar, "CELL_GRAMS", grams)
    r, rows = np.random.default_rng(12), []
    for k in range(12):
        words = list(r.choice(WORDS, 150))
        rows += [(1000 * k + i, edited(words, r, 2)) for i in range(12)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(x[0] for x in brute_kept(rows))


def test_links_of_two_cells(monkeypatch):
    """The links connect what all similar pairs of a left and a right set connect, and are as few as that takes."""
    monkeypatch.setattr(similar, "COLUMNS", 7)
    r = np.random.default_rng(3)
    for k in range(60):
        base = r.choice(1 << 31, 20, replace=False).astype("<u4")
        sets = [np.unique(np.concatenate((r.permutation(base)[: r.integers(17, 21)], r.choice(1 << 31, r.integers(0, 4)).astype("<u4")))) for _ in range(14)] + [np.array([5 + k], "<u4")]
        root = r.integers(0, 9, 15)
        left = np.ones(15, dtype=bool) if k % 2 else np.arange(15) < 7
        right = left if k % 2 else ~left

        def joined(pairs, root=root):
            label = list(root)
            for i, j in pairs:
                label = [label[j] if x == label[i] else x for x in label]
            return len(set(label)), [[a == b for a in label] for b in label]

        pairs = [(i, j) for i in np.flatnonzero(left) for j in np.flatnonzero(right) if i != j and similar.jaccard(sets[i], sets[j]) >= 0.8]
        found = similar.found_links(root, left, right, sets, 0.8)
        assert set(found) <= set(pairs) and joined(found) == joined(pairs)
        assert len(found) == len(set(root)) - joined(pairs)[0]
    assert similar.found_links(root[-2:], left[-2:], left[-2:], [np.array([1], "<u4"), np.array([2], "<u4")], 0.8) == []
