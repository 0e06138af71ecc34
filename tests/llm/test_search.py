"""Hard negatives, ranked search and licences against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import hard_negatives, lexical_search, license_index

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# Hard negatives


def brute_negatives(rows, every=100, positives=5, negatives=10):
    """rows: (id, vector, label); the contract read literally."""
    usable = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda s, i: (-s, i is None, i or 0)
    out = []
    for n, (a, q, lab) in enumerate(usable):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, r)), i, other) for m, (i, r, other) in enumerate(usable) if m != n]
        near = sorted(((s, i) for s, i, o in scored if o == lab), key=lambda p: key(*p))[:positives]
        for s, p in near:
            hard = sorted(((t, i) for t, i, o in scored if o != lab and 30 * s <= 100 * t <= 90 * s), key=lambda x: key(*x))[:negatives]
            out += [(a, p, r, i, s, t) for r, (t, i) in enumerate(hard, 1)]
    return sorted(out, key=str)


def mined(vectors, **options):
    return sorted(map(tuple, hard_negatives.mine(vectors, F.col("vec_id") % options.pop("every", 100) == 0, **options).collect()), key=str)


def test_given_negatives(result, table):
    e = table("embeddings")
    rows = [(i, list(map(float, v)), (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in zip(e.vec_id, e.embedding, e.label)]
    found = result("op11_hard_negative_lists")
    assert sorted(map(tuple, found.itertuples(index=False)), key=str) == brute_negatives(rows)


def leaning(seed=2, n=420, dims=16):
    """Vectors of a few directions and lengths, with copies and integer ties."""
    draw = np.random.default_rng(seed)
    ways = draw.normal(size=(5, dims))
    x = ways[draw.integers(0, 5, n)] + 0.4 * draw.normal(size=(n, dims))
    x = np.round(x * draw.uniform(0.2, 3, (n, 1)), 1)
    x[300:360] = x[0]
    return [(i, x[i].tolist(), int(draw.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 20, "part_rows": 6, "clusters": 3}, {"positives": 2, "negatives": 3, "chunk_rows": 50}])
def test_lists_in_chunks_parts_and_rounds(spark, options, monkeypatch):
    monkeypatch.setattr(hard_negatives, "STEP", 16)
    rows = leaning()
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sizes = {k: v for k, v in options.items() if k in ("positives", "negatives")}
    assert mined(vectors, every=5, **options) == brute_negatives(rows, 5, **sizes)


def test_walks_end_early():
    """The certificate stops a walk: a member reads a small part of a list of many directions."""
    draw = np.random.default_rng(4)
    x = np.vstack([np.eye(8)[i % 8] * 256 + draw.normal(size=8) for i in range(4000)]).round()
    import pyarrow as pa

    table = pa.table({"q": [r.tobytes() for r in x.astype("<i4")], "id": np.arange(4000), "row": np.arange(4000), "label": np.zeros(4000, int)})
    member = x[:1].astype(float)
    shared = hard_negatives._List(member, table, np.eye(8)[0])
    read = []
    scores = shared.scores
    shared.scores = lambda m, part: read.append(part) or scores(m, part)
    number, score, at = shared.walk(member, np.array([-1]), np.array([0]), np.full((1, 1), -(1 << 40)), np.full((1, 1), 1 << 40), 5, True)
    assert len(read) == 1 and sorted(score)[::-1] == sorted((x @ x[0]).astype(int))[::-1][:5]


def test_odd_negatives(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.5, 0.2], 2), (2, [0.5, 0.2], 2), (3, [0.4], 2), (4, [], 2), (5, None, 1), (6, [nan, 1.0], 2),
        (7, [None, 1.0], 2), (8, [inf, 1.0], 2), (9, [0.6, 0.1], None), (None, [0.5, 0.2], 2), (100, [-1.0, -1.0], 1), (200, [0.0, 0.0], 3), (300, [0.0, 0.0], 3), (10, [1e300, 0.0], 2),
    ]
    extra = [(*r, 1, 2, "x", 3.0) for r in rows]
    vectors = spark.createDataFrame(extra, "vec_id long, embedding array<double>, label int, row int, id int, cluster string, score double")
    assert mined(vectors) == brute_negatives([r for r in rows if r[0] != 10])
    assert hard_negatives.mine(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(vectors, F.lit(False)).count() == 0
    big = [(0, [1e5, 3.0], 1), (1, [9e5, 1.0], 1), (2, [4e5, 7.0], 2), (3, [4e5, 7.0], 2)]
    assert mined(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")) == brute_negatives(big)


# Ranked search


def brute_ranks(docs, items, k=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (d, bag), n in zip(bags, sizes):
            score = 0
            for t in terms(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * (100 - 25 + 25 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def searched(docs, items, **options):
    return sorted(map(tuple, lexical_search.search(docs, items, **options).collect()), key=str)


def test_given_ranks(result, table):
    docs, items = table("documents"), table("benchmark")
    expected = brute_ranks(zip(docs.doc_id, docs.text), list(zip(items.item_id, items.text)))
    assert sorted(map(tuple, result("op12_dual_tree_search").itertuples(index=False)), key=str) == expected


def test_blocks_of_items_and_small_leaves(spark, table, monkeypatch):
    monkeypatch.setattr(lexical_search, "DOC_LEAF", 3)
    monkeypatch.setattr(lexical_search, "PILOT", 3)
    docs = table("documents")[:90]
    items = [(i, t) for i, t in enumerate(docs.text[20:40].str[:300])]
    rows = list(zip(docs.doc_id, docs.text))
    found = searched(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4, block_items=6)
    assert found == brute_ranks(rows, items, 4)


def test_node_pairs_are_pruned(table):
    """Bounds are above all scores, and most leaf pairs are never scored."""
    draw = np.random.default_rng(0)
    topics = 16
    item = np.repeat(np.arange(64), 6)
    term = np.concatenate([(i % topics) * 20 + draw.choice(20, 6, replace=False) for i in range(64)])
    items = lexical_search.Items(64, topics * 20, item, term, np.full(len(item), 1000))
    doc = np.repeat(np.arange(4096), 8)
    words = np.concatenate([(d % topics) * 20 + draw.choice(20, 8, replace=False) for d in range(4096)])
    tree, best = items.built(), lexical_search._Best(np.ones(64, np.int64), 5)
    scored = []
    add = best.add
    best.add = lambda i, s, ids: scored.append(len(s)) or add(i, s, ids)
    lexical_search.walk(tree, best, np.arange(4096), doc, words, draw.integers(1, 900, len(doc)))
    assert sum(scored) < 64 * 4096 / 20 and all(len(r) == 5 for r in best.rows)


def test_odd_search(spark):
    long = "rare " + "many different words here and there " * 60_000
    docs = [(1, "Alpha beta"), (1, "Alpha beta"), (2, None), (3, ""), (None, "ALPHA gamma"), (4, long), (5, "Ünder é-É x"), (6, "alpha beta"), (7, "... \n"), (8, "0 alpha'beta_gamma")]
    items = [(1, "alpha Alpha"), (1, "alpha Alpha"), (2, None), (3, "nothing known"), (4, "rare é words"), (None, "beta"), (5, "")]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, id int, terms string, n int")
    asked = spark.createDataFrame([(*i, "x", 3) for i in items], "item_id long, text string, terms string, row int")
    assert searched(frame, asked, k=3) == brute_ranks(docs, items, 3)
    assert lexical_search.search(frame.limit(0), asked).count() == 0 and lexical_search.search(frame, asked.limit(0)).count() == 0


# Licences


def brute_licenses(docs, templates, phrases, share, band):
    texts = [(d, terms(t)) for d, t in docs]
    df = Counter(w for _, ws in texts for w in set(ws))
    idf = lambda w: math.log((2 * len(texts) + 2) / (2 * df[w] + 1)) + 1
    out = []
    for doc, words in texts:
        at = lambda p: [i for i in range(len(words)) if words[i : i + len(p)] == list(p)]
        base = [(p, lab) for phrase, lab in phrases for p in at(phrase.split())]
        labels, score = {lab for _, lab in base}, 0.0
        for t in templates:
            total = sum(map(idf, t.words))
            for low in range(-((len(t.words) // band) + 2) * band, len(words) + band, band):
                held = sum(idf(w) for q, w in enumerate(t.words) if w in words[max(low + q, 0) : max(low + q + 2 * band, 0)])
                reach = range(max(low, 0), low + 2 * band + len(t.words))
                if held / total >= share and all(any(words[i : i + len(p)] == list(p) for i in reach) for p in t.phrases):
                    labels.add(t.label)
                    score = max(score, min(held / total, 1.0))
        places = [p for p, _ in base]
        told = ",".join(sorted({lab for _, lab in base})), ",".join(sorted(labels))
        out.append((doc, len(words), len(base), min(places, default=None), max(places, default=None), *told, round(1.0 if base else score, 9)))
    return sorted(out, key=str)


def scanned(docs, **options):
    rows = license_index.scan_licenses(docs, **options).collect()
    return sorted(((*r[:7], round(r[7], 9)) for r in rows), key=str)


LICENSED = [
    (1, "Licensed under the Apache License, Version 2.0."), (2, "x " * 50 + "Released under the MIT License."), (3, "CC BY 4.0 and mit license, MIT-License"),
    (4, "Permission is hereby granted, without any limits and free of charge, to any person obtaining a copy of this software and its associated documentation files"),
    (5, "Permission is granted to any person, free of charge, obtaining a copy"), (6, "under the terms of the license as published by the foundation"),
    (7, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"), (8, None), (9, ""), (9, ""), (None, "gnu general public license"),
    (10, "general public license gnu " * 40), (11, "Copyright (c) 2020 Somebody. All rights reserved."), (12, "This source code form is subject to terms of the Mozilla Public License v. 2.0"),
    (13, "source " * 300 + "forms"), (14, "license " * 100 + "the terms of the GNU Lesser General Public License as published by the Free Software Foundation"), (15, "nothing to see here"),
]


def test_license_places(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in LICENSED], "doc_id long, text string, n_words string, word int")
    expected = brute_licenses(LICENSED, license_index.TEMPLATES, license_index.PHRASES, license_index.SHARE, license_index.BAND)
    assert scanned(docs) == expected
    labels = {r[0]: r[6] for r in expected}
    assert [labels[d] for d in (1, 2, 3, 4, 11, 14, 15)] == ["apache", "mit", "cc-by,mit", "mit", "reserved", "lgpl", ""]
    assert scanned(docs, share=0.4, band=3) == brute_licenses(LICENSED, license_index.TEMPLATES, license_index.PHRASES, 0.4, 3)
    assert license_index.scan_licenses(docs.limit(0)).count() == 0


def test_given_licenses(result, table):
    docs = table("documents")
    found = {r[0]: r for r in result("op13_license_positions").itertuples(index=False)}
    assert len(found) == len(docs)
    for d, t in zip(docs.doc_id, docs.text):
        words = terms(t)
        places = [(i, lab) for p, lab in license_index.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = found[d]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({lab for _, lab in places})))
        assert (r.first_word, r.last_word) == (min(p for p, _ in places), max(p for p, _ in places)) if places else math.isnan(r.first_word)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_long_license_text(spark):
    text = "some words in between " * 200_000 + "released under the mit license " + "gnu public license general " * 50_000
    row = scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0]
    assert row[1:7] == (800_000 + 5 + 200_000, 1, 800_003, 800_003, "mit", "mit")


