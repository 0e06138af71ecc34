"""The document queries against plain Python over the same table."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from flowsieve.llm import minmax_dedup, mixing, packing, quality_rules, token_counts, token_memo
from flowsieve.llm.queries import vocabulary


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def end(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = end(a), end(b)
        parent[max(a, b)] = min(a, b)
    return {n: end(n) for n in nodes}


def test_near_duplicates(result, table):
    docs = table("documents")
    sets = {}
    for doc, text in zip(docs.doc_id, docs.text):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets[doc] = {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert links
    expected = smallest_reachable(sets, links)
    for r in result("op9_minmax_near_duplicates").itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


# The base patterns as the contract states them.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def told(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def test_secrets(result, table):
    texts = dict(zip(table("documents").doc_id, table("documents").text))
    for r in result("op2_secret_models").itertuples():
        base = base_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        kept = [s for s in r.spans.split(",") if s and not s.startswith("markov")]
        assert ",".join(kept) == told(base)


def test_mixing(result, table):
    docs = table("documents")
    sizes = {d: len(words(t)) for d, t in zip(docs.doc_id, docs.text)}
    of = docs.assign(size=docs.doc_id.map(sizes)).groupby("source")["size"].sum().to_dict()
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(of))}
    target, free, left = {}, set(of), 1.5 * sum(of.values())
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * of[s]}
        if not over:
            break
        target |= {s: 2.0 * of[s] for s in over}
        left -= sum(2.0 * of[s] for s in over)
        free -= over
    target |= {s: level * weights[s] for s in free}
    source = dict(zip(docs.doc_id, docs.source))
    mixed = result("op4_mixing_pareto")
    for r in mixed.itertuples():
        assert r.size == sizes[r.doc_id] and r.source_size == of[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
    taken = mixed.assign(source=mixed.doc_id.map(source)).groupby("source").taken.sum()
    largest = mixed.assign(source=mixed.doc_id.map(source)).groupby("source")["size"].max()
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2


def test_mixing_follows_inclusion_chances(spark):
    rows = [(i, "a" if i % 3 else "b", "w " * (1 + i % 40)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    once, again = (mixing.mix(docs, weights=(1,), share=0.9).toPandas().sort_values("doc_id") for _ in range(2))
    assert (once.copies.to_numpy() == again.copies.to_numpy()).all()
    share = once.groupby(once["size"] > 20).copies.mean()
    assert share[True] > share[False]  # longer documents are likelier
    mixed = mixing.mixed_documents(docs, weights=(1,), share=0.9)
    assert mixed.columns == docs.columns and mixed.count() == once.copies.sum()


def test_rule_counts(result, table):
    texts = dict(zip(table("documents").doc_id, table("documents").text))
    for r in result("op5_quality_isolation").itertuples():
        w = words(texts[r.doc_id])
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
        lines = [x for x in texts[r.doc_id].split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(texts[r.doc_id].count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_forest_against_single_rows():
    rows = np.random.default_rng(0).normal(size=(500, 3))
    forest = quality_rules.grow(rows, 20, 128, 1)
    odd = np.vstack([rows[:40], [[9.0, -9.0, 9.0]]])

    def path(root, x):
        node, steps = root, 0
        while forest.feature[node] >= 0:
            node = forest.left[node] + (x[forest.feature[node]] >= forest.cut[node])
            steps += 1
        return forest.length[node], steps

    scores = forest.score(odd)
    for x, s in zip(odd, scores):
        paths = [path(r, x) for r in forest.roots]
        assert all(length >= steps for length, steps in paths)
        assert s == pytest.approx(2 ** (-np.mean([p for p, _ in paths]) / quality_rules._usual(128)))
    assert scores.argmax() == 40


def test_threshold_weighs_good_against_bad():
    scores, good = np.array([0.9, 0.8, 0.7, 0.6, 0.5]), np.array([False, False, True, False, True])
    assert 0.7 < quality_rules._threshold(scores, good) < 0.8
    assert quality_rules._threshold(scores, np.ones(5, bool)) == 1.0


def test_quality_keeps_good_documents(result, table):
    judged = result("op5_quality_isolation").merge(table("labels"), on="doc_id")
    passed = judged[~judged.base_failed]
    assert passed[passed.quality == 1].kept.mean() >= 0.97


def test_rule_ensemble_on_the_held_out_fold(spark, table):
    from flowsieve.llm.queries import quality_rule_ensemble

    folder = "/root/testdata/sf0.01"
    scored = quality_rule_ensemble(spark, folder).toPandas()
    assert (scored.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in scored.doc_id]).all()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.7)).all()
    known = scored.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = known[known.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_token_counts(result, table):
    from tokenizers import Tokenizer

    docs = table("documents")
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    counts = result("op7_token_lengths").set_index("doc_id")
    for doc, text in zip(docs.doc_id, docs.text):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert tuple(counts.loc[doc]) == (len(text.encode()), n, n > 1024)


ODD_TEXTS = [
    "", " ", "  a  b ", "a\n b", "a \nb", "tab\there  and there", "x<|endoftext|>y <|endoftext|> z", "<|startoftext|> A",
    "it's IT'S we'll 12 3.5", "ÀÉ ́x İ ẞ K", "a　b   c", "!!! ...wow***  $$$", "\x1ca \x1d b", "word " * 3000, "<|ENDOFTEXT|> <|EndOfText|>",
    "".join(chr(c) for c in range(1, 700)), "日本語 テキスト", "'s 't ' s", "a'", "ends with space ", "\n\n", "emoji 👩‍👩‍👧 x",
    "he said 'hello'.", "'hello',", "dogs'.", "“yes”,", "wow—!", "done….", "5€.", "50°,", "«oui».",
    "x<|EndOfText|>y", "<|endoftext|> a<|STARTOFTEXT|>.", "H\u0331. T\u0308, J\u030c! W\u030a Y\u030a h\u0331. İ. e\u0301. \u0958. \u037e. \u1fef. K\u00a0. ΣΑΣ. 日本. ½. １. a\u200d.",
]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_odd_texts_as_the_library_has_them(text):
    byte, word = (vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    tokenizer = token_counts.load(byte)
    whole = len(tokenizer.encode(text, add_special_tokens=False).ids)
    for length in (1, 3, 40, token_counts.PART_CHARS):
        parts = list(token_counts.safe_parts(text, length))
        assert "".join(parts) == text
        assert sum(len(tokenizer.encode(p, add_special_tokens=False).ids) for p in parts) == whole
    n_bytes, n_tokens = token_counts.lengths(["", text, "a b", text], tokenizer)
    assert n_tokens.tolist() == [0, whole, 2, whole] and n_bytes.tolist() == [0, len(text.encode()), 3, len(text.encode())]
    assert packing.word_ids(text, word) == packing._id_bytes(packing.load(word).encode(text, add_special_tokens=False).ids)


def test_batches_are_balanced_by_bytes_and_only_long_texts_split():
    sent = []

    class Library:
        def encode_batch_fast(self, batch, add_special_tokens):
            sent.append(batch)
            return [[0] * len(p) for p in batch]

    some = ["short text", "many words " * 100_000, "x" * 300_000] + ["a few words here"] * 40_000
    n_bytes, n_tokens = token_counts.lengths(some, Library())
    assert n_tokens.tolist() == n_bytes.tolist() == [len(t) for t in some]
    sizes = [sum(map(len, b)) for b in sent]
    assert all(size <= token_memo.BATCH_BYTES or len(b) == 1 for size, b in zip(sizes, sent))
    assert sum(size > token_memo.BATCH_BYTES / 2 for size in sizes) >= len(sizes) - 3
    assert "short text" in sent[0] and max(len(p) for b in sent for p in b if "x" not in p) < token_counts.PART_CHARS + 20


def spaceless(number, length=4000):
    return "".join(chr(0x4E00 + x) for x in np.random.default_rng(number).integers(0, 20_000, length))


def test_memos_stay_within_their_bytes_on_texts_without_spaces():
    word = vocabulary("word_bpe_49k.json")
    packing._words.cache_clear()
    memo = packing._words(word)
    texts = [spaceless(i) for i in range(300)] + [" ".join(spaceless(1000 + i, 6) for i in range(3000))]
    tokens = [len(packing.word_ids(t, word)) for t in texts]
    assert min(tokens) >= 4 * 3000
    assert len(memo) == 3000 and not memo.passing and memo.held < 3000 * 400
    minmax_dedup._hashes.clear()
    for text in texts:
        minmax_dedup.shingle_set(text, 3)
    assert len(minmax_dedup._hashes) == 3000
    small = token_memo.Memo(lambda some: [w * 2 for w in some], room=2000)
    for at in range(200):
        words = [b"w%d" % (at + i) for i in range(5)] + [b"long" * 20]
        small.learn(words)
        assert [small[w] for w in words] == [w * 2 for w in words]
        small.trim()
        assert small.held <= 2000 and len(small) * 170 <= 2000 + 170


def test_equal_pieces_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 500)
    pieces = spark.range(6000).selectExpr("cast(null as bigint) AS doc_id", "0 AS piece", "0L AS start", "1L AS length", "7L AS ids_crc32")
    packed = packing.pack(pieces, size=64).toPandas()
    groups = packed.groupby(packed.sequence_id // 2**32).size()
    assert len(packed) == 6000 and len(groups) == 12 and groups.max() < 650
    assert packed.groupby("sequence_id").length.sum().max() <= 64


def test_packing(result, table):
    from tokenizers import Tokenizer

    docs = table("documents")
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = set()
    for doc, text in zip(docs.doc_id, docs.text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 4096):
            piece = ids[at : at + 4096]
            expected.add((doc, at // 4096, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    packed = result("op6_packing_best_fit")
    assert set(packed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == expected and len(packed) == len(expected)
    ordered = packed.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 4096
    assert packed.sequence_id.nunique() <= 1.02 * -(-packed.length.sum() // 4096) + 1


def test_packing_keeps_every_capacity_and_gives_sequences(spark, table):
    docs = spark.createDataFrame(table("documents")[["doc_id", "text"]].head(60))
    pieces = packing.token_pieces(docs, vocabulary("word_bpe_49k.json"), size=512)
    packed = packing.pack(pieces, size=512, max_docs=3, max_cost=512.0 * 512)
    frame = packed.toPandas()
    by = frame.groupby("sequence_id")
    assert by.length.sum().max() <= 512 and by.size().max() <= 3
    sequences = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for number, rows in by:
        assert sequences[number] == b"".join(bytes(i) for i in rows.sort_values("offset").ids)
