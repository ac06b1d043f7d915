"""Small tests of the corpus operators: edge cases and brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varloom.llm import attribution, bagminhash, components, decontam, descriptors, langid, linedist, linededup, mixing, suffixtree, weaklabel
from varloom.llm.common import chunks, lower_ascii, window_hashes, word_bounds, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int"

LONG = " ".join(f"word{i % 977}x" for i in range(30_000))
EN = "the cat sat on the mat and then the dog came in through the open door to see what it was about"
FR = "le chat est assis sur le tapis et puis le chien est venu par la porte ouverte pour voir ce que c'était"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (0, EN + "\nA line that is shared.", "en", "a", 1, 7),
        (1, FR + "\nA line that is shared.  ", "fr", "b", 2, 7),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, 1),
        (4, LONG, "en", "b", 9, 1),
        (4, LONG, "en", "b", 9, 1),
        (None, "no id here\na LINE that is shared.", "en", None, 3, 2),
        (6, "%%% ### !!!", "fr", "c", 4, 2),
        (7, EN + " with an ending\n\n", "en", "a", 1, 7),
        (8, "one two", "en", "a", 1, 7),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(docs):
    return docs.limit(0)


def test_word_kernel():
    texts = ["", "Ab ab  AB\tcd", None, " x ", "é É", "q" * 3_000_000]
    seen = []
    for first, data, at in chunks(pa.array(texts, pa.string()), 16):
        s, e, row_at = word_bounds(data, at)
        h = word_hashes(data, s, e)
        for r in range(len(at) - 1):
            seen.append((first + r, [bytes(data[a:b]).decode() for a, b in zip(s[row_at[r] : row_at[r + 1]], e[row_at[r] : row_at[r + 1]])], list(h[row_at[r] : row_at[r + 1]])))
    assert [w for _, w, _ in seen] == [WORD.findall(t or "") for t in texts]
    assert len(set(seen[1][2])) == 2 and seen[4][2][0] != seen[4][2][1]


def test_windows():
    w = np.arange(1, 8, dtype=np.uint64)
    h, at = window_hashes(w, np.array([0, 5, 5, 7]), 3, whole_short=True)
    assert list(np.diff(at)) == [3, 0, 1] and len(set(h.tolist())) == 4
    again, _ = window_hashes(w[1:4], np.array([0, 3]), 3)
    assert again[0] == h[1]


# op1


def test_suffix_tree_base(spark, docs):
    out = suffixtree.score_texts(docs, F.col("doc_id") != 0, max_words=50).collect()
    rows = docs.collect()
    tokens = [WORD.findall((r.text or "").translate(FOLD)) + [None] for r in rows]
    count = collections.Counter(t for r, ts in zip(rows, tokens) if r.doc_id not in (0, None) for t in ts)
    n, v = sum(count.values()), len(count)
    want = sorted((str(r.doc_id), len(ts), sum(count[t] > 0 for t in ts), round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 4)) for r, ts in zip(rows, tokens))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == want
    assert {r.train_tokens for r in out} == {n}
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    again = suffixtree.score_texts(docs, F.col("doc_id") != 0).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in again) == want
    assert suffixtree.score_texts(empty(docs), F.lit(True)).collect() == []
    assert all(r.score == r.base_score == 0 for r in suffixtree.score_texts(docs, F.lit(False)).collect())


def brute_tree(train, words, discount=0.75, min_gain=10.0, min_symbol_gain=3.0):
    """(root, states): a suffix tree of lists of tokens in plain Python; ``words``: the alphabet, others are "rare"."""
    count = collections.Counter(t for ts in train for t in ts)
    base = sum(count.values()) + 0.5 * (len(count) + 1)
    root = {w: (count[w] + 0.5) / base for w in words}
    root["rare"] = 1 - sum(root.values())
    seen = {1: collections.defaultdict(collections.Counter), 2: collections.defaultdict(collections.Counter)}
    for ts in train:
        padded = ["start", "start"] + [t if t in words else "rare" for t in ts]
        for i in range(2, len(padded)):
            seen[1][padded[i - 1],][padded[i]] += 1
            seen[2][padded[i - 2], padded[i - 1]][padded[i]] += 1
    states = {(): (0.0, root)}
    for level in (1, 2):
        for ctx, c in seen[level].items():
            n, up = sum(c.values()), ctx[1:] if ctx[1:] in states else ()
            shared, parent = states[up][0] if up else 1.0, states[up][1]
            of = lambda s: parent[s] if s in parent else shared * root[s]  # noqa: B023, E731
            left_out = {s: (k - 1 - discount) / max(n - 1, 1) / of(s) for s, k in c.items() if k >= 2}
            kept = {s: c[s] for s, x in left_out.items() if c[s] * math.log(x) >= min_symbol_gain}
            if not kept:
                continue
            share = 1 - sum(k - discount for k in kept.values()) / n
            gain = sum(k * math.log(left_out[s] + share) for s, k in kept.items()) + (n - sum(kept.values())) * math.log(share)
            if gain >= min_gain:
                states[ctx] = share, {s: (k - discount) / n + share * of(s) for s, k in kept.items()}
    return root, states, count, base


def brute_score(ts, words, tree):
    root, states, count, base = tree
    padded, total = ["start", "start"] + [t if t in words else "rare" for t in ts], 0.0
    for i, t in enumerate(ts, 2):
        p = 1.0
        for ctx in ((padded[i - 2], padded[i - 1]), (padded[i - 1],), ()):
            if ctx in states:
                if padded[i] in states[ctx][1]:
                    p *= states[ctx][1][padded[i]]
                    break
                p *= states[ctx][0]
        total += math.log10(p)
        if padded[i] == "rare":
            total += math.log10((count[t] + 0.5) / base / root["rare"])
    return total


def test_suffix_tree_by_brute_force(spark, monkeypatch):
    """Bigram text with copied passages: all states broadcast, none of them, a filter that is full, small shards, and a small alphabet."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [str(x) for x in rng.choice(vocabulary, 40)]
    rows = []
    for i in range(80):
        words, last = [], 0
        for _ in range(int(rng.integers(0, 80))):
            last = (last * 7 + 3) % 60 if rng.random() < 0.6 else int(rng.integers(0, 60))
            words += [vocabulary[last]] + ["the"] * (i % 2)
        if i % 4 == 0:
            words[5:5] = passage
        if i % 20 == 3:
            words += " the ".join(passage[::-1]).split()
        words += [f"once{i}"] * (i % 3 == 0) + ["seldom"] * (i % 20 == 0)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = {i: t.split() + [None] for i, t in rows}
    train = [ts for i, ts in tokens.items() if i % 5 != 1]
    every = {t for ts in train for t in ts}

    def check(words, **options):
        tree = brute_tree(train, words, min_gain=20.0)
        got = {r.doc_id: r.score for r in suffixtree.score_texts(df, F.col("doc_id") % 5 != 1, min_gain=20.0, **options).collect()}
        assert got == pytest.approx({i: brute_score(ts, words, tree) for i, ts in tokens.items()}, rel=1e-5)
        return tree

    tree = check(every)
    assert {len(s) for s in tree[1]} == {0, 1, 2} and any(len(s) == 2 and s[1:] in tree[1] for s in tree[1]) and any(len(s) == 2 and s[1:] not in tree[1] for s in tree[1])
    # In every state, and at the root, the alphabet's probabilities sum to one.
    for share, p in tree[1].values():
        assert 0 <= share < 1
    for ctx, (share, p) in tree[1].items():
        up = tree[1][ctx[1:] if ctx[1:] in tree[1] else ()] if ctx else None
        if up and not up[0]:
            assert sum(p.values()) + share * (1 - sum(up[1][s] for s in p)) == pytest.approx(1)
    monkeypatch.setattr(suffixtree, "SHARD_TOKENS", 300)
    check(every, max_hot_symbols=0)
    check(every, max_hot_symbols=100)
    monkeypatch.setattr(suffixtree, "LEAST_BITS", 8)
    monkeypatch.setattr(suffixtree, "MAX_BITS", 8)
    check(every, max_hot_symbols=0)
    vocab = collections.Counter(t for ts in train for t in ts)
    least = min(x for x in range(99) if sum(c > x for c in vocab.values()) <= 40)
    counted = spark.createDataFrame([(i, c) for i, c in enumerate(vocab.values())], "code long, c long")
    least = suffixtree.hot_words(counted, len(vocab), 40)[2]
    check({t for t, c in vocab.items() if c > least}, max_words=40)
    check({t for t, c in vocab.items() if c > least}, max_words=40, max_hot_symbols=30)


def test_suffix_tree_beats_its_root_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    held = suffixtree.score_texts(docs, train).filter("not train").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print("log10 a token:", held[0] / held[2], "root:", held[1] / held[2])
    assert held[0] > held[1] + 0.1 * held[2]


def test_packed_codes():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 2**63 - 1, 1000))
    n = rng.integers(1, 2**32 - 1, len(codes))
    back = suffixtree.unpack(suffixtree.pack(codes, n), len(codes))
    assert (back[0] == codes).all() and (back[1] == n).all()


# op2


def test_weak_labels(spark, docs):
    out = {r.doc_id: r for r in weaklabel.classify_quality(docs).collect()}
    assert len(out) == 9 and out[2].quality == 0 and not out[2].keep and not out[3].keep
    assert weaklabel.classify_quality(empty(docs)).collect() == []
    good = [(i, f"{EN} number{i} and so on until the end of it{i}.") for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}%%%" for w in EN.split()) + f" x{i}$$$") for i in range(20)]
    made = weaklabel.classify_quality(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()
    assert all(r.keep == (r.doc_id < 100) for r in made)


def test_expectation_maximisation():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.2
    acc = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(rng.random((len(truth), 4)) < acc, np.where(truth, -1, 1)[:, None], np.where(truth, 1, -1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    bad, emit, share = weaklabel.expectation_maximisation(patterns, counts.astype(float))
    assert share == pytest.approx(0.2, abs=0.05)
    assert emit[1, :, 0] == pytest.approx(acc, abs=0.07)


def test_sample_of_different_texts_is_bounded(spark):
    hot = spark.range(20_000).selectExpr("id as doc_id", "'one hot text' as text")
    other = spark.range(3000).selectExpr("20000 + id as doc_id", "concat('text ', id) as text")
    sample = weaklabel.distinct_sample(hot.union(other).select("text"), 400)
    got = [r.text for r in sample.collect()]
    assert len(got) == len(set(got)) == 400
    langs = hot.union(other).selectExpr("text", "if(doc_id % 100 = 7, 'rare', 'common') as lang").union(spark.sql("select 'just one text' as text, 'single' as lang"))
    few = langid.sampled(langs, 200, 0.2).collect()
    n = collections.Counter(r.lang for r in few)
    assert n["common"] == 200 and n["single"] == 1 and 0 < n["rare"] <= 200
    assert len({(r.lang, r.text) for r in few}) == len(few) and not any(r.back for r in few if r.lang == "single")
    assert sum(r.back for r in few if r.lang == "common") == 40


def test_quality_against_labels(spark):
    """Of all labelled documents, ranked by quality: the area under the curve."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    made = weaklabel.classify_quality(docs).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").select("quality", "label").toPandas()
    good, bad = made[made.label == 1].quality.to_numpy(), made[made.label == 0].quality.to_numpy()
    assert len(bad) > 10 and (good[:, None] > bad[None]).mean() > 0.99


# op3


@pytest.mark.parametrize("rule", attribution.RULES)
def test_token_counts(spark, docs, rule):
    out = attribution.attribute_tokens(docs, rule=rule).collect()
    assert len(out) == docs.count()
    for r in out:
        assert sum(r.section_tokens) + r.n_outside == r.n_tokens and len(r.section_tokens) == r.n_sections
    assert attribution.attribute_tokens(empty(docs)).collect() == []


def test_token_spans_against_brute_force(spark):
    text = "Ünïcode wörds and 12345 spaces   here"
    spans = [(0, 3), (3, 9), (12, 14), (14, 99)]
    df = spark.createDataFrame([(1, text, spans), (2, text, None)], "doc_id long, text string, spans array<struct<start:int,end:int>>")
    import public_tokenizers
    import tiktoken

    with open(attribution.DEFAULT_VOCABULARY, "rb") as f:
        enc, _ = attribution.encoder((attribution.DEFAULT_VOCABULARY, f.read(), public_tokenizers.PATTERN))
    assert isinstance(enc, tiktoken.Encoding)
    raw = text.encode()
    owner = []
    for at in range(len(raw)):
        ch = len(raw[:at].decode(errors="ignore")) if (raw[at] & 0xC0) != 0x80 else owner[-1][1]
        owner.append((next((k for k, (a, b) in enumerate(spans) if a <= ch < b), None), ch))
    want, at = collections.Counter(), 0
    for t in enc.encode_ordinary(text):
        n = len(enc.decode_single_token_bytes(t))
        runs = [(k, len(list(g))) for k, g in itertools.groupby(o for o, _ in owner[at : at + n])]
        want[max(runs, key=lambda x: x[1])[0]] += 1
        at += n
    got = {r.doc_id: r for r in attribution.attribute_tokens(df, spans_col="spans").collect()}
    assert list(got[1].section_tokens) == [want[k] for k in range(4)] and got[1].n_outside == want[None]
    assert got[2].n_outside == got[2].n_tokens


def test_long_runs_of_white_space(spark):
    import public_tokenizers

    with open(attribution.DEFAULT_VOCABULARY, "rb") as f:
        enc, _ = attribution.encoder((attribution.DEFAULT_VOCABULARY, f.read(), public_tokenizers.PATTERN))
    for run in (" " * 300, "\n" * 300, " \t" * 200, "\u00a0\u3000 " * 150, "\x1c" * 300, " " * 256, " " * 255):
        for text in (run, "ab" + run, run + "ab", "a" + run + "b 1" + run + "!" + run, "x'" + run + "s  y", run + "\x1f" + run):
            assert attribution.encode_whole(enc, text, True) == enc.encode_ordinary(text)
    rows = [(i, "a" + c * 1_000_000 + "b") for i, c in enumerate(" \n\t!q")]
    for r in attribution.attribute_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert sum(r.section_tokens) == r.n_tokens > 0 and r.n_outside == 0


# op4


def bag(text):
    w = WORD.findall((text or "").translate(FOLD))
    return collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    a = rng.choice(words, 300).tolist()
    b = a[:200] + rng.choice(words, 60).tolist()
    col = pa.array([" ".join(a), " ".join(b)])
    (_, data, at), = chunks(col)
    row, sh, count, size = bagminhash.bags(data, at, 1)
    sig = bagminhash.signatures(row, sh, count, size, 4096)
    x, y = collections.Counter(a), collections.Counter(b)
    assert (sig[0] == sig[1]).mean() == pytest.approx(jaccard(x, y), abs=0.03)


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for group in range(12):
        base = [f"g{group}w{int(x)}" for x in rng.integers(0, 400, 120)]
        for _ in range(int(rng.integers(1, 12))):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[k] = f"edit{int(rng.integers(0, 10**6))}"
            rows.append((at, " ".join(w)))
            at += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bags = {i: bag(t) for i, t in rows}
    own = {i: i for i in bags}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for a, b in itertools.combinations(bags, 2):
        if jaccard(bags[a], bags[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            own[y] = x
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(df).collect()}
    assert got == {i: root(i) for i in bags}
    edge = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()}
    assert edge[2] == 2 and edge[3] == 3 and edge[None] is None and len(edge) == 9
    kept = bagminhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, c in edge.items() if i == c)
    assert bagminhash.near_duplicates(empty(docs)).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (21, 21), (22, 21), *[(100 + i, 101 + i) for i in range(30)]]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 7, 8, 9)} == {1} and {got[i] for i in (20, 21, 22)} == {20}
    assert {got[100 + i] for i in range(31)} == {100}


def classes_of(nodes, linked):
    own = {i: i for i in nodes}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            own[y] = x
    return {i: root(i) for i in nodes}


def test_large_bucket_links_away_from_its_centre(spark):
    n = 150
    buckets = spark.createDataFrame([(7, i, 10) for i in range(n)] + [(8, 0, 10), (8, 1, 10)], "key long, rep long, n long")
    # Pairs beside each other from 20 on; the centre, 0, links with the first 20.
    linked = lambda a, b: b < 20 and a == 0 or a >= 20 and b == a + 1
    near = F.col("a").eqNullSafe(0) & (F.col("b") < 20) | (F.col("a") >= 20) & (F.col("b") == F.col("a") + 1)
    _, found = components.link_buckets(buckets, lambda pairs: pairs.select("a", "b", near.alias("linked")))
    got = {r.node: r.component for r in found.collect()}
    assert got == classes_of(range(n), linked)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """A template with versions of it: many miss the threshold with the template and reach it with each other."""
    rng = np.random.default_rng(5)
    base, rows = [f"t{i}" for i in range(90)], []
    for version in range(12):
        own = list(base)
        for k in rng.choice(90, 4 if version % 2 else 2, replace=False):
            own[k] = f"v{version}"
        for _ in range(6):
            w = list(own)
            for k in rng.choice(90, int(rng.integers(0, 3)), replace=False):
                w[k] = f"e{int(rng.integers(0, 10**6))}"
            rows.append((len(rows), " ".join(w)))
    bags = {i: bag(t) for i, t in rows}
    monkeypatch.setattr(components, "SMALL_BUCKET", 4)
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_of(bags, lambda a, b: jaccard(bags[a], bags[b]) >= 0.8)


@pytest.mark.parametrize("seed", range(3))
def test_near_pairs_lose_no_link(spark, seed):
    """Members around a hub with own and shared edits, cuts and additions, against all pairs."""
    rng = np.random.default_rng(seed)
    base = [f"t{int(x)}" for x in rng.integers(0, 70, 80)]
    rows = [(0, " ".join(base))]
    own = [list(base) for _ in range(6)]
    for v, w in enumerate(own):
        for k in rng.choice(80, int(rng.integers(1, 6)), replace=False):
            w[k] = f"v{v}"
        if v % 2:
            del w[int(rng.integers(0, 40)) :][: int(rng.integers(1, 12))]
            w += [f"more{v}"] * int(rng.integers(0, 9))
    for i in range(1, 70):
        w = list(own[int(rng.integers(0, 6))] if rng.random() < 0.7 else base)
        for k in rng.choice(len(w), int(rng.integers(0, 5)), replace=False):
            w[k] = f"e{int(rng.integers(0, 10**6))}"
        rows.append((i, " ".join(w[int(rng.integers(0, 12)) :])))
    bags = {i: bag(t) for i, t in rows}
    texts = spark.createDataFrame(rows, "id long, text string")
    groups = spark.createDataFrame([(0, i) for i in bags if i], "hub long, rep long")
    got = {(r.a, r.b) for r in bagminhash.near_pairs(groups, texts, 5, 0.8).collect()}
    # Linked pairs are found, or their members are connected by linked pairs that are.
    members = {i: bag for i, bag in bags.items() if i}
    want = classes_of(members, lambda a, b: jaccard(bags[a], bags[b]) >= 0.8)
    assert classes_of(members, lambda a, b: (min(a, b), max(a, b)) in got and jaccard(bags[a], bags[b]) >= 0.8) == want
    assert len(got) < 69 * 68 // 2 and len(set(want.values())) > 1


def test_families_of_a_group_do_not_meet_in_all_pairs(spark):
    """Three families that share a third of their text: each is a group of its own in its round."""
    rng = np.random.default_rng(4)
    shared = [f"s{i}" for i in range(60)]
    families = [shared + [f"f{f}x{i}" for i in range(120)] for f in range(3)]
    rows = []
    for i in range(240):
        w = list(families[min(2, i // 90)])
        for k in rng.choice(180, 1, replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    groups = spark.createDataFrame([(0, i) for i, _ in rows], "hub long, rep long")
    got = {(r.a, r.b) for r in bagminhash.near_pairs(groups, spark.createDataFrame(rows, "id long, text string"), 5, 0.8).collect()}
    bags = {i: bag(t) for i, t in rows}
    want = classes_of(bags, lambda a, b: jaccard(bags[a], bags[b]) >= 0.8)
    assert classes_of(bags, lambda a, b: (min(a, b), max(a, b)) in got and jaccard(bags[a], bags[b]) >= 0.8) == want
    # Families in all pairs would make 9,780.
    assert len(set(want.values())) == 3 and len(got) < 9_780 // 4


def test_edits_of_one_member_make_few_pairs(spark):
    """Three hundred copies with edits of their own: hardly any pair is left to compare."""
    rng = np.random.default_rng(2)
    base = [f"t{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        w = list(base)
        for k in rng.choice(200, 8, replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    groups = spark.createDataFrame([(0, i) for i in range(1, 300)], "hub long, rep long")
    got = bagminhash.near_pairs(groups, spark.createDataFrame(rows, "id long, text string"), 5, 0.8).count()
    print("pairs", got)
    assert got < 299 * 298 // 2 // 10


def test_members_with_many_edits_meet_in_few_pairs(spark):
    """Copies with edits of their own, some too many for the middle: what they lack alike brings hardly any two together."""
    rng = np.random.default_rng(6)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    groups = spark.createDataFrame([(0, i) for i, _ in rows], "hub long, rep long")
    got = {(r.a, r.b) for r in bagminhash.near_pairs(groups, spark.createDataFrame(rows, "id long, text string"), 5, 0.8).collect()}
    bags = {i: bag(t) for i, t in rows}
    want = classes_of(bags, lambda a, b: jaccard(bags[a], bags[b]) >= 0.8)
    assert classes_of(bags, lambda a, b: (min(a, b), max(a, b)) in got and jaccard(bags[a], bags[b]) >= 0.8) == want
    print("pairs", len(got))
    assert len(got) < 2_000


def test_middle_of_a_group_is_counted_without_a_row_for_each_shingle(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"t{int(x)}" for x in rng.integers(0, 3, 30))) for i in range(15)]
    groups = spark.createDataFrame([(i % 2, i) for i, _ in rows], "hub long, rep long")
    plans, real = [], bagminhash.materialize
    monkeypatch.setattr(bagminhash, "materialize", lambda df: plans.append(df._jdf.queryExecution().toString()) or real(df))
    got = {(r.hub, r.rep): (r.n, len(r.d)) for r in bagminhash.from_middle(groups, spark.createDataFrame(rows, "id long, text string"), 3, False).collect()}
    for hub in (0, 1):
        own = {i: collections.Counter(zip(*[t.split()[j:] for j in range(3)], strict=False)) for i, t in rows if i % 2 == hub}
        half = len(own) // 2
        middle = {g: sorted((c[g] for c in own.values()), reverse=True)[half] for c in own.values() for g in c}
        for i, c in own.items():
            assert got[hub, i] == (28, sum(abs(c[g] - middle[g]) for g in middle))
    assert len(plans) == 1 and "Window" not in plans[0]


# op5


def test_image_copies(spark):
    rng = np.random.default_rng(2)
    vec = [(i, rng.normal(size=64).tolist()) for i in range(40)] + [(41, None), (42, [0.0] * 64)]
    pictures = descriptors.draw(spark.createDataFrame(vec, "vec_id long, embedding array<float>"))
    more = spark.createDataFrame([(1000, b""), (1001, b"P5 x"), (None, b"P5 1 1 255\nx"), (1002, b"P5 1 1 255\nx")], "image_id long, image binary")
    out = {r.image_id: r for r in descriptors.image_copies(pictures.union(more)).collect()}
    assert all(out[2 * i + 1].class_id == 2 * i for i in range(0, 40, 10))
    assert all(out[2 * i].class_id == 2 * i for i in range(40))
    assert out[82].n_corners == 0 and out[1002].class_id == 1002 and out[None].class_id is None
    assert descriptors.image_copies(pictures.limit(0)).collect() == []


def turned(pixels, degrees=0.0, scale=1.0):
    """The picture turned about its centre and scaled, by linear interpolation."""
    (h, w), a = pixels.shape, np.deg2rad(degrees)
    rows, cols = round(h * scale), round(w * scale)
    y, x = np.mgrid[:rows, :cols].astype(float)
    y, x = (y - (rows - 1) / 2) / scale, (x - (cols - 1) / 2) / scale
    u, v = np.cos(a) * x + np.sin(a) * y + (w - 1) / 2, np.cos(a) * y - np.sin(a) * x + (h - 1) / 2
    i, j = np.clip(np.floor(v).astype(int), 0, h - 2), np.clip(np.floor(u).astype(int), 0, w - 2)
    s, t = np.clip(v - i, 0, 1), np.clip(u - j, 0, 1)
    return (1 - s) * ((1 - t) * pixels[i, j] + t * pixels[i, j + 1]) + s * ((1 - t) * pixels[i + 1, j] + t * pixels[i + 1, j + 1])


def edited(full, kind, rng):
    return (
        lambda: full + rng.normal(0, 8, full.shape),
        lambda: turned(full, 3),
        lambda: turned(full, 5),
        lambda: np.rot90(full),
        lambda: turned(full, scale=2**0.5),
        lambda: turned(full, scale=2),
        lambda: turned(full[8:56, 4:60], scale=2**0.5),
    )[kind]()


def test_image_copies_against_all_pairs(spark, monkeypatch):
    """Noisy, turned, scaled and cropped copies, and a large group: recall of the pairs that the geometric check links."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(49):
        full = np.kron(rng.normal(128, 45, (16, 16)).clip(0, 255), np.ones((4, 4)))
        rows += [(2 * i, full), (2 * i + 1, edited(full, i % 7, rng))]
    rows += [(1000 + i, rows[0][1] + rng.normal(0, 2, (64, 64))) for i in range(40)]
    rows = [(i, descriptors.write_pgm(np.rint(x).clip(0, 255))) for i, x in rows]
    feats = {i: descriptors.describe(descriptors.read_pgm(x)[None])[0] for i, x in rows}
    df = spark.createDataFrame(rows, "image_id long, image binary")
    want = classes_of(feats, lambda a, b: descriptors.inliers(feats[a], feats[b]) >= 6)
    for small in (16, 3):
        monkeypatch.setattr(descriptors, "SMALL_BUCKET", small)
        got = {r.image_id: r.class_id for r in descriptors.image_copies(df).collect()}
        linked = [i for i in want if want[i] != i]
        hit = sum(got[i] == want[i] for i in linked)
        print("linked", len(linked), "found", hit)
        assert len(linked) > 70 and hit >= 0.9 * len(linked)
        assert all(got[i] == i for i in want if want[i] == i)


def test_members_of_a_group_of_copies_are_compared_few_times(spark):
    """Every pair of 60 images has two small buckets of its own."""
    rows = [(k * 10_000 + i * 100 + j, rep, k) for i in range(60) for j in range(i + 1, 60) for k in (1, 2) for rep in (i, j)]
    compared = []

    def verify(pairs):
        compared.extend((r.a, r.b) for r in pairs.collect())
        return pairs.withColumn("linked", F.lit(True))

    got = descriptors.link_images(spark.createDataFrame(rows, "key long, rep long, corner int"), verify)
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(60)}
    assert len(compared) == len(set(compared)) < 4 * 60


def test_strays_in_large_buckets_meet_every_class(spark):
    """Two large buckets of one class and some images of others: each pair of different classes is compared."""
    one = [(100 + i, rep, c) for i in range(49) for rep in (0, i + 1) for c in (1, 2)]  # buckets of their own link 0 to 49
    rows = [(k + c * 1000, rep, c) for k, rep, c in one] + [(c, rep, c) for c in (1, 2) for rep in range(54)]
    compared = []

    def verify(pairs):
        compared.extend((r.a, r.b) for r in pairs.collect())
        return pairs.withColumn("linked", (F.col("b") < 50) | ((F.col("a") == 17) & (F.col("b") == 52)))

    got = {r.node: r.component for r in descriptors.link_images(spark.createDataFrame(rows, "key long, rep long, corner int"), verify).collect()}
    assert got == {**dict.fromkeys(range(50), 0), 52: 0}
    assert {(i, j) for i in range(54) for j in range(max(50, i + 1), 54)} <= set(compared)


# op6


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    where = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(math.inf if i is None else i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= 10 and len(where[key(x)]) > 1 and (math.inf if i is None else i) != min(where[key(x)]))]
        out.append((str(i), len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark, docs):
    out = linededup.dedup_lines(docs.withColumn("n_lines", F.lit("clash")))
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert linededup.dedup_lines(empty(docs)).collect() == []


def test_line_dedup_with_small_filters(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i if i % 9 else None, "\n".join(f" Line number {int(x)} of \u00e9\t" for x in rng.integers(0, 60, 12)) + "\n\n") for i in range(40)]
    rows += [(100 + i, "A line that all of these have" + "\nand \n" * (i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lambda: sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in linededup.dedup_lines(df).collect())
    want = brute_lines(rows)
    monkeypatch.setattr(linededup, "PART_ROWS", 5)
    assert got() == want
    # Filters by ranges of hashes, and full ones.
    monkeypatch.setattr(linededup, "MAX_BITS", 0)
    assert got() == want
    monkeypatch.setattr(linededup, "RANGE_BITS", 64)
    assert got() == want


def test_line_keys():
    texts = ["", "\n", " a\n\t\nB  b \r\n", "no end", "\n\n", "\u00e9\u00e9\u00e9\u00e9\u00e9\nx" + " " * 100_000 + "y"]
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for limit in (1, 1 << 20):
        seen = []
        for _, data, at in chunks(pa.array(texts), limit):
            s, e, low, high, line_at = linededup.line_spans(data, at)
            for r in range(len(at) - 1):
                seen.append([(bytes(data[s[k] : e[k]]).decode(), bytes(data[low[k] : high[k]]).decode().translate(FOLD)) for k in range(line_at[r], line_at[r + 1])])
        assert seen == [[(x, strip(x)) for x in t.split("\n")] for t in texts]
    (_, data, at), = chunks(pa.array(["12345\n\u00e9\u00e9\u00e9\u00e9\u00e9 \n1234"]))
    assert len(linededup.hashed_keys(data, at, 5)[0]) == 2


# op7


def test_mix(spark, docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    check_mix(out)
    assert mixing.mix(empty(docs)).collect() == []
    clash = mixing.mix(docs, carry=("size", "lang"))
    assert clash.columns == ["doc_id", "source", "carried_size", "lang", "size", "source_size", "target", "taken"] and {r.carried_size for r in clash.collect()} == {7, 1, 2, None}


def check_mix(out):
    sums = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        s = sums[r.source]
        s[0] += r.size
        s[1] += r.taken
        s[2], s[3] = r.target, r.source_size
    for size, taken, target, source_size in sums.values():
        assert size == source_size and target <= 2 * size + 1e-6
        assert abs(taken - target) <= 3
    total = sum(s[0] for s in sums.values())
    assert sum(s[2] for s in sums.values()) == pytest.approx(min(1.5 * total, 2 * total))


def test_mix_targets_by_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{int(rng.choice(7, p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.03, 0.02]))}") for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check_mix(out)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size))}
    left, open_, target = 1.5 * sum(size.values()), set(size), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    assert {r.source: r.target for r in out} == pytest.approx(target)


# op8


def test_language(spark, docs):
    more = [(100 + i, " ".join(np.roll(np.array(t.split()), i)) + ".", lang) for i in range(40) for t, lang in ((EN, "en"), (FR, "fr"))]
    df = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in langid.identify(df.withColumn("score", F.lit("clash")), F.col("doc_id") >= 100).collect()}
    assert out[0].lang_pred == "en" and out[1].lang_pred == "fr"
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].rejected for i in (2, 3, 6))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(empty(docs), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        langid.identify(docs, F.lit(False))


def test_kneser_ney_sums_to_one(spark):
    df = spark.createDataFrame([("aba bab abb", "x"), ("cac cca", "y")], "text string, lang string")
    counts = langid.gram_counts(df, 3).toPandas()
    table = langid.kneser_ney(counts, ["x", "y"], 3)
    seen = [32, 97, 98, 99]
    for past in ([97, 98], [32, 97], [99, 97], [32, 32]):
        lags = [np.array([*seen, 7], np.uint64), *[np.full(5, p, np.uint64) for p in reversed(past)]]
        assert np.exp(table.score(lags)).sum(axis=0) == pytest.approx(np.ones(2), abs=1e-4)


def test_language_of_held_out_texts_and_rejection(spark):
    """Held-out accuracy; made-up languages of the same letters and of others are rejected, learned ones are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(1)
    odd = []
    for i in range(60):
        letters = list("abcdefghijklmnopqrstuvwxyz") if i % 2 else [chr(0x430 + j) for j in range(32)]
        odd.append((10**9 + i, " ".join("".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(6 + i)), None))
    both = docs.withColumn("doc_id", F.col("doc_id").cast("long")).union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    out = langid.identify(both, train).withColumn("train", train).collect()
    held = [r for r in out if not r.train and r.lang and re.search("[a-z]", r.text or "")]
    assert len(held) > 200 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert not any(r.rejected for r in held if r.lang_pred == r.lang)
    assert sum(r.rejected for r in out if r.doc_id >= 10**9) == 60


def test_kneser_ney_by_brute_force(spark):
    """Order 3, one language, against probabilities from plain counts."""
    text = "abra cadabra abba cab"
    counts = langid.gram_counts(spark.createDataFrame([(text, "x")], "text string, lang string"), 3).toPandas()
    table = langid.kneser_ney(counts, ["x"], 3)
    padded = "  " + text
    grams = {n: collections.Counter(padded[i - n + 1 : i + 1] for i in range(2, len(padded))) for n in (1, 2, 3)}
    value = {3: dict(grams[3])}
    for n in (1, 2):
        value[n] = {g: len({h for h in grams[n + 1] if h[1:] == g}) for g in grams[n]}

    def d(n):
        n1, n2 = (sum(v == k for v in value[n].values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(grams[1]) + 1)
        own = {g: v for g, v in value[n].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not own or not total:
            return p(gram[1:])
        return max(own.get(gram, 0) - d(n), 0) / total + d(n) * sum(v > 0 for v in own.values()) / total * p(gram[1:])

    for past in ("ab", "br", " c", "ca", "zz"):
        for c in "abcdr ":
            lags = [np.array([ord(x)], np.uint64) for x in (c, past[1], past[0])]
            assert float(table.score(lags)[0, 0]) == pytest.approx(math.log(p(past + c)), abs=1e-4)


# op9


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header>Site name</header><nav><ul><li><a href=x>Menu one</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site for all we do.</p></div>
<article><header><h1>The headline</h1></header><p>First   paragraph with <b>bold &amp; text</b>,
over lines.<br>And more of it.</p><p>Short.</p><div class="ad"><p>Buy this now, it is really cheap today.</p></div><p>Last paragraph is a bit longer, too.</p>
<div id="comments"><p>I am a reader and this is my own opinion.</p></div></article>
<aside>Side bar text of some length is here.</aside><form>Your name <input></form><footer>&copy; me</footer></body></html>"""


def test_line_blocks(spark):
    pages = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>a"), (5, "u", "<div>" + "text and more text. " * 5000), (6, "u", "<nav>menu only"), (7, "u", "5 < 6 & <i>x</i>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r.page_id: r for r in linedist.extract(df).collect()}
    assert out[1].text == "The headline\n\nFirst paragraph with bold & text, over lines. And more of it.\n\nShort.\n\nLast paragraph is a bit longer, too."
    assert out[2].text == out[3].text == out[6].text == "" and out[4].text == "a" and out[5].n_chars == 20 * 5000 - 1
    assert out[7].text == "5 < 6 & x" and out[1].n_chars == len(out[1].text)
    assert linedist.extract(df.limit(0)).collect() == []


def brute_region(lines, window, threshold):
    """The text of (text, weight, box, prose) lines in plain Python."""
    n = len(lines)
    sums = [sum(x[1] for x in lines[i : i + window]) for i in range(n)]
    passed = [any(sums[j] >= threshold for j in range(max(0, i - window + 1), i + 1)) for i in range(n)]
    if not any(passed):
        return "\n\n".join(x[0] for x in lines if x[1] > 0)
    mass = collections.Counter()
    for x, p in zip(lines, passed, strict=True):
        mass[x[2]] += x[1] if p else 0
    box = min(mass, key=lambda b: (-mass[b], b))
    inside = [i for i in range(n) if (lines[i][2] == box if box else passed[i] and lines[i][1] > 0)]
    a, b = inside[0], inside[-1]
    if not box:
        free = lambda i: lines[i][3] and lines[i][1] > 0 and lines[i][2] == 0
        while a > 0 and free(a - 1):
            a -= 1
        while b < n - 1 and free(b + 1):
            b += 1
    return "\n\n".join(x[0] for x in lines[a : b + 1])


def test_surge_and_dive_by_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        n = int(rng.integers(0, 14))
        boxes = np.sort(rng.integers(0, 3, n)) if i % 2 else np.zeros(n, int)
        weights = rng.choice([0, 2, 9, 15, 45], n)
        rows.append((i, [(f"{i}.{j}", int(w), int(b), bool(rng.random() < 0.6)) for j, (w, b) in enumerate(zip(weights, boxes, strict=True))]))
    df = spark.createDataFrame(rows, f"id long, lines {linedist.LINE}")
    got = df.select("id", F.array_join(F.transform(linedist.between_surge_and_dive(F.col("lines"), 3, 40), lambda b: b["text"]), "\n\n").alias("t")).collect()
    assert {r.id: r.t for r in got} == {i: brute_region(x, 3, 40) for i, x in rows}


def test_pages_without_article_elements(spark):
    """The same text with and without the elements that mark an article; short paragraphs in it stay."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.text for r in linedist.extract(pages).collect()}
    bare = {r.page_id: r.text for r in linedist.extract(pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))).collect()}
    assert got == bare
    html = {r.page_id: r.html for r in pages.collect()}
    assert all(got[i] == "\n\n".join(x[0] for x in linedist.blocks(html[i]) if x[2]) for i in got)
    body = "<h1>Rech.</h1><p>By To.</p>" + "<p>A paragraph of more than forty letters, to be sure of it.</p>" * 3 + "<p>Of.</p><p><a href=x>Link alone</a></p><p>Or.</p>" * 4
    tail = "<p>And a long one, which is at the end of the whole article here.</p>"
    odd = [(1, f"<article>{body}{tail}</article><div>Side</div>"), (2, f"<ul><li><a>Menu</a></li></ul>{body}{tail}<div><a>Next</a></div>"), (3, "<p><a>AT&amp;T &amp; R&amp;D &amp; Q&amp;A</a> plan.</p>")]
    out = {r.page_id: r for r in linedist.extract(spark.createDataFrame(odd, "page_id long, html string").selectExpr("*", "1 as __cut", "2 as lines", "3 as `a.b`")).collect()}
    assert out[1].text == out[2].text == "\n\n".join(x[0] for x in linedist.blocks(body + tail)) and "By To." in out[1].text
    assert out[3].text == "AT&T & R&D & Q&A plan." and out[3]["a.b"] == 3


# op10


def test_decontamination(spark, docs):
    items = [(1, "Alpha beta gamma delta. Epsilon zeta eta theta iota. Kappa lambda mu nu xi omicron."), (2, "too short"), (3, None), (None, "seven words make an item without id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "prefix kappa LAMBDA mu nu xi omicron and then epsilon zeta eta theta iota alpha beta gamma delta!"),
        (2, "alpha beta gamma delta only"),
        (3, "clean text about nothing that is in there"),
        (4, ("Alpha beta gamma delta epsilon zeta eta theta iota kappa " * 300)),
        (5, None),
        (6, "seven words make an item without id"),
        (7, "too short"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated_pairs(df, bench).collect()}
    assert set(got) == {(1, 1), (4, 1), (6, None)}
    assert got[1, 1].coverage == 1.0 and got[1, 1].tiles == 3
    assert sorted(r.doc_id for r in decontam.decontaminate(df, bench).collect()) == [2, 3, 5, 7]
    assert decontam.decontaminate(docs, bench).count() == docs.count() and decontam.decontaminate(docs, bench).columns == docs.columns
    assert decontam.contaminated_pairs(df, bench.limit(0)).collect() == [] and decontam.contaminated_pairs(df.limit(0), bench).collect() == []


def brute_tiles(text, item, k):
    a, b, covered, tiles = np.zeros(len(text), bool), np.zeros(len(item), bool), 0, 0
    while True:
        best = (0, 0, 0)
        for x in range(len(item)):
            for y in range(len(text)):
                n = 0
                while x + n < len(item) and y + n < len(text) and item[x + n] == text[y + n] and not b[x + n] and not a[y + n]:
                    n += 1
                if (n, -x, -y) > (best[0], -best[1], -best[2]) and n >= k:
                    best = (n, x, y)
        if best[0] < k:
            return covered, tiles
        n, x, y = best
        b[x : x + n] = a[y : y + n] = True
        covered += n
        tiles += 1


def test_tiles_by_brute_force():
    rng = np.random.default_rng(8)
    for words in (1, 2, 4, 6):
        for _ in range(40):
            item, text = rng.integers(0, words, int(rng.integers(2, 14))), rng.integers(0, words, int(rng.integers(1, 40)))
            assert decontam.tile(text, item, 3, 1) == brute_tiles(text, item, 3)


def test_tiles_of_repeated_words():
    item, text = np.zeros(2000, np.int64), np.zeros(8000, np.int64)
    assert decontam.tile(text, item, 4, 1000) == (2000, 1)
    item[::7], text[::5] = 1, 1
    assert decontam.tile(text, item, 4, 1)[0] > 0


def test_decontamination_by_brute_force(spark, monkeypatch):
    """Random texts of few words, shuffled passages among them; a filter that is full lets all windows into the join."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(60)])
    items = [(f"item {i}", " ".join(rng.choice(vocabulary, int(rng.integers(3, 30))))) for i in range(12)]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(0, 60))))
        if i % 3 == 0:
            passage = items[i % 12][1].split()
            cut = len(passage) // 2
            words[3:3] = passage[cut:] + ["x"] + passage[:cut]
        rows.append((i, "\n".join([" ".join(words[:9]), ", ".join(words[9:])])))
    want = set()
    for i, t in rows:
        for j, x in items:
            a, b = re.findall("[a-z0-9]+", t), re.findall("[a-z0-9]+", x)
            covered, tiles = brute_tiles(a, b, 4)
            if covered and covered >= 0.5 * len(b):
                want.add((i, j, covered, tiles))
    assert len({x[0] for x in want}) > 10
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (1 << 20, 8):
        monkeypatch.setattr(decontam, "LEAST_BITS", bits)
        monkeypatch.setattr(decontam, "MAX_BITS", bits)
        assert {(r.doc_id, r.item_id, r.covered, r.tiles) for r in decontam.contaminated_pairs(df, bench).collect()} == want
    # With seeds of two documents or more counted as common the result is the same.
    monkeypatch.setattr(decontam, "COMMON", 1)
    monkeypatch.setattr(decontam, "COMMON_SHARE", 1_000_000)
    assert {(r.doc_id, r.item_id, r.covered, r.tiles) for r in decontam.contaminated_pairs(df, bench).collect()} == want
    clash = df.selectExpr("doc_id", "text", "1 as seeds", "2 as rid", "3 as `a.b`", "4 as `row`")
    kept = decontam.decontaminate(clash, bench)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {x[0] for x in want}
    assert all(r.seeds == 1 and r["a.b"] == 3 for r in kept.collect())


def test_a_common_seed_makes_no_pairs(spark, monkeypatch):
    """Four words that all documents and all items have bring no document to an item."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(decontam, "COMMON", 50)
    rows = [(i, "this is very common " + " ".join(f"d{i}x{k}" for k in range(20))) for i in range(300)]
    items = [(j, "this is very common " + " ".join(f"i{j}x{k}" for k in range(int(rng.integers(8, 20))))) for j in range(90)]
    rows.append((300, items[7][1]))
    items.append((90, "this is very common"))  # an item of a common seed alone
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    made = decontam.Benchmark(bench, "item_id", "text", 4)
    met: list[int] = []
    real = decontam.tiles_udf
    monkeypatch.setattr(decontam, "tiles_udf", lambda *a: met.append(1) or real(*a))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated_pairs(df, bench).collect()}
    assert got == {(i, 90) for i in range(301)} | {(300, 7)} and met
    rows_ = df.withColumn("seeds", decontam.seeds_udf(made.sent, 4)("text")).withColumn("rid", F.col("doc_id"))
    plan = made.hits(rows_, 0.5)
    assert plan.count() == 302


def test_ascii_lower(spark):
    assert spark.range(1).select(lower_ascii(F.lit("ÀBÇx"))).first()[0] == "ÀbÇx"


def test_registered_queries(spark):
    import __spark_entry__ as e

    found = e.queries()
    assert {int(re.match(r"op(\d+)_", x)[1]) for x in found if x.startswith("op")} == set(range(1, 11)) and "pipeline" in found


def test_sha(spark, docs):
    out = linededup.dedup_lines(docs).select("text", F.sha2("text", 256).alias("h")).collect()
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.h for r in out)
    assert zlib.crc32(b"5") % 5 == spark.range(1).select(F.crc32(F.lit("5")) % 5).first()[0]
