"""Training-data operators: against their SQL, brute force or a public library, and their edge cases."""

import base64
import collections
import hashlib
import math
import re
from pathlib import Path

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pytest
from maskwright.llm import bpe, fingerprints, hmm_score, html_extract, jaccard_join, license_scan, mixing, quality_classifier, quality_rules, queries as registered, suffix_dedup, textops as X, vocabulary
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    oracle.assert_same(registered.queries()[name](spark, FOLDER), registered.oracle_sql()[name], oracle.connect(FOLDER))


PASSAGE = " ".join(f"word{k * 37 % 101}x{k}" for k in range(80))
ODD = [
    (1, PASSAGE, "en", "a", 5),
    (2, PASSAGE, None, None, None),
    (2, PASSAGE, None, None, None),
    (3, "intro " + PASSAGE + " ending", "en", "a", -1),
    (None, PASSAGE, "en", "", 5),
    (4, None, "en", "a", 5),
    (5, "", "en", "a", 0),
    (6, "é", "en", "a", 1),
    (7, "long " * 40_000, "en", "a", 200_000),
    (8, " \n\t ", "en", "a", 4),
]
OPERATORS = {
    "repeats": suffix_dedup.repeat_spans, "drop_repeats": suffix_dedup.drop_repeats, "fingerprints": fingerprints.fingerprints, "copies": mixing.copies, "mix": mixing.mix, "encode": bpe.encode,
    "rules": quality_rules.quality_report, "keep_good": quality_rules.keep_good, "licenses": license_scan.scan, "hmm": hmm_score.scored, "pairs": jaccard_join.near_pairs, "near": jaccard_join.near_duplicates, "keep_one": jaccard_join.keep_one,
    "classify": lambda d: quality_classifier.classify(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))),
}
CLASHES = ("g", "key", "bucket", "n", "label", "tokens", "copies", "a", "page")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3).cache()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty_tables(spark, odd, name):
    operator = OPERATORS[name]
    plain = operator(odd)
    wide = operator(odd.withColumns({c: F.lit("x") for c in CLASHES}))
    rows = lambda df: sorted(str(oracle.plain(r)) for r in df.select(*sorted(set(plain.columns) - set(CLASHES))).collect())
    assert rows(plain) == rows(wide) == rows(operator(odd.repartition(2)))
    assert operator(odd.limit(0)).count() == 0


def test_repeats(odd):
    got = {(r.doc_id, r.kind, r.start_word, r.end_word) for r in suffix_dedup.repeat_spans(odd).filter("doc_id < 7").collect()}
    assert got == {(1, "repeat", 0, 80), (2, "repeat", 0, 80), (3, "repeat", 1, 81), (2, "drop", 0, 80), (3, "drop", 1, 81)}
    left = {r.doc_id: r.text for r in suffix_dedup.drop_repeats(odd).filter("doc_id < 7").collect()}
    assert left[1] == PASSAGE and 2 not in left and left[3] == "intro ending" and left[4] is None and left[5] == ""


def test_repeats_without_a_broadcast(odd, monkeypatch):
    """Where the documents that lose words are too many to be sent to all workers, a join tells them; also rows of one id with different texts."""
    more = odd.union(odd.sparkSession.createDataFrame([(3, PASSAGE + " another end", "en", "a", 1), (9, None, None, None, None)], DOCS))
    for docs in (odd, more):
        monkeypatch.setattr(suffix_dedup.E, "MOST_IDS", 1_000_000)
        want = sorted(str(r) for r in suffix_dedup.drop_repeats(docs).collect())
        monkeypatch.setattr(suffix_dedup.E, "MOST_IDS", 0)
        assert sorted(str(r) for r in suffix_dedup.drop_repeats(docs).collect()) == want


def test_repeats_against_brute_force(spark):
    """All windows of 50 words by their words: within a text, across texts, at a text's start and end, in runs that touch."""
    shared = [_prose(k, 70) for k in range(40, 44)]
    texts = [f"{_prose(50 + k, k)} {shared[k % 4]} {_prose(60 + k, 3 * k)} {shared[(k + 1) % 4]}" for k in range(12)] + ["same " * 130, _prose(1, 49), shared[0], shared[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    places = {}
    for d, t in enumerate(texts):
        words = t.split()
        for i in range(len(words) - 49):
            places.setdefault(tuple(words[i : i + 50]), []).append((d, i))
    want = set()
    for kind in ("repeat", "drop"):
        at = sorted(p for own in places.values() if len(own) > 1 for p in (own if kind == "repeat" else own[1:]))
        for d, i in at:
            last = next(((k, x, a, b) for k, x, a, b in want if k == kind and x == d and a <= i <= b), None)
            want.discard(last)
            want.add((kind, d, last[2] if last else i, i + 50))
    assert {(r.kind, r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeat_spans(docs).collect()} == want


def test_near_pairs_and_groups(odd):
    pairs = {(r.doc_a, r.doc_b): round(r.jaccard, 3) for r in jaccard_join.near_pairs(odd).collect()}
    assert pairs == {(1, 2): 1.0, (1, 3): 0.975, (2, 3): 0.975}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard_join.keep_one(odd).collect()) == [(False, k) for k in (1, 4, 5, 6, 7, 8)] + [(True, 0)]


def _grams(text):
    words = re.findall(r"[a-z0-9]+", text)
    return frozenset(zip(words, words[1:], words[2:]))


def _edited(seed, base, edits):
    rng = np.random.default_rng(seed)
    words = base.split()
    for k in rng.choice(len(words), edits, replace=False):
        words[k] = f"z{rng.integers(1 << 40):x}"
    return " ".join(words)


@pytest.mark.parametrize(("many", "grams", "bits"), [(16, 1_500_000, 48), (2, 1500, 48), (2, 1_500_000, 20), (10_000, 1_500_000, 20)])
def test_groups_against_brute_force(spark, monkeypatch, many, grams, bits):
    """Groups of near copies, pairs and texts that share a passage: by tiles of lists, cut into blocks, by pairs, and where different grams meet by chance."""
    monkeypatch.setattr(jaccard_join, "TILE_GRAMS", grams)
    group, other, passage = _prose(11, 120), _prose(12, 90), _prose(13, 50)
    texts = [_edited(k, group, k % 9) for k in range(70)] + [_edited(k, other, 4) for k in range(25)] + [group] * 3
    texts += [f"{_prose(700 + k, 60)} {passage}" for k in range(30)] + [x for k in range(20) for x in (_prose(500 + k, 40 + k), _edited(k, _prose(500 + k, 40 + k), 3))]
    docs = spark.createDataFrame([*enumerate(texts), (5, texts[75])], "doc_id bigint, text string").repartition(4).cache()
    own = [(k, _grams(t)) for k, t in [*enumerate(texts), (5, texts[75])]]
    near = [(a, b) for i, (a, x) in enumerate(own) for b, y in own[:i] if len(x & y) * 10 >= 6 * len(x | y)]
    links, group = dict.fromkeys(range(len(texts)), 0), list(range(len(texts)))
    for a, b in [*near, *[(5, 5)]]:
        links[a] += a != b
        links[b] += a != b
        low, high = sorted((group[a], group[b]))
        group = [low if x == high else x for x in group]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs, many=many, bits=bits).collect()}
    assert len(near) > 1500 and got == {k: (group[k], n) for k, n in links.items() if n}
    assert {(r.doc_a, r.doc_b) for r in jaccard_join.near_pairs(docs, many=many, bits=bits).collect()} == {(min(p), max(p)) for p in near}


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (7, 9)], [(1, 2), (4, 3), (2, 3), (6, 5), (5, 4), (10, 11)]])
def test_components_agree(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    few, many = ({r.vertex: r.label for r in jaccard_join.components(df, most).collect()} for most in (100, 1))
    assert few == many and all(few[a] == few[b] for a, b in edges)


def test_keep_one_without_a_broadcast(odd, monkeypatch):
    want = sorted(str(r) for r in jaccard_join.keep_one(odd).collect())
    monkeypatch.setattr(jaccard_join.E, "MOST_IDS", 0)
    assert sorted(str(r) for r in jaccard_join.keep_one(odd).collect()) == want


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_keep_one_row_of_a_repeated_document(spark, monkeypatch, most):
    """A document that stays, though its rows repeat, alike or with other texts or none, is one row."""
    monkeypatch.setattr(jaccard_join.E, "MOST_IDS", most)
    alone = " ".join(f"other{k}" for k in range(60))
    rows = [(1, PASSAGE, "en", "a", 5)] * 3 + [(2, PASSAGE, "en", "a", 5)] * 2 + [(3, "b " + alone, "en", "a", 1), (3, "a " + alone, "en", "b", 1), (3, None, "en", "a", 1), (4, None, "en", "a", 0), (4, None, "en", "a", 0), (5, "b", "en", "a", 1)] + [(None, PASSAGE, "en", "a", 5)] * 2
    got = jaccard_join.keep_one(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, PASSAGE), (0, PASSAGE), (1, PASSAGE), (3, "a " + alone), (4, ""), (5, "b")]


def test_encoding_is_that_of_a_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(bpe.VOCABULARY).read_bytes().splitlines())}
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    got = rows.select("text", "tokens", "round_trip").collect()
    assert got and all(r.tokens == library.encode_ordinary(r.text) and r.round_trip for r in got)
    assert all(r.text == r.was for r in bpe.decode(rows.withColumn("was", F.col("text"))).select("text", "was").collect())


def test_long_words_and_null_tokens(spark):
    """Words beyond LOCKSTEP bytes go through the heap; null tokens, none and an empty table are decoded too."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(bpe.VOCABULARY).read_bytes().splitlines())}
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdeé"), n)) for n in (63, 64, 65, 700, 5000)] + ["", None, "<|endoftext|> x"]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert all(rows[k].tokens == (None if t is None else library.encode_ordinary(t)) and rows[k].round_trip for k, t in enumerate(texts))
    assert {r.doc_id: r.text for r in bpe.decode(got.drop("text")).collect()} == dict(enumerate(texts))
    assert bpe.decode(got.limit(0)).count() == 0


@pytest.mark.parametrize("labelled", [0, 1, 5])
def test_classifier_with_few_odd_labels(spark, labelled):
    """Null and repeated labels, few of them or none; rows that repeat a doc_id are scored each, and alike where their texts are."""
    docs = spark.createDataFrame([(k, _prose(k, 30)) for k in range(8)] + [(3, _prose(3, 30)), (None, "x"), (9, None), (10, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(labelled)] + [(0, None, 1), (None, 1, 1), (6, 1, None)] + [(0, 0, 1)] * (labelled > 0), "doc_id bigint, quality int, toxic int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == 12 and all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    assert len({(round(r.p_quality, 9), round(r.p_toxic, 9)) for r in got if r.doc_id == 3}) == 1
    assert (labelled > 0) != all((r.p_quality, r.p_toxic, r.keep) == (0.5, 0.5, True) for r in got)


def test_network_is_calibrated():
    """Held-out labels drawn by known probabilities: the network's come near them, and the temperature of pure noise is high."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 3))
    p = 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))
    y = np.stack([rng.random(6000) < p, rng.random(6000) < 0.5], axis=1).astype(float)
    net = quality_classifier.Network().fit(x[:5000], y[:5000])
    got = net.probabilities(x[5000:])
    assert np.abs(got[:, 0] - p[5000:]).mean() < 0.06 and np.abs(got[:, 1] - 0.5).mean() < 0.15 and (net.temperature > 0).all()
    h = np.tanh((x[5000:] - net.mean) / net.scale @ net.w1 + net.b1) @ net.w2 + net.b2
    assert np.allclose(got, 1 / (1 + np.exp(-h / net.temperature)))


def test_word_vectors_against_brute_force(spark):
    """Sums of neighbours' index vectors, counts and label shares by plain loops."""
    texts = [_prose(k, 25) + " alpha beta alpha" for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    words = np.unique(X.plain_words(pa.array(texts)).hash)
    labels = {0: (1, 0), 1: (0, 1), 2: (1, 1)}
    got, count = quality_classifier.word_vectors(docs, words, labels)
    ids = [np.searchsorted(words, X.plain_words(pa.array([t])).hash).tolist() for t in texts]
    n = len(words) + quality_classifier.OTHERS + len(quality_classifier.MARKS)
    place, sign = quality_classifier.index_vectors(n)
    sums, want = np.zeros((n, quality_classifier.DIMENSIONS)), np.zeros(n)
    for own in ids:
        for i, w in enumerate(own):
            want[w] += 1
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if i != j:
                    np.add.at(sums[w], place[own[j]], sign[own[j]])
    assert count[: len(words)].tolist() == want[: len(words)].tolist()
    sums -= sums.sum(axis=0) / count.sum() * count[:, None]
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    own = np.random.default_rng(quality_classifier.SEED + 1).normal(size=(n, quality_classifier.DIMENSIONS))
    assert np.allclose(got[: len(words), :-2], unit(unit(sums) + unit(own))[: len(words)], atol=1e-3)
    alpha = int(np.searchsorted(words, X.plain_words(pa.array(["alpha"])).hash[0]))
    assert got[alpha, -2:] == pytest.approx([(2 + 8 * 2 / 3) / 11, (2 + 8 * 2 / 3) / 11], abs=1e-6)


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(1)
    k, symbols = 3, 20
    emit = rng.random((symbols, k)) + 0.01
    move = rng.random((k, k)) + 0.01
    model = hmm_score.Model(np.zeros(0, np.uint64), np.full(k, 1 / k), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), symbols)
    sizes = [0, 1, 5, 128, 129, 700]
    seen = rng.integers(0, symbols, sum(sizes))
    got = hmm_score.log_likelihood(model, seen, np.cumsum(sizes) - sizes, np.array(sizes))
    at = 0
    for n, log in zip(sizes, got):
        alpha, total = model.start, 0.0
        for t in range(n):
            alpha = (alpha @ model.move if t else alpha) * model.emit[seen[at + t]]
            total += np.log(alpha.sum())
            alpha = alpha / alpha.sum()
        at += n
        assert log == pytest.approx(total, abs=1e-6)


def _baum_welch(texts, model):
    """Expected starts, moves and emissions of whole texts by plain loops."""
    k = len(model.start)
    begun, moved, emitted, log = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
    for seen in texts:
        alpha, scale = [], []
        for t, x in enumerate(seen):
            now = (alpha[-1] @ model.move if t else model.start) * model.emit[x]
            scale.append(now.sum())
            alpha.append(now / scale[-1])
        log += np.log(scale).sum()
        beta = np.ones(k)
        for t in range(len(seen) - 1, -1, -1):
            gamma = alpha[t] * beta
            emitted[seen[t]] += gamma
            if t:
                moved += np.outer(alpha[t - 1], model.emit[seen[t]] * beta / scale[t]) * model.move
                beta = model.move @ (model.emit[seen[t]] * beta) / scale[t]
            else:
                begun += gamma
    return begun, moved, emitted, log


def test_baum_welch_counts_of_whole_texts(spark):
    """One iteration over partitions and pools against plain loops over each text from its first word to its last."""
    texts = [_prose(k, n) for k, n in enumerate([1, 2, 40, 300, 1500, 5000])] + ["the word the word", "", None, "the word the word"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    model, history = hmm_score.train(docs, words=50, others=8, states=3, iterations=2)
    again, _ = hmm_score.train(docs, words=50, others=8, states=3, iterations=1)
    symbols = [again.symbols(X.plain_words(pa.array([t])).hash) for t in texts if t]
    begun, moved, emitted, log = _baum_welch(symbols, again)
    assert history[1] == pytest.approx(log)
    got = hmm_score._expected_sums(docs, again)
    assert np.allclose(got[:58], emitted) and np.allclose(got[58:61], moved) and np.allclose(got[61], begun) and begun.sum() == pytest.approx(8)
    assert np.allclose(model.start, (begun + 1e-3) / (begun + 1e-3).sum())
    assert again.tied.tolist() == emitted[50:].sum(axis=1).round().tolist()


def test_training_raises_the_likelihood(spark):
    _, history = hmm_score.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert history == sorted(history)


def test_every_word_has_its_own_emission(spark):
    """Emissions of all the corpus' words sum to 1, and a tied word's is its symbol's times its share."""
    common = " ".join(f"w{k}" for k in range(5000))
    texts = [common] * 3 + [f"junk{k}" for k in range(2000)] + ["seldom " * 40] + ["seldom", "seldom", "", None, "w1 w2 seldom junk5 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).cache()
    model, _ = hmm_score.train(docs)
    got = {r.doc_id: r for r in hmm_score.score(docs, model).collect()}
    count = collections.Counter(w for t in texts if t for w in t.split())
    assert len(got) == len(texts) and got[2006].n_words == got[2007].n_words == 0 and got[2006].perplexity is None and got[2006].log_likelihood == 0
    for k in (0, 3, 2003, 2004, 2008):
        words = texts[k].split()
        ids = model.symbols(X.plain_words(pa.array([texts[k]])).hash)
        share = [math.log(count[w] / model.tied[i - len(model.words)]) for w, i in zip(words, ids) if i >= len(model.words)]
        assert got[k].log_likelihood == pytest.approx(_baum_welch([ids], model)[3] + sum(share)) and got[k].n_words == len(words)
        assert got[k].perplexity == pytest.approx(math.exp(-got[k].log_likelihood / len(words)))
    ties = {i: sum(count[w] for w, j in zip(count, model.symbols(X.plain_words(pa.array([" ".join(count)])).hash)) if j == i) for i in range(len(model.words), len(model.emit))}
    assert all(model.tied[i - len(model.words)] == n for i, n in ties.items())
    assert got[2005].log_likelihood == got[2004].log_likelihood > max(got[k].log_likelihood for k in range(3, 2003))


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_sums_of_arrays(spark, parts):
    def make(batches):
        return np.full((1500, 3), float(sum(b.column(0).to_numpy().sum() for b in batches)))

    got = vocabulary.sum_arrays(spark.range(400).repartition(parts), make, 1500, 3)
    assert got.shape == (1500, 3) and (got == 400 * 399 / 2).all()


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = labels.filter("doc_id % 4 = 0")
    got = quality_classifier.classify(docs, labels.filter("doc_id % 4 <> 0")).join(held, "doc_id")
    right, n, toxic, caught = got.agg(F.sum(((F.col("p_quality") >= 0.5) == (F.col("quality") == 1)).cast("int")), F.count(F.lit(1)), F.sum("toxic"), F.sum(F.when((F.col("toxic") == 1) & (F.col("p_toxic") >= 0.5), 1).otherwise(0))).first()
    assert right >= 0.85 * n and caught >= 0.7 * toxic


def test_fingerprints_find_near_copies(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150).select("doc_id", "text").filter("length(text) > 400")
    near = docs.select(((F.col("doc_id") + 1_000_000) * 50).alias("doc_id"), F.concat(F.lit("A changed beginning. "), "text").alias("text"))
    got = fingerprints.fingerprints(docs.union(near)).filter("doc_id >= 50000000")
    n, found = got.agg(F.count(F.lit(1)), F.sum((F.coalesce("match_score", F.lit(0)) >= 60).cast("int"))).first()
    assert found >= 0.9 * n


def _scores_by_brute_force(made):
    """Score of every two documents (of one row each), from each one's side."""
    rows = [r for r in made.select("doc_id", "digest", "n_features").collect() if r.n_features]
    return {(a.doc_id, b.doc_id): fingerprints.compare(a.digest, a.n_features, b.digest, b.n_features) for a in rows for b in rows if a.doc_id != b.doc_id}


def _prose(seed, words):
    return " ".join(f"{w:x}" for w in np.random.default_rng(seed).integers(1 << 12, 1 << 34, words))


def test_fingerprints_recall_of_all_pairs(spark):
    passage, long = _prose(1, 60), [_prose(100 + k, 3000) for k in range(4)]
    texts = [f"{_prose(200 + k, 40)} {passage}" for k in range(8)]  # an unrelated passage comes first, and holds its keys
    texts += [f"{_prose(300 + k, 3)} {passage} {_prose(2, 250)} {_prose(400 + k, 3)}" for k in range(12)]  # a group of near copies
    texts += [_prose(3, 90)] * 6 + long
    texts += [" ".join(t.split()[a : a + 70]) for t in long for a in range(50, 2900, 300)]  # short texts in long ones
    # Each text asks once, and stands once among the others.
    docs = spark.createDataFrame([x for k, t in enumerate(texts) for x in ((50 * k, t), (50 * k + 1, t + f" {k}"))], "doc_id bigint, text string").repartition(3).cache()
    made = fingerprints.fingerprints(docs).cache()
    every = _scores_by_brute_force(made)
    near = {k: v for k, v in every.items() if v >= 60 and k[0] % 50 == 0}
    got = {(r.doc_id, r.to): r.score for r in fingerprints.pairs(docs).collect()}
    group = [(50 * a, 50 * b + c) for a in range(8, 20) for b in range(8, 20) for c in (0, 1) if a != b]
    inside = [(a, b) for a, b in near if b // 50 in range(26, 30) and a // 50 >= 30]
    assert len(inside) >= 36 and all(p in near for p in group)
    for some in (near, group, inside):
        assert sum(p in got for p in some) >= 0.9 * len(some)
    assert all(d % 50 == 0 for d, _ in got) and all(got[p] == pytest.approx(every[p]) for p in got)
    for r in made.collect():
        mine = [(-s, b) for (a, b), s in got.items() if a == r.doc_id]
        want = (None, None, None if r.doc_id % 50 else 0) if not mine else (min(mine)[1], pytest.approx(-min(mine)[0]), len(mine))
        assert (r.match_id, r.match_score, r.n_matches) == want


def test_fingerprint_digests_against_brute_force(spark):
    """Windows' entropies, points and filters by plain loops."""
    texts = [_prose(31, 400), _prose(32, 60), "aaaa bbbb " * 40, _prose(33, 12), "é" * 90]
    count = collections.Counter()
    level = {}
    for t in texts:
        raw = t.encode()
        for i in range(len(raw) - 63):
            c = collections.Counter(raw[i : i + 64]).values()
            level[raw, i] = min(999, int((6 - sum(x * math.log2(x) for x in c) / 64) * 1000 / 6 + 1e-6))
            count[level[raw, i]] += 1
    rank = {k: r for r, k in enumerate(sorted(range(1000), key=lambda x: (count[x], x)))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    for r in fingerprints.fingerprints(docs).collect():
        raw = texts[r.doc_id].encode()
        n = len(raw) - 63
        points = [0] * n
        for i in range(n - 63):
            best = min(range(i, i + 64), key=lambda j: (rank[level[raw, j]] if level[raw, j] >= 100 else 1000, j))
            points[best] += level[raw, best] >= 100
        want = sum(p >= 16 for p in points)
        assert r.n_features == max(1, want) and r.n_filters == -(-r.n_features // 160) and len(r.digest) == 256 * r.n_filters
        assert 0 < np.unpackbits(np.frombuffer(r.digest, np.uint8)).sum() <= 5 * r.n_features


def test_fingerprints_of_short_and_repeated_texts(spark):
    short = ["é", "Call me at noon.", "x" * 64, _prose(5, 9), _prose(6, 14)[:141], "long " * 400]
    docs = spark.createDataFrame([(50 * k, t) for k, t in enumerate(short * 2)] + [(1000, ""), (1050, None), (1100, "y"), (1150, "é"), (1150, "x" * 64), (1201, "y"), (None, "y")], "doc_id bigint, text string")
    got = {}
    for r in fingerprints.fingerprints(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[50 * k][0].match_id == 50 * ((k + 6) % 12) and got[50 * k][0].match_score == 100 for k in range(12))
    assert [got[k][0].n_features for k in (1000, 1050, 1100)] == [0, 0, 1] and got[1100][0].match_id == 1201 and got[1100][0].n_matches == 1
    # Rows of one doc_id match apart; ties go to the least doc_id; a row that isn't a query or has no doc_id has no match.
    assert sorted(r.match_id for r in got[1150]) == [0, 100] and got[0][0].n_matches == 2
    assert got[1201][0].match_id is None and got[1201][0].n_matches is None and got[None][0].n_matches is None


def test_mixture_fills_each_source(spark):
    docs = spark.createDataFrame([(k, "x" * (k % 50), None, "a" if k % 3 else "b", k % 50) for k in range(300)], DOCS)
    got = dict(mixing.copies(docs, {"a": 1, "b": 3}, 200).groupBy("source").agg(F.sum("copies")).collect())
    assert got == {"a": 150, "b": 450}
    assert mixing.mix(docs, {"a": 1, "b": 3}, 200).count() == 600


def _pareto(rows, percent, seed=17):
    """Copies by sorting each source: (doc_id, source, n_chars) to the copies of all such rows."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0], max(r[2] or 0, 0)))
    weights = {k: math.isqrt(len(v)) for k, v in sources.items()}
    out = {}
    for source, own in sources.items():
        n = len(rows) * percent // 100 * weights[source] // sum(weights.values())
        measure = [1 + len(f"{c:b}") for _, c in own]
        total, rank = sum(measure), []
        for (d, c), m in zip(own, measure):
            out[d, source, c] = out.get((d, source, c), 0) + n * m // total
            left = n * m % total
            u = (int(hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            if left:
                rank.append((u / (1 - u) * ((1 - left / total) / (left / total)), d or 0, c, d))
        for _, _, c, d in sorted(rank, key=lambda x: x[:3])[: sum(n * m % total for m in measure) // total]:
            out[d, source, c] += 1
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("most", [300_000, 0])
@pytest.mark.parametrize("percent", [40, 170])
def test_mix_against_brute_force(spark, monkeypatch, most, percent):
    """Null sources, documents that repeat with equal and other texts, one that is a third of all rows; by a broadcast and by a join."""
    monkeypatch.setattr(mixing.E, "MOST_ROWS", most)
    monkeypatch.setattr(mixing, "BINS", 64)
    rows = [(k, "x" * (k % 40), None, (None, "", "a", "b")[k % 4], k % 40) for k in range(200)]
    rows += [(7, "same", None, "b", 9)] * 120 + [(9, f"other {k}", None, "a", 5) for k in range(30)] + [(None, "y", None, "a", None)] * 10
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    want = _pareto([(r[0], r[3], r[4]) for r in rows], percent)
    count = {}
    for r in mixing.mix(docs, percent=percent).collect():
        key = (r.doc_id, r.source, max(r.n_chars or 0, 0))
        count[key] = count.get(key, 0) + 1
    assert count == want
    assert {(r.doc_id, r.source): r.n for r in mixing.copies(docs, percent=percent).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()} == {(d, s): sum(v for (x, y, _), v in want.items() if (x, y) == (d, s)) for d, s, _ in want}
    assert {tuple(r) for r in mixing.mix(docs, percent=percent).collect()} <= set(rows)


def test_mix_leaves_texts_where_they_are(spark):
    plan = mixing.mix(spark.read.parquet(f"{FOLDER}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and not re.search(r"(?<!Broadcast)Exchange", plan)


def test_html():
    page = "<html><body><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><p>" + "This is a long paragraph of real text in which things are told. " * 6 + "</p><script>var x</script></body></html>"
    text, n, kept = html_extract.content([page, None, "", "<p", "<" * 5000])
    assert "real text" in text[0] and "Home" not in text[0] and "var x" not in text[0] and n[1] == kept[2] == 0


PAGE = "<html><body><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><p>" + "This is a long paragraph of real text in which things are told. " * 6 + "</p></body></html>"


def test_odd_pages(spark):
    """Null and repeated ids, null, empty, wordless and long pages, columns of clashing names, an empty table."""
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<br><hr>"), (5, "u", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [tuple(r) for r in html_extract.extract(pages).collect()]
    text = ("This is a long paragraph of real text in which things are told. " * 6).strip()
    want = [(k, u, text, 3, 1) for k, u in ((1, "u"), (1, "u"), (None, None))] + [(k, "u", "", 0, 0) for k in (2, 3, 4)] + [(5, "u", ("word " * 100_000).strip(), 1, 1)]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
    wide = html_extract.extract(pages.withColumns({c: F.lit("x") for c in ("text", "n_blocks", "n_content", "a")}))
    assert sorted((tuple(r) for r in wide.collect()), key=key) == sorted(got, key=key)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_unclosed_markup_takes_time_in_proportion():
    import time

    for odd in ("<svg ", "<script", "<!--", "<a '", "<p \""):
        began = time.perf_counter()
        html_extract.content([odd * (400_000 // len(odd))])
        assert time.perf_counter() - began < 10, odd


def test_html_content_by_labels(spark):
    """Pages made of paragraphs, menus, teasers and footers whose words tell which they are: precision and recall by words."""
    rng = np.random.default_rng(7)
    say = lambda mark, n: " ".join(f"{mark}{rng.integers(1000)}" for _ in range(n))
    kept = right = all_ = 0
    for _ in range(60):
        menu = "".join(f"<li><a href='#'>{say('nav', int(rng.integers(1, 4)))}</a></li>" for _ in range(rng.integers(3, 9)))
        body = f"<h1>{say('text', int(rng.integers(4, 10)))}</h1>" + "".join(f"<p>{say('text', int(rng.integers(25, 120)))}</p>" for _ in range(rng.integers(2, 8)))
        text, _, _ = html_extract.content([f"<html><head><title>nav</title></head><body><ul>{menu}</ul><div>{body}</div><div class=f>{say('foot', int(rng.integers(5, 15)))}</div></body></html>"])
        words = text[0].split()
        kept, right, all_ = kept + len(words), right + sum(w.startswith("text") for w in words), all_ + body.count("text")
    assert right >= 0.95 * kept and right >= 0.95 * all_


def test_licenses_close_together(spark):
    line = "All rights reserved."
    rows = [(1, f"{line} {line}"), (2, " ".join([line] * 5)), (3, f"a {line} b c {line}"), (4, line), (4, line), (5, f"x {line} " + license_scan.TEMPLATES["Zlib"]), (6, None), (None, line)]
    got = collections.Counter((r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    name = "all-rights-reserved"
    assert got == {(1, name): 2, (2, name): 5, (3, name): 2, (4, name): 1, (5, name): 1, (5, "Zlib"): 1}


def test_rules_keep_clean_text():
    clean = " ".join(f"term{k * 7919 % 9973}" for k in range(400))
    assert quality_rules.kept(pa.array([clean, "spam ham " * 100, "line one\n" * 50, "", None])).tolist() == [True, False, False, False, False]


def test_pipeline_stage_by_stage(spark):
    """run() against each stage's own SQL or brute force on what the stage before kept."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = p.quality(spark, docs, FOLDER).cache()
    kept = {r.doc_id for r in quality_rules.quality_report(docs).filter("keep").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    one = p.near_duplicates(spark, good, FOLDER).cache()
    con = duckdb.connect()
    con.register("documents", good.toPandas())
    gone = {k for k, first, _ in con.execute(registered.oracle_sql()["op10_ngram_jaccard_join"]).fetchall() if k != first}
    assert {r.doc_id for r in one.collect()} == kept - gone
    cut = p.repeats(spark, one, FOLDER).cache()
    assert suffix_dedup.repeat_spans(cut).filter("kind = 'drop'").count() == 0
    mixed = p.mixture(spark, cut, FOLDER).cache()
    assert cut.columns == docs.columns == mixed.columns
    copies = {r.doc_id: r.copies for r in mixing.copies(cut).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    out = p.run(spark, FOLDER)
    assert sorted((r.doc_id, r.tokens) for r in out.select("doc_id", "tokens").collect()) == sorted((r.doc_id, r.tokens) for r in bpe.encode(mixed).select("doc_id", "tokens").collect())
