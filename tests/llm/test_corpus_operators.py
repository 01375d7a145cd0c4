"""Collocations, source divergence and context-tree weighting against brute force and SQL, and on odd rows."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from stylecast.llm import collocations, common, divergence, keyset, tree_weighting

ODD = [(1, None, "en", None), (2, "", "en", "s"), (3, " \n\t ", None, "s"), (4, "one. One", "en", "s"), (4, "one. One", "en", "s"), (None, "two words", "en", "s"), (5, "日本 😀 É\x1c\x00", "ja", "t"), (6, "x" * 70_000 + " y" * 3000, "en", "t")]
SCHEMA = "doc_id long, text string, lang string, source string, key long, n long, h long, term string, value string, rank int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def odd(spark):
    """Nulls, empties, very long texts, a repeated row, and extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, 3, "a", "b", 4) for r in ODD], SCHEMA)


def corpus(spark, seed, n, words, langs=("en", "de", None), sources=("a", "b", None, "c"), ends=(" ", "  ", "\t", ". ", ", ", "\n", "\r")):
    rnd = random.Random(seed)
    rows = [(i, "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randrange(60))) if rnd.random() > 0.03 else None, rnd.choice(langs), rnd.choice(sources)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rows


def by_sql(sql, rows, least, was):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    return sorted(con.execute(sql.replace(f">= {was}", f">= {least}")).fetchall(), key=str)


WORDS = ["The", "the", "of", "New", "York", "ünï", "日本", "a1", "x-y", "zebra", "I", "#"]


def test_collocations_by_sql_and_brute_force(spark):
    docs, rows = corpus(spark, 1, 400, WORDS)
    got = sorted((tuple(r) for r in collocations.collocations(docs, least=12).collect()), key=str)
    assert len(got) > 100 and got == by_sql(collocations.COLLOCATIONS_SQL, rows, 12, collocations.LEAST)
    f, total = Counter(), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", " ".join(w[i : i + n])) for n in range(1, 6) for i in range(len(w) - n + 1))
    for lang, _, phrase, a, left, right, n, score in got:
        w = phrase.split(" ")
        cuts = [(1000 * a * total[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        k = min(cuts)[1]
        assert (a, n, score, left, right) == (f[lang, phrase], total[lang], min(cuts)[0], f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])])


def test_collocations_keep_numbers_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    rows = [("en", 0, None, 4 * big), ("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big)]
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: spark.createDataFrame(rows, "lang string, n int, phrase string, f long"))
    assert [r.score for r in collocations.collocations(None).collect()] == [4000]


def test_collocations_on_odd_rows(spark, odd):
    got = sorted((tuple(r) for r in collocations.collocations(odd, least=2).collect()), key=str)
    assert [r[2] for r in got] == ["y y", "y y y", "y y y y", "y y y y y"] and got == by_sql(collocations.COLLOCATIONS_SQL, ODD, 2, collocations.LEAST)
    assert collocations.collocations(odd.limit(0)).count() == 0


def test_collisions_are_told_apart():
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    starts, stops = common.word_spans(data, np.array([len(data)]))
    first, of = common.distinct_spans(data, starts, stops, np.zeros(4, np.uint64))
    assert len(first) == 3 and of.tolist() == [0, 1, 0, 2]


def test_key_filter(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    wanted = keyset.key_filter(spark.createDataFrame([(int(k),) for k in keys], "h long"))
    assert keyset.found(wanted.value, keys.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63, 20_000).view(np.uint64)
    assert keyset.found(wanted.value, other).mean() < 0.1
    assert not keyset.found(keyset.key_filter(spark.createDataFrame([], "h long")).value, other).any()


@pytest.mark.parametrize("tile", [256, 2])
def test_divergence_by_sql(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    docs, rows = corpus(spark, 2, 300, [*WORDS, "thereafter", "thereabouts", "extraordinarily", "extraordinary"], sources=("a", "b", None, "c", "é", "ze"))
    got = sorted((tuple(r) for r in divergence.divergence(docs).collect()), key=str)
    assert len(got) > 100 and got == by_sql(divergence.DIVERGENCE_SQL, rows, 10, 10)


def test_divergence_on_odd_rows(spark, odd):
    got = sorted((tuple(r) for r in divergence.divergence(odd, least_docs=2).collect()), key=str)
    assert got == by_sql(divergence.DIVERGENCE_SQL, ODD, 2, 10)
    assert divergence.divergence(odd.limit(0)).count() == 0


def test_kept_terms_are_those_of_enough_documents(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 40))) for _ in range(60)] + ["a" * n for n in (1, 2, 3, 4, 5, 8, 16, 17, 33)]
    docs, rows = corpus(spark, 4, 200, words)
    rows_ = common.written(divergence.postings(docs, "text", "lang", "source"), "test")
    got = {(r.lang, r.term): r.docs for r in divergence.kept_terms(rows_, 15).collect()}
    want = defaultdict(set)
    for i, text, lang, _ in rows:
        for t in re.findall("[a-zé]+", text or ""):
            want[lang or "", t].add(i)
    assert got == {k: len(v) for k, v in want.items() if len(v) >= 15}


def brute_trees(texts, depth):
    """log10 probability of each text by recursion over contexts as they are, with counts of the training texts."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def decisions(text):
        line = bytes(depth) + text.translate(LOW).encode() + b"\xff"
        for i in range(depth, len(line)):
            for b in range(8):
                yield line[i - depth : i][::-1], 1 << b | line[i] >> (8 - b), line[i] >> (7 - b) & 1

    for text, train in texts:
        for context, place, bit in decisions(text) if train else ():
            for d in range(depth + 1):
                counts[context[:d], place][bit] += 1
                if d:
                    kids[context[: d - 1], place].add(context[:d])

    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def log_w(context, place):
        if (context, place) not in memo:
            own = block(*counts[context, place])
            if len(context) == depth:
                memo[context, place] = own
            else:
                memo[context, place] = np.logaddexp(own, sum(log_w(k, place) for k in kids[context, place])) - math.log(2)
        return memo[context, place]

    def one(context, place, d):
        n0, n1 = counts.get((context[:d], place), (0, 0))
        guess = (n1 + 0.5) / (n0 + n1 + 1)
        if d == depth:
            return guess
        weight = math.exp(block(n0, n1) - math.log(2) - log_w(context[:d], place))
        return weight * guess + (1 - weight) * one(context, place, d + 1)

    return [sum(math.log10(p if bit else 1 - p) for c, place, bit in decisions(t) for p in [one(c, place, 0)]) for t, _ in texts]


def test_tree_weighting_by_brute_force(spark, monkeypatch):
    docs, rows = corpus(spark, 5, 60, WORDS)
    for common_ in (tree_weighting.COMMON, {0: 40, 1: 3}, {0: 0, 1: 0}):  # values that are broadcast, or joined
        monkeypatch.setattr(tree_weighting, "COMMON", common_)
        got = {r.doc_id: r for r in tree_weighting.scored(docs).collect()}
        train = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, *_ in rows}
        want = brute_trees([(t or "", train[i]) for i, t, *_ in rows], tree_weighting.DEPTH)
        assert all(math.isclose(got[i].score, s, rel_tol=1e-9) for (i, *_), s in zip(rows, want, strict=True))
        tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)), None] for i, t, *_ in rows}
        c = Counter(w for i in tokens if train[i] for w in tokens[i])
        n, v = sum(c.values()), len(c)
        for i, w in tokens.items():
            assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (not train[i], len(w), sum(c[x] > 0 for x in w), n)
            assert math.isclose(got[i].base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)


def test_tree_probabilities_sum_to_one(spark):
    docs, _ = corpus(spark, 6, 30, WORDS)
    texts = docs.selectExpr("text", "false AS held_out").na.fill("")
    table = tree_weighting.values(tree_weighting.corpus_counts(texts)).where("kind = 0")
    sums = defaultdict(float)
    for r in table.collect():
        sums[r.key >> 8] += 10**r.value
    assert len(sums) > 50 and max(sums.values()) < 1 + 1e-9
    assert any(s > 0.8 for s in sums.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_tree_weighting_beats_order_one_on_held_out_texts(spark):
    rows = tree_weighting.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.bits_per_byte * r.n_bytes for r in rows) / sum(r.n_bytes for r in rows) < 2.3


def test_tree_weighting_on_odd_rows(spark, odd):
    rows = tree_weighting.scored(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.held_out for r in rows if r.doc_id is None} == {False}
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert tree_weighting.scored(odd.limit(0)).count() == 0
    alone = tree_weighting.scored(odd.where("doc_id = 4").limit(1)).first()
    assert alone.n_tokens == 3


def test_tree_weighting_steps_are_small(spark):
    """What sorting a step's sequences takes, about twelve numbers of eight bytes a byte of text, has to fit beside another worker's."""
    import tracemalloc

    for step in (tree_weighting.STEP, tree_weighting.SCORE_STEP):
        data = np.random.default_rng(4).integers(97, 123, step).astype(np.uint8)
        tracemalloc.start()
        sequences, _ = tree_weighting.grams(data, np.array([0, step]))
        np.unique(sequences, return_inverse=step == tree_weighting.SCORE_STEP)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 << 20


@pytest.mark.parametrize("first", [2, 1 << 50])
def test_collocations_point_to_texts_in_two_turns(spark, monkeypatch, first):
    """Counts are shuffled without pointers; phrases that the first texts lack are looked for in all."""
    assert len(collocations.ROWS.split(", ")) == 4
    monkeypatch.setattr(collocations, "FIRST_TEXTS", first)
    docs, rows = corpus(spark, 6, 120, WORDS)
    got = sorted((tuple(r) for r in collocations.collocations(docs, least=8).collect()), key=str)
    assert got and got == by_sql(collocations.COLLOCATIONS_SQL, rows, 8, collocations.LEAST)


def test_divergence_steps_are_small():
    """A running sum over all of a step's bytes took 108 MB; over a part at a time the step takes 44 MB."""
    import tracemalloc

    data = np.random.default_rng(5).choice(np.frombuffer(b"abcdef  ", np.uint8), divergence.STEP)
    tracemalloc.start()
    divergence._step(data, np.linspace(0, len(data), 500).astype(np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 << 20
