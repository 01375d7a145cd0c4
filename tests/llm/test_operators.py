"""Each operator against a brute-force version or the library it follows, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from stylecast.llm import bpe, chat, components, decontaminate, jaccard, licences, lines, pii, quality, queries, substrings, tokens  # noqa: E402

ODD = [(1, None, "en", None, 0), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 3), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (None, "two words", "en", "s", 9), (5, "日本 😀 <|endoftext|> é\x1c", "ja", "t", 9), (6, "x" * 70_000, "en", "t", 70_000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, hash string, n string, id string, place string"


@pytest.fixture
def odd(spark):
    """Nulls, empties, a very long text, a repeated row, and extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in ODD], SCHEMA)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def mixed(seed, pool, n, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(pool) for _ in range(rnd.randrange(most))) for _ in range(n)]


def test_token_counts(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = mixed(1, ["a", "the ", "  ", "▁", "é", "日本", "😀", "<s>", "\n", "ing", "aaaa", "=====", "<0x0A>", "ll"], 400, 40)
    got = {r.doc_id: r for r in tokens.token_counts(frame(spark, texts), path).collect()}
    assert [got[k].n_tokens for k in range(len(texts))] == [len(lib.encode(t)) for t in texts]
    model = tokens.merges(path)
    rnd = random.Random(11)
    letters = ["".join(rnd.choice(p) for _ in range(n)) for p in ("l", "le", "=-", "abcdefghijklmnopqrstuvwxyz", "日本語中文の", "0123456789abcdef", "an") for n in (7, 60, 250, 300, 3000)]
    assert model.count(letters).tolist() == [len(lib.encode(t)) for t in letters]
    for pool in ("l", "etaoinshrdlu"):
        text = "".join(rnd.choice(pool) for _ in range(100_000))
        start = time.time()
        n = model.count([text])[0]
        assert time.time() - start < 5 and n == len(lib.encode(text))
    rows = tokens.token_counts(odd, path, limit=5).collect()
    assert len(rows) == len(ODD) and tokens.token_counts(odd.limit(0), path).count() == 0
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(1, 0, 0), (2, 0, 0)}
    assert all(r.over_limit == (r.n_tokens > 5) for r in rows)


def test_what_workers_remember_is_bounded_in_bytes(monkeypatch):
    """Text without blanks, indented text and many different words: results stay right, what is held stays small."""
    import sentencepiece
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "HELD_BYTES", 1 << 18)
    monkeypatch.setattr(bpe, "HELD_BYTES", 1 << 18)
    rnd = random.Random(31)
    unspaced = ["".join(rnd.choice("日本語中文字漢書") for _ in range(2000)) for _ in range(150)]
    indented = ["\n".join("    " * rnd.randrange(1, 5) + f"x{rnd.randrange(10**6)} = {rnd.randrange(10**6)}" for _ in range(150)) for _ in range(60)]
    words = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(300)) for _ in range(60)]
    piece, byte = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
    model, coder = tokens.PieceMerges(piece), bpe.TreeCoder(byte)
    pieces, lib = sentencepiece.SentencePieceProcessor(model_file=piece), Tokenizer.from_file(byte)
    for texts in (unspaced, indented, words):
        for i in range(0, len(texts), 10):
            part = texts[i : i + 10]
            assert model.count(part).tolist() == [len(pieces.encode(t)) for t in part]
            assert [x.tolist() for x in coder.encode(part)] == [lib.encode(t, add_special_tokens=False).ids for t in part]
            # the bound, and what ten texts may add before it is looked at again
            assert model.held < (1 << 18) + (1 << 20) and coder.held < (1 << 18) + (1 << 20)
            assert sum(map(len, model.cost)) * 4 < model.held + 1 and sum(map(len, coder.known)) < coder.held + 1
    assert all(len(p) <= tokens.HELD_CHARS for p in model.cost) and all(len(u) <= bpe.HELD_CHARS for u in coder.known)


def test_bpe_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = mixed(2, ["a", "the", "   ", " ", "é", "日本", "😀", "<|endoftext|>", "<|endof", "text|>", "\n", "'s", "'re", "'", "ll", "!!", "123", "aaaa"], 300, 60)
    c = bpe.coder(path)
    for part in (1, 3, 17):
        assert [x.tolist() for x in c.encode(texts, part)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    rows = {r.doc_id: r for r in bpe.round_trip(odd, path, spread_chars=1000).collect()}
    for doc_id, text, *_ in ODD:
        e = lib.encode(text or "", add_special_tokens=False)
        r = rows[doc_id]
        assert r.n_tokens == len(e.ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(odd.limit(0), path).count() == 0
    ids = bpe.encoded(odd, path, spread_chars=1000)
    assert {(r.text or "") == r.decoded for r in bpe.decoded(ids, path).collect()} == {True}


def test_bpe_gives_the_library_each_distinct_word_once():
    """Words with different signs, digits and line breaks beside them: they are looked up without these."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, given = Tokenizer.from_file(path), []

    class Counting:
        def encode(self, text, **more):
            given.append(len(text))
            return lib.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            given.extend(map(len, texts))
            return lib.encode_batch_fast(texts, **more)

    words = ["".join(random.Random(k).choice("abcdefgh") for _ in range(12)) for k in range(40)]
    text = " ".join(w + x for x in (*".,;:!?)*$%&|<>", "...", "1", "2", "3", "'s", ".\nThe") for w in words)
    c = bpe.TreeCoder(path)
    c.lib = Counting()
    assert c.encode([text], len(text))[0].tolist() == lib.encode(text, add_special_tokens=False).ids
    assert sum(given) < len(text) / 5


def test_bpe_units_end_where_pretokens_do():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, c = Tokenizer.from_file(path), bpe.TreeCoder(path)
    blanks = [" ", " ", "  ", "\n", "\n", "\n\n", "\r\n", "\t", "\v", "\f", "\x1c", "\x1f", "\x00", "\x7f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u202f", "\u205f", "\u3000", "\ufeff"]
    others = ["a", "The", "é", "ª", "日", "。", "ሴ", "😀", "e\u0301", "٣", "1", "42", "'", "'s", "'ll", "'S", ".", "$$$", "<", "<|endoftext|>", "<|endof", "text|>", "w" * 70]
    texts = mixed(5, blanks + others, 3000, 12) + mixed(6, [" ", "\n", "a", ".", "é", "\xa0"], 3000, 9)
    expected = [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    for part in (1 << 12, 4):
        assert [x.tolist() for x in c.encode(texts, part)] == expected
    assert [c.encode([t])[0].tolist() for t in texts[::5]] == expected[::5]


def test_quality_figures(spark, odd):
    texts = mixed(3, ["a", "b ", " ", "\n", "a b c d e ", "é", "#", "日本 ", " ", "x\n"], 400, 40)

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)

    docs = frame(spark, texts).selectExpr("*", "'s' AS source")
    got = {r.doc_id: tuple(r[c] for c in quality.FIGURES) for r in quality.figures(docs, "doc_id", "text", "source").collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    rows = quality.judged(odd).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows)
    assert quality.judged(odd.limit(0)).count() == 0


def test_hosts_habits_reject(spark):
    clean, junk = " ".join(f"word{k}" for k in range(60)), " ".join(f"w{k}###" for k in range(60))
    rows = [(k, junk if k % 2 else clean, "bad") for k in range(40)] + [(100 + k, clean, f"h{k % 5}") for k in range(60)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {k for k, v in got.items() if not v} == {k for k in range(40) if k % 2}


def test_personal_data(spark, odd):
    def brute(t):
        out = []
        for kind, rx in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in re.finditer(rx, t):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii._luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                    out.append((m.start(), m.end(), kind))
        return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))

    for t in mixed(4, ["a", "@", "b.c", ".", " ", "-", "+", "1", "22", "333.", "(4)", "4381893557741609", "256", "x@y.z", "é"], 5000, 25):
        assert pii.spans(t)[0] == brute(t)
    for t, part in (("write john [at] mail (dot) example (dot) com", "john [at] mail (dot) example (dot) com"), ("jоhn@exаmple.com", "jоhn@exаmple.com"), ("call plus one three one zero five five five four five one zero", "plus one three one zero five five five four five one zero"), ("４３８１ ８９３５ ５７７４ １６０９", "４３８１ ８９３５ ５７７４ １６０９")):
        assert [t[s:e] for s, e, _ in pii.spans(t)[1]] == [part]
    assert pii.spans("look at the dot on it, one two three")[1] == []
    assert len(pii.personal_data(odd).collect()) == len(ODD)


def test_decontamination(spark, odd):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((40, 30, 6, 20))] + [(9, None), (10, "")]
    w = items[0][1].split()
    w[17] = "changed"
    texts = {1: " ".join([word() for _ in range(50)] + w), 2: "x " + items[1][1].upper() + " y", 3: " ".join(word() for _ in range(200)), 4: " ".join([word(), items[2][1], word()]), 5: " ".join(items[3][1].split()[:4])}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 0): 39, (2, 1): 30, (4, 2): 6}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()}.isdisjoint({1, 2, 4})
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def overlaps_of(texts, items):
    """Pairs of document and item with the words that agree, by brute force: every alignment of both."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    out = {}
    for i, t in texts:
        for j, u in items:
            a, b, matched = split(t), split(u), 0
            need = math.ceil(len(b) * 0.75) if len(b) < 10 else min(13, math.ceil(len(b) / 2))
            for shift in range(-len(b) + 1, len(a)):
                agreed = [k for k in range(len(b)) if 0 <= k + shift < len(a) and a[k + shift] == b[k]]
                before = [4 * p - 3 * k for p, k in enumerate(agreed)]
                stretches = []
                for p, k in enumerate(agreed):
                    if p and max(before[p:]) + 1 >= min(before[:p]):
                        stretches[-1].append(k)
                    else:
                        stretches.append([k])
                matched += sum(len(s) for s in stretches if len(s) >= min(8, need))
            if b and min(matched, len(b)) >= need:
                out[i, j] = min(matched, len(b))
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontamination_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 5, 8, 12, 20, 30, 40))]
    texts = []
    for k in range(40):
        w = [word() for _ in range(rnd.randrange(20))]
        for _ in range(2):
            part = rnd.choice(items)[1].split()
            a = rnd.randrange(len(part))
            part = part[a : a + rnd.randrange(3, 40)] if rnd.random() < 0.5 else part
            w += [word() if rnd.random() < 0.12 else x for x in part] + [word() for _ in range(rnd.randrange(12))]
        texts.append((k, " ".join(w)))
    docs = spark.createDataFrame([*texts, texts[0], (None, texts[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[0], (None, "x y z")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == overlaps_of(texts, items) and len(got) > 20


def test_decontamination_tells_stretches_apart(spark):
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    item, item2 = [word() for _ in range(60)], [word() for _ in range(40)]
    # words 1-15 and 46-60 with others between; and 15 words with the item's 30th at its place
    texts = [item[:15] + [word() for _ in range(30)] + item[45:], item2[:15] + [word() for _ in range(14)] + item2[29:30] + [word() for _ in range(20)], item[:8] + [word() for _ in range(9)]]
    docs = frame(spark, [" ".join(t) for t in texts])
    for more in ([], [(2, item2[29]), (3, " ".join(item2[28:30]))]):  # other items change nothing
        bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(item2)), *more], "item_id long, text string")
        got = {(r.doc_id, r.item_id): (r.n_matched, r.first_word, r.last_word) for r in decontaminate.contaminated(docs, bench).where("item_id < 2").collect()}
        assert got == {(0, 0): (30, 0, 59), (1, 1): (15, 0, 14)}


def test_decontamination_finds_all_substitutions(spark):
    for masks, cases in ((decontaminate.MASKS, [(10, 2), (12, 3), (16, 4), (20, 5), (24, 6)]), (("111", "1101", "1011"), [(3, 0), (4, 1), (5, 1), (6, 1), (7, 1), (8, 2), (9, 2), (10, 2)])):
        placed = lambda n: [sum(1 << (k + i) for i, c in enumerate(m) if c == "1") for m in masks for k in range(n - len(m) + 1)]  # noqa: B023, E731
        for n, wrong in cases:
            at = placed(n)
            assert all(any(not p & q for q in at) for p in (sum(1 << i for i in c) for c in itertools.combinations(range(n), wrong)))
    rnd = random.Random(16)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    lengths = [*range(1, 30), 60]
    items = {k: [word() for _ in range(n)] for k, n in enumerate(lengths)}
    docs, want = [], {}
    for k, words in items.items():
        for _ in range(12):
            w = list(words)
            for i in rnd.sample(range(len(w)), len(w) // 4):
                w[i] = word()
            want[len(docs), k] = len(w) - len(w) // 4
            docs.append(" ".join([word(), word(), *w, word()]))
    want[len(docs), 29] = 50  # every sixth word
    docs.append(" ".join(word() if i % 6 == 5 else x for i, x in enumerate(items[29])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert found.keys() == want.keys() and all(want[k] - found[k] < 8 for k in want)


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 1, "assistant", "yo"), (4, None, None, None), (None, 0, "user", "lost"), (5, 0, "user", "hi"), (5, 1, "assistant", "other")]
    pdf = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", pdf)
    want = sorted(con.execute(chat.CHAT_SQL).fetchall())
    assert sorted(tuple(r) for r in chat.rendered(df).collect()) == want
    assert [r[0] for r in want] == [1, 4, 5]
    assert chat.rendered(df.limit(0)).count() == 0


def licences_of(texts, templates, threshold):
    """Own licences by brute force: every section against every template."""
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    df = Counter(w for _, t in texts for w in set(words(t)))
    idf = lambda w: math.log((len(texts) + 1) / (df[w] + 1)) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for i, t in texts:
        inked = [x for x in t.split("\n") if words(x)]
        parts = [words(x) for x in (*inked, *(b for b in re.split(r"\n[ \t\r]*\n", t) if "\n" in b), " ".join(inked[:20]), t)]
        for v in map(vector, parts):
            for name, notice in templates:
                n = vector(words(notice))
                score = sum(x * n.get(w, 0) for w, x in v.items()) / (norm(v) * norm(n)) if v else 0
                if score >= threshold:
                    out[i] = min(out.get(i, (0, "")), (-round(score, 6), name))
    return {i: (name, -score) for i, (score, name) in out.items()}


def test_licences(spark, odd):
    wrapped = "# Licensed under the\n# Apache License,\n# Version 2.0\n\ncode follows here\n" + "more prose " * 40
    mit = next(n for k, n in licences.TEMPLATES if k == "MIT" and len(n) > 100)
    rows = [(1, mit, "a/b/LICENSE"), (2, "some text\nof prose", "a/b/c/x"), (3, "prose about nothing much at all", "z/x"), (4, wrapped, "a/b/y"), (5, None, None), (6, "Copyright\n" + mit[: len(mit) * 3 // 4] + "\n" + "much prose in one place\n" * 60, "a/q/f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.licence, r.origin, r.licence_dir) for r in licences.scanned(df, licences.template_table(spark)).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "a/b"), 3: (None, None, None), 4: ("Apache-2.0", "own", None), 5: (None, None, None), 6: ("MIT", "own", None)}
    rnd = random.Random(12)
    pool = [w for _, n in licences.TEMPLATES for w in n.split()][:400] + ["prose"] * 50
    texts = [(k, "\n".join(rnd.choice([" ".join(rnd.choice(pool) for _ in range(rnd.randrange(8))), rnd.choice(licences.TEMPLATES)[1][: rnd.randrange(20, 120)], ""]) for _ in range(rnd.randrange(1, 9)))) for k in range(60)]
    got = {r.doc_id: (r.licence, r.score) for r in licences.own_licences(frame(spark, [t for _, t in texts]), licences.template_table(spark)).collect()}
    want = licences_of(texts, licences.TEMPLATES, licences.THRESHOLD)
    assert got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 2e-6 for k in got)
    assert licences.scanned(odd.selectExpr("*", "source AS path"), licences.template_table(spark)).count() == len(set(ODD))
    assert licences.scanned(df.limit(0), licences.template_table(spark)).count() == 0


def test_licence_files(spark):
    """Full texts of licences make their directories inherit, also where they are wrapped anew or quote other licences' notices."""
    rows, prose = [], "the rest of this work is prose about the sea and the ships that may go to it under any wind\n"
    for k, (name, text) in enumerate(licences.FULL_TEXTS):
        anew = re.sub(r"\n(?!\n)", " ", text) if k % 2 else "Copyright 2020 by the authors\n\n" + text
        rows += [(10 * k, anew, f"{name}/COPYING"), (10 * k + 1, prose * (k + 1), f"{name}/src/deep/code"), (10 * k + 2, prose, f"{name}x/code")]
    rows.append((1000, prose * 2000, "z/long"))
    v2 = next(n for k, n in licences.TEMPLATES if k == "GPL-2.0")
    rows.append((1001, "ships\n\n" + v2.replace(". ", ".\n") + "\n\n" + prose * 50, "z/header"))
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.licence, r.origin, r.licence_dir) for r in licences.scanned(df, licences.template_table(spark)).collect()}
    for k, (name, _) in enumerate(licences.FULL_TEXTS):
        assert got[10 * k] == (name, "own", None)
        assert got[10 * k + 1] == (name, "inherited", name)
        assert got[10 * k + 2] == (None, None, None)
    assert got[1000] == (None, None, None) and got[1001] == ("GPL-2.0", "own", None)


def test_licence_sql(spark, tmp_path):
    """The query and its SQL on pages that hold full licence texts, and on documents."""
    apache, gpl = (dict(licences.FULL_TEXTS)[k] for k in ("Apache-2.0", "GPL-2.0"))
    pages = [(1, "https://a.org/x/LICENSE", f"<pre>{apache}</pre>"), (2, "https://a.org/x/y/z.html", "<p>prose of ships</p>"), (3, "https://b.org/COPYING", gpl), (4, "https://b.org/q/r", "<b>more prose</b>"), (5, None, None), (6, "https://c.org/", "<p>licensed under the mit license</p>")]
    docs = [(1, "licensed under cc by 4.0\n" + "prose " * 50), (2, gpl), (3, None), (4, "ships")]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(pages, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "t/pages.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").toPandas().to_parquet(tmp_path / "t/documents.parquet")
    con = duckdb.connect()
    for name in ("pages", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/t/{name}.parquet'")
    key = lambda r: tuple(map(str, r))
    want = con.execute(f"SELECT table_name, id, licence, score, origin, licence_dir FROM ({licences.licence_sql()})").fetchall()
    got = [tuple(r) for r in queries.op6_licence_scan(spark, str(tmp_path / "t")).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {(r[1], r[2]) for r in got if r[4] == "inherited"} == {(2, "Apache-2.0"), (4, "GPL-2.0")}


@pytest.mark.parametrize("together", [32, 3])
def test_line_dedup(spark, monkeypatch, together):
    monkeypatch.setattr(lines, "MOST_TOGETHER", together)
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(21, 26))) for _ in range(10)]

    def near(s):
        b = list(s)
        for _ in range(rnd.randrange(3)):
            p = rnd.randrange(len(b))
            b[p : p + rnd.randrange(2)] = rnd.choice(["", "x", "y"])
        return "".join(b)

    texts = ["\n".join(near(rnd.choice(base)) if rnd.random() < 0.8 else "short" for _ in range(rnd.randrange(6))) for _ in range(150)] + [None, ""]
    pdf = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", pdf)
    want = sorted(con.execute(f"SELECT doc_id, text, n_lines, n_dropped FROM ({lines.LINES_SQL})").fetchall())
    got = sorted(tuple(r) for r in lines.deduplicated(frame(spark, texts)).select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert got == want and sum(r[3] for r in got) > 50


def test_line_dedup_on_odd_rows(spark, odd):
    rows = lines.deduplicated(odd).collect()
    assert len(rows) == len(ODD) and {r.n_dropped for r in rows} == {0}


def components_of(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    full = sorted(i for i in sets if sets[i])
    for k, a in enumerate(full):
        for b in full[k + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block, dense", [(1024, 4), (5, 0)])
def test_jaccard_join(spark, monkeypatch, block, dense):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    rnd = random.Random(7)
    base = [[rnd.choice("ab cd ef gh ij kl mn op qr st".split()) for _ in range(rnd.randrange(3, 60))] for _ in range(15)]
    texts = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = rnd.choice(["ZZ", "Yy", "ab"])
        texts.append((i, " ".join(w)))
    texts += [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ONE"), (505, "a b c d"), (506, "A B c d")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == components_of(texts)
    assert {r.doc_id for r in jaccard.representatives(df).collect()} == {c for _, c in got.values()}


def test_jaccard_on_odd_rows(spark, odd):
    assert jaccard.near_duplicates(odd).count() == len(ODD)
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("rows, most", [(10_000, 1 << 16), (3, 1 << 16), (3, 5)])
def test_jaccard_drops_sets_that_a_shingle_cannot_link(spark, rows, most):
    """Texts of different sizes with sentences in common: those stay that may have a partner if the shingle is the first of both."""
    rnd = random.Random(17)
    sentences = [" ".join(f"s{rnd.randrange(500)}" for _ in range(8)) for _ in range(6)]
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 120))) + " " + " ".join(rnd.sample(sentences, rnd.randrange(4))) for _ in range(400)]
    texts += [t + " more" * k for t in texts[:40] for k in (1, 2)]
    data = [t.encode() for t in texts]
    keys, bounds = jaccard._sets(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum(list(map(len, data)))])
    first = {}
    for k, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
        for place, h in enumerate(keys[a:b][: (b - a) - ((b - a) * 80 + 99) // 100 + 1].view(np.int64).tolist()):
            first.setdefault(h, []).append((k, b - a, place))
    shared = {(h, x[0]) for h, group in first.items() if len(group) > 1 for x in group}
    linkable = {(h, x) for h, group in first.items() for (x, n, i), (y, m, j) in itertools.permutations(group, 2) if 180 * min(n - i, m - j) >= 80 * (n + m)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = jaccard._shared(jaccard.posts(frame(spark, texts).coalesce(1), np.zeros(0, np.uint64)), most).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {(r.h, r.id) for r in found}
    assert linkable <= got <= shared and len(found) == len(got)
    assert most == 5 or len(got - linkable) < len(shared - linkable) / 3


def test_components_of_a_chain(spark):
    links = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components.components(links).collect()} == {0}


def repeats_of(texts, most):
    """Spans of windows of so many words that have stood before, by brute force: (start, end, words) by id."""
    seen, out = {}, {}
    for i, t in sorted((i, (t or "").encode()) for i, t in texts):
        at = [(x.start(), x.end()) for x in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        again = [k for k in range(len(at) - most + 1) if seen.setdefault(t[at[k][0] : at[k + most - 1][1]], (i, k)) != (i, k)]
        spans = []
        for k in again:
            if spans and k < spans[-1][1]:
                spans[-1][1] = k + most
            else:
                spans.append([k, k + most])
        if spans:
            out[i] = [(at[a][0], at[b - 1][1], b - a) for a, b in spans]
    return out


def test_substring_dedup(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [prose(rnd.choice([50, 52, 55, 60, 70, 84])) for _ in range(60)]
    texts = []
    for i in range(300):
        w = prose(rnd.randrange(150))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            if rnd.random() < 0.4:  # parts that are too short, and that occur first elsewhere
                a = rnd.randrange(30)
                p = p[a : a + rnd.randrange(10, 60)]
            w += p + prose(rnd.randrange(60))
        texts.append((i, " ".join(w)))
    twice = prose(60)
    texts += [(1000 + i, texts[5][1]) for i in range(20)] + [(2000, " ".join(twice + ["é", "日本"] + twice))]
    df = spark.createDataFrame([*texts, texts[7], (None, texts[5][1])], "doc_id long, text string").repartition(3)
    got = {}
    for r in substrings.repeated_passages(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.n_words))
    want = repeats_of(texts, 50)
    assert {k: sorted(v) for k, v in got.items()} == want and len(want[2000]) == 1
    cut = {r.doc_id: r.text for r in substrings.deduplicated(df).collect() if r.doc_id is not None}
    for i, t in texts:
        data = t.encode()
        for start, end, _ in reversed(want.get(i, [])):
            data = data[:start] + data[end:]
        assert cut[i] == data.decode()


@pytest.mark.parametrize("kind", ["one letter", "one to three letters", "one character", "periods"])
def test_substring_dedup_of_short_words_and_periods(spark, kind):
    """Passages of 50 words and little more, of few bytes, and passages that repeat within themselves."""
    rnd = random.Random(9)
    letters = "日本語中文字漢書東西南北" if kind == "one character" else "abcdefghijklmnopqrstuvwxyz"
    most = 3 if kind == "one to three letters" else 1
    prose = lambda n: ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, most))) for _ in range(n)]
    passages = [prose(rnd.randint(50, 55)) for _ in range(100)]
    if kind == "periods":
        passages = [(prose(rnd.randint(1, 3)) * 90)[:90] for _ in range(100)]
    texts = [(k, " ".join(prose(rnd.randrange(5, 60)) + passages[k % 100] + prose(rnd.randrange(5, 60)))) for k in range(300)]
    got = {}
    for r in substrings.repeated_passages(frame(spark, [t for _, t in texts])).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.n_words))
    want = repeats_of(texts, 50)
    assert len(want) >= 200 and len(got) >= 0.99 * len(want)
    exact = [k for k, v in got.items() if sorted(v) == want[k]]
    if kind == "periods":  # where nothing but periods is cut, an end may lack a word that stands there by chance
        assert len(exact) >= 0.99 * len(got)
        assert all(any(s <= start and end <= e and words >= 0.95 * n for s, e, n in want[k]) for k, v in got.items() for start, end, words in v)
    else:
        assert len(exact) == len(got)


def test_substring_dedup_on_odd_rows(spark, odd):
    assert substrings.repeated_passages(odd).count() == 0
    assert sorted(map(str, substrings.deduplicated(odd).collect())) == sorted(map(str, odd.collect()))
    assert substrings.repeated_passages(odd.limit(0)).count() == 0
    words = " ".join(f"w{k}" for k in range(60))
    tied = spark.createDataFrame([(1, words), (1, words), (1, words + " x"), (2, "y " + words)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words) for r in substrings.repeated_passages(tied).collect()) == [(1, 60), (2, 60)]


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "Yes.\n\t\nno word above", "a"), (2, "Yes.\nYex.\n\t\n", "b"), (2, "Yes.\nYex.\n\t\n", "b"), (None, "Yes.", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in lines.deduplicated(df).collect())
    assert got == [(0, "Yes.", 1, 0), (1, "Yes.\n\t\nno word above", 3, 0), (2, "Yex.\n\t\n", 4, 1), (2, "Yex.\n\t\n", 4, 1)]
    assert lines.deduplicated(df.limit(0)).count() == 0


def test_the_sequences_of_a_step_fit_a_worker():
    import tracemalloc

    import numpy as np

    from stylecast.llm import tree_weighting as ctw

    data = np.random.default_rng(1).integers(1, 255, ctw.STEP, dtype=np.uint8)
    offsets = np.array([0, 5, 5, 1 << 20, ctw.STEP])
    tracemalloc.start()
    got, first = ctw.grams(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert first.tolist() == [0, 6, 7, (1 << 20) + 3]
    for i, j, at in zip(offsets[:-1], offsets[1:], first):
        line = bytes(ctw.DEPTH) + data[i:j].tobytes() + b"\xff"
        for k in {0, 1, 4, int(j - i) // 2, int(j - i)}:
            if k <= j - i:
                seen = line[k : k + ctw.DEPTH + 1]
                assert int(got[at + k]) == int.from_bytes(seen[:-1][::-1] + seen[-1:], "big")


def test_span_hashes_go_over_a_part_of_the_bytes_at_a_time():
    """A running sum over a whole step took some 25 times its bytes; spans longer than a part and spans out of order have the same hashes."""
    import tracemalloc

    import numpy as np

    from stylecast.llm import common

    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"abcdefG ", np.uint8), 1 << 22)
    data[1_000_000:1_400_000] = ord("x")
    starts, stops = common.word_spans(data, np.array([700, len(data)]))
    common.span_hashes(data, starts, stops, fold_case=True)  # so that the tables of powers are there
    tracemalloc.start()
    got = common.span_hashes(data, starts, stops, fold_case=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(starts) + (32 << 20)
    turned = np.arange(len(starts))[::-1]
    assert (common.span_hashes(data, starts[turned], stops[turned], fold_case=True)[turned] == got).all()
    assert len({(bytes(data[a:b]).lower(), h) for a, b, h in zip(starts.tolist()[:50_000], stops.tolist(), got.tolist())}) == len({bytes(data[a:b]).lower() for a, b in zip(starts.tolist()[:50_000], stops.tolist())})


def test_batches_are_bounded_in_bytes(spark):
    from stylecast.llm import common

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    rows = spark.range(40).coalesce(1).selectExpr("repeat('x', 1000000) AS text")
    assert common.written(rows.mapInArrow(sizes, "n long"), "sizes").agg({"n": "max"}).first()[0] < 1.2 * common.BATCH_BYTES
