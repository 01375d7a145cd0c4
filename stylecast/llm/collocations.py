"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, pieces into words.
Prefix polynomials over the words of a step of texts give the 64-bit fingerprint of every
n-gram by one subtraction.  Fingerprints, counted within the step, are shuffled with a second
fingerprint of 32 bits and added up by language.  Only phrases that are frequent are ever made
into text, from pointers to an occurrence of each.  These are looked for last: in the texts of
smallest hash, ``1 / FIRST_TEXTS`` of all, and, for phrases that aren't there, in all texts.

Lengths are counted one pass after the other: an n-gram is shuffled only if the shorter ones
in it are frequent, as it can't be frequent otherwise.  They are looked up in a filter of bounded
size, which lets through all frequent ones; what it lets through wrongly is counted and dropped.

Collisions: within a step, words of one hash are compared byte by byte and n-grams of one
fingerprint word by word; between steps, phrases of one fingerprint are told apart by the
second one, and what a pointer gives must have both fingerprints of its phrase.  Pointers are
to the text of smallest hash that has the phrase, so that few texts hold them all.

Defined cases: a null text is empty, a null language ``und``; repeated rows and whatever ids
count as texts of their own; ties are ranked by frequency, then by the phrase's bytes; empty
texts and tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import _power_tables, distinct_spans, ink_spans, mix, span_hashes, spread, steps, string_buffer, text_or_empty, written
from .keyset import found, key_filter

#: Lengths that each pass over the texts counts, and the length that must be frequent within them.
PASSES = (((1,), 0), ((2,), 1), ((3,), 2), ((4, 5), 3))
LEAST, TOP = 100, 2000
#: Bytes of text in a step of more than one text; pointers' texts that are broadcast (their hashes), others are joined by shuffling.
STEP, BROADCAST_TEXTS = 1 << 21, 1 << 20
#: The part of the texts in which pointers are looked for first, and bits a phrase in the filters of both turns.
FIRST_TEXTS, POINTER_BITS = 32, (1 << 7, 1 << 12)
#: What ends a piece, and what stands between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_END, _INK = np.zeros(256, bool), np.ones(256, bool)
_END[list(ENDS)] = True
_INK[list(ENDS + BLANKS)] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_SECOND = np.random.default_rng(20250702).integers(1, 2**63, 256, np.int64).astype(np.uint64)


def _lang_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class _Step:
    """Words of a step of texts, and fingerprints of its n-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: str) -> None:
        data = _FOLD[data]
        self.starts, self.stops = ink_spans(_INK[data], offsets[1:])
        hashes = span_hashes(data, self.starts, self.stops, fold_case=False)
        first, self.word = distinct_spans(data, self.starts, self.stops, hashes)
        lengths = (self.stops - self.starts)[first]
        blob, ends = data[spread(self.starts[first], lengths)], np.cumsum(lengths)
        up, down = _power_tables(max(len(blob), len(hashes)) + 1)
        run = np.r_[np.uint64(0), np.cumsum(_SECOND[blob] * up[: len(blob)], dtype=np.uint64)]
        second = mix((run[ends] - run[ends - lengths]) * down[ends - lengths] ^ ends.astype(np.uint64) - (ends - lengths).astype(np.uint64))
        self.runs = [np.r_[np.uint64(0), np.cumsum(x[self.word] * up[: len(self.word)], dtype=np.uint64)] for x in (hashes[first], second)]
        self.down, self.key = down, _lang_key(lang)
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        self.piece = np.cumsum(_END[data])[self.starts] + self.text  # neither ever falls, so equal sums mean one text and one piece
        self.offsets = offsets

    def prints(self, n: int, which: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """Fingerprints of the n-grams that begin at each word, or at the words given."""
        run, m = self.runs[which], max(0, len(self.word) - n + 1)
        raw = (run[n : n + m] - run[:m]) * self.down[:m] if at is None else (run[at + n] - run[at]) * self.down[at]
        return mix(raw + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) ^ self.key

    def grams(self, n: int) -> np.ndarray:
        """The words at which an n-gram begins that lies within a piece."""
        m = max(0, len(self.word) - n + 1)
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1 : n - 1 + m])

    def counted(self, n: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the n-grams that begin at these words: fingerprint, second one, how often, first word."""
        h = self.prints(n, 0, at)
        _, first, of, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        rep = at[first]
        if not all(np.array_equal(self.word[at + k], self.word[rep + k][of]) for k in range(n)):
            _, first, count = np.unique(np.stack([self.word[at + k] for k in range(n)], 1), axis=0, return_index=True, return_counts=True)
            rep = at[first]
        return self.prints(n, 0, rep), self.prints(n, 1, rep).astype(np.uint32), count, rep


#: The fingerprints hold the language, which the text of the pointer has itself.
ROWS, POINTERS = "n int, h long, h2 int, f long", "n int, h long, h2 int, text_key long, place long"


def _over_steps(texts: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow over steps of texts of one language, those of smallest hash first: make(step, text hashes) gives arrays (n, h, h2, ..)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def of_lang(lang, part):
            keys = part.column(1).to_numpy()
            order = np.argsort(keys, kind="stable")  # so that the first occurrence is in the text of smallest hash
            part, keys = part.take(pa.array(order)), keys[order]
            data, offsets = string_buffer(part.column(2))
            for i, j in steps(offsets, STEP):
                own = offsets[i : j + 1]
                step = _Step(data[own[0] : own[-1]], own - own[0], lang)
                if not len(step.word):
                    continue
                for n, h, h2, *others in make(step, keys[i:j]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(h2.view(np.int32)), *(pa.array(x.astype(np.int64)) for x in others)], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            langs = pc.dictionary_encode(batch.column(0))
            code = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                yield from of_lang(lang, batch.take(pa.array(np.flatnonzero(code == k))))

    return texts.mapInArrow(run, schema)


def _counted(texts: DataFrame, lengths: tuple[int, ...], within: int, parents) -> DataFrame:
    """Each step's n-grams of these lengths, if all shorter ones of length ``within`` are in the filter; n = 0: all words of the step."""

    def count(step, keys):
        if 1 in lengths:
            yield 0, np.array([step.key]), np.zeros(1, np.uint32), np.array([len(step.word)])
        if within:
            parent = found(parents.value, step.prints(within))
        for n in lengths:
            at = step.grams(n)
            for k in range(n - within + 1) if within else ():
                at = at[parent[at + k]]
            if len(at):
                yield n, *step.counted(n, at)[:3]

    return _over_steps(texts, count, ROWS)


def _occurrences(texts: DataFrame, wanted) -> DataFrame:
    """An occurrence within each step of the n-grams in the filter; n = 0: a text of the step."""

    def point(step, keys):
        yield 0, np.array([step.key]), np.zeros(1, np.uint32), keys[:1], np.zeros(1, np.int64)
        for n in range(1, max(PASSES[-1][0]) + 1):
            at = step.grams(n)
            at = at[found(wanted.value, step.prints(n, 0, at))]
            if len(at):
                h, h2, _, rep = step.counted(n, at)
                begin = step.offsets[step.text[rep]]
                yield n, h, h2, keys[step.text[rep]], (step.starts[rep] - begin) << 31 | step.stops[rep + n - 1] - step.starts[rep]

    return _over_steps(texts, point, POINTERS)


def _pointed(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """The phrases (n, h, h2, f) with text_key, place: an occurrence in the text of smallest hash that has one."""
    done, missing = None, phrases
    for few, bits in zip((True, False), POINTER_BITS, strict=True):
        part = texts.where(F.col("text_key") < -(1 << 63) + (1 << 64) // FIRST_TEXTS) if few else texts
        at = _occurrences(part, key_filter(missing, per_key=bits)).groupBy("n", "h", "h2").agg(F.min("text_key").alias("text_key"), F.min_by("place", "text_key").alias("place"))
        here = written(missing.join(at, ["n", "h", "h2"], "left"), "pointed")
        found_ = here.where(F.col("text_key").isNotNull())
        done = found_ if done is None else done.unionByName(found_)
        missing = here.where(F.col("text_key").isNull()).drop("text_key", "place")
        if missing.isEmpty():
            break
    return done


def _agrees(rows: DataFrame) -> DataFrame:
    """The rows, after both fingerprints of each phrase were taken again from its text."""

    def verify(batches):
        for batch in batches:
            for lang, phrase, n, h, h2 in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "n", "h", "h2")), strict=True):
                if not n:
                    continue
                data = np.frombuffer(phrase.encode(), np.uint8)
                step = _Step(data, np.array([0, len(data)]), lang)
                if len(step.word) != n or step.prints(n).view(np.int64)[0] != h or step.prints(n, 1).astype(np.uint32).view(np.int32)[0] != h2:
                    raise ValueError(f"the text {phrase!r} doesn't have the fingerprint that points to it")
            yield batch

    return rows.mapInArrow(verify, rows.schema)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """lang, n, phrase, f: all phrases of 1 to 5 words that occur so often; n = 0: all words of a language, whose phrase is null."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    texts = texts.select("lang", F.xxhash64("lang", "text").alias("text_key"), "text")
    levels, parents = [], None
    for lengths, within in PASSES:
        sums = _counted(texts, lengths, within, parents).groupBy("n", "h", "h2").agg(F.sum("f").alias("f"))
        levels.append(written(sums.where((F.col("f") >= least) | (F.col("n") == 0)), "phrases"))
        parents = key_filter(levels[-1].where(F.col("n") == max(lengths)))
    all_ = _pointed(reduce(DataFrame.unionByName, levels), texts)
    pointed = all_.groupBy("text_key").agg(F.collect_list(F.struct("n", "h", "h2", "f", "place")).alias("places"))  # of one text
    pointed = written(pointed, "pointers")
    keys = pointed.select("text_key")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_TEXTS else keys
    sources = texts.join(keys, "text_key", "left_semi").dropDuplicates(["text_key"]).select("text_key", "lang", F.col("text").cast("binary").alias("bytes"))
    fold = "translate(decode(substring(bytes, cast(shiftright(p.place, 31) + 1 AS int), cast(p.place & 2147483647 AS int)), 'UTF-8'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    made = sources.join(pointed, "text_key").select("lang", F.explode(F.expr(f"transform(places, p -> struct(p.n, p.h, p.h2, p.f, regexp_replace({fold}, '[ \\\\t]+', ' ') AS phrase))")).alias("p")).select("lang", "p.*")
    return _agrees(made).select("lang", "n", F.when(F.col("n") > 0, F.col("phrase")).alias("phrase"), "f")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two words and more."""
    table = written(frequent_phrases(docs, text_col, lang_col, least), "frequent")
    words = table.where(F.col("n") == 0).select("lang", F.col("f").alias("n"))
    known = table.where(F.col("n") > 0).select("lang", "phrase", "f")
    candidates = table.where(F.col("n") >= 2).select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = candidates.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') AS left_part, array_join(slice(w, k + 1, size - k), ' ') AS right_part))")).alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l")), ["lang", "left_part"]).join(known.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r")), ["lang", "right_part"])
    big = "CAST({} AS decimal(19, 0))".format
    cuts = cuts.join(words, "lang").withColumn("score", F.expr(f"({big('a')} * {big('n')} * 1000) div ({big('l')} * {big('r')})"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")

    inside = candidates.where("size > 2").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    scored = scored.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_GRAMS = "\n UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM p WHERE len(w) >= {n})" for n in range(1, 6))
COLLOCATIONS_SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
k AS (SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, a, n, k, x.f AS l, y.f AS r, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM k JOIN total USING (lang)
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(list_slice(k.w, 1, k), ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(list_slice(k.w, k + 1, k.size), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, a, w, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2)),
d AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longer FROM m GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b LEFT JOIN d USING (lang, phrase) WHERE longer IS NULL OR longer < a QUALIFY rank <= {TOP}"""
