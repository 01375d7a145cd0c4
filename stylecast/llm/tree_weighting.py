"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes (A-Z lower-cased) and an end.  A byte is eight binary decisions; each of
the 255 places in a byte where a decision is made has a tree of contexts, the 0 to ``DEPTH``
bytes before.  A node's estimate is Krichevsky and Trofimov's; its weighted probability is half
its own block probability and half the product of its children's, which mixes all depths.  The
block probability depends on counts alone, so the trees of a corpus follow from the counts of
its byte sequences of DEPTH + 1, which Spark adds up, and a byte's probability after training
depends on its DEPTH predecessors alone.

Counts are keyed with the latest context byte first, so that a subtree is a range of keys.
Nodes of ``SPLIT`` bytes and more are worked on by subtree: one has at most 256^(DEPTH - SPLIT + 1)
sequences.  What is above takes groupings and joins of the few contexts there are.

A text's score is a sum of values of its sequences.  The commonest ``COMMON`` of them, and the
commonest words for the base score, are broadcast; all others are joined by shuffling.

Training texts are those whose id doesn't fall to the held-out fold; they are scored by the same
model, which knows them.  Before a text stand DEPTH zero bytes.  Defined cases: a null or empty
text has the end only; a null id is the id ''; each row is scored by itself, repeated ones alike;
without training texts every decision has probability 1/2; an empty table gives an empty result;
other columns are ignored.  Words are told apart by 64-bit hashes.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import span_hashes, steps, string_buffer, text_or_empty, word_spans, written

DEPTH, SPLIT = 5, 3
FOLDS, FOLD = 5, 1
#: Sequences, and words, whose values are broadcast: 16 bytes each.
COMMON = {0: 1 << 20, 1: 1 << 18}
#: Bytes of text in a step that counts, and in one that scores, if it is more than one text.
STEP, SCORE_STEP = 1 << 21, 1 << 20
GRAM, WORD = 0, 1
#: The key of the token that ends each text.
END_WORD = 0x656E64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence at each byte and end of each text, c1 c2 .. x with the latest context byte first, and where each text's begin."""
    texts = len(offsets) - 1
    begin = offsets[:-1] + np.arange(texts) * (DEPTH + 1)  # each text stands between its zeros and its end
    inside = np.ones(len(data) + texts * (DEPTH + 1), bool)
    for k in range(DEPTH):
        inside[begin + k] = False
    ends = begin + DEPTH + np.diff(offsets)
    line = np.zeros(len(inside), np.uint8)
    inside[ends] = False
    line[inside] = data
    inside[ends] = True
    line[ends] = 0xFF  # no UTF-8 text has this byte
    where = np.flatnonzero(inside)
    out = np.empty(len(where), np.uint64)
    for i in range(0, len(where), 1 << 18):  # a part at a time: wide numbers of all bytes would take several times the result
        at = where[i : i + (1 << 18)]
        part = line[at].astype(np.uint64)
        for k in range(1, DEPTH + 1):
            part |= line[at - k].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
        out[i : i + len(at)] = part
    return out, offsets[:-1] + np.arange(texts)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops = word_spans(data, offsets[1:])
    return span_hashes(data, starts, stops, fold_case=False), np.searchsorted(offsets, starts, side="right") - 1


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == FOLD


def corpus_counts(texts: DataFrame) -> DataFrame:
    """kind, key, n: how often each sequence and word is in training texts; sequences of held-out texts too, with 0 if they aren't."""

    def count(batches):
        import pyarrow as pa

        def rows(kind, key, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            data, offsets = string_buffer(batch.column(1))
            held = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in steps(offsets, STEP):
                own = offsets[i : j + 1] - offsets[i]
                part, train = _FOLD[data[offsets[i] : offsets[j]]], ~held[i:j]
                g, first = grams(part, own)
                known = np.repeat(train, np.diff(np.r_[first, len(g)]))
                seen = np.unique(g[~known])
                key, n = np.unique(g[known], return_counts=True)
                del g, known
                yield rows(GRAM, key, n)
                new = np.setdiff1d(seen, key, assume_unique=True)
                yield rows(GRAM, new, np.zeros(len(new)))
                words, of = _words(part, own)
                key, n = np.unique(words[train[of]], return_counts=True)
                yield rows(WORD, np.r_[key, np.uint64(END_WORD)], np.r_[n, train.sum()])

    counted = texts.select("held_out", "text").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    return counted.where((F.col("kind") == GRAM) | (F.col("n") > 0))


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Of z >= 0.5, by Stirling's series at z + 8."""
    product = z.copy()
    for k in range(1, 8):
        product *= z + k
    y = z + 8
    r = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r / 12 - r**3 / 360 + r**5 / 1260 - r**7 / 1680 - np.log(product)


def log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of Krichevsky and Trofimov's probability of so many zeros and ones."""
    a, b = np.asarray(n0, float), np.asarray(n1, float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - 1.1447298858494002


def _subtrees(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Of whole subtrees of SPLIT bytes, keys in order: each sequence's eight probabilities of a one as far as the subtree has them, and its topmost nodes' (key, zeros, ones, log weighted probability) by decision."""
    x = keys & np.uint64(255)
    out, tops = np.empty((len(keys), 8)), []
    for bit in range(8):
        place = np.uint64(1 << bit) | x >> np.uint64(8 - bit)  # the decisions before this one, after a leading 1
        one = (x >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        node, of = np.unique((keys >> np.uint64(8)) << np.uint64(8) | place, return_inverse=True)
        n0, n1 = np.bincount(of, np.where(one, 0, n)), np.bincount(of, np.where(one, n, 0))
        log_w, guess, above = log_block(n0, n1), (n1 + 0.5) / (n0 + n1 + 1), np.arange(len(node))
        ids, mixed = node, guess.copy()  # mixed: by deepest node, from the depth reached downwards
        for _ in range(DEPTH - SPLIT):
            ids, up = np.unique((ids >> np.uint64(16)) << np.uint64(8) | ids & np.uint64(255), return_inverse=True)
            n0, n1, below = (np.bincount(up, v) for v in (n0, n1, log_w))
            own = log_block(n0, n1)
            log_w = np.logaddexp(own, below) - np.log(2)
            weight = np.exp(own - np.log(2) - log_w)
            above = up[above]
            mixed = (weight * (n1 + 0.5) / (n0 + n1 + 1))[above] + (1 - weight)[above] * mixed
        out[:, bit] = mixed[of]
        tops.append((ids, n0, n1, log_w))
    return out, tops


def _deep(counts: DataFrame) -> DataFrame:
    """What ``_subtrees`` gives: rows of sequences (key, n, ones) and, with top, of nodes (key, n0, n1, log_w)."""

    def work(batches):
        import pyarrow as pa

        names = ["top", "key", "n", "ones", "n0", "n1", "log_w"]

        def done(keys, n):
            ones, tops = _subtrees(keys.view(np.uint64), n)
            full = pa.FixedSizeListArray.from_arrays(pa.array(ones.ravel()), 8).cast(pa.list_(pa.float64()))
            none = lambda kind, size: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), bool)), pa.array(keys), pa.array(n), full, *(none(pa.float64(), len(keys)) for _ in range(3))], names=names)
            for ids, *figures in tops:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(ids), bool)), pa.array(ids.view(np.int64)), none(pa.int64(), len(ids)), none(pa.list_(pa.float64()), len(ids)), *map(pa.array, figures)], names=names)

        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, n = np.r_[keys, batch.column(0).to_numpy()], np.r_[n, batch.column(1).to_numpy()]
            if len(keys) > 200_000:
                whole = int(np.searchsorted(keys, keys[-1] >> (8 * (DEPTH + 1 - SPLIT)) << (8 * (DEPTH + 1 - SPLIT))))  # where the last subtree begins
                if whole:
                    yield from done(keys[:whole], n[:whole])
                    keys, n = keys[whole:], n[whole:]
        if len(keys):
            yield from done(keys, n)

    dealt = counts.where(F.col("kind") == GRAM).select("key", "n").repartition(F.shiftright("key", 8 * (DEPTH + 1 - SPLIT))).sortWithinPartitions("key")
    return dealt.mapInArrow(work, "top boolean, key long, n long, ones array<double>, n0 double, n1 double, log_w double")


def _log_block(n0: str, n1: str) -> Column:
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(log_block(a.to_numpy(), b.to_numpy()))

    return F.pandas_udf(of, "double")(n0, n1)


def _upper(tops: DataFrame) -> DataFrame:
    """context (of SPLIT - 1 bytes), place, sure, rest: a decision's probability of a one is sure + rest * what the subtree below says."""
    nodes, levels = tops.select(F.shiftright("key", 8).alias("context"), F.expr("cast(key & 255 AS int)").alias("place"), "n0", "n1", "log_w"), []
    for _ in range(SPLIT):
        sums = nodes.groupBy(F.shiftright("context", 8).alias("context"), "place").agg(*(F.sum(c).alias(c) for c in ("n0", "n1")), F.sum("log_w").alias("below"))
        sums = sums.withColumn("own", _log_block("n0", "n1"))
        more = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - F.log(F.lit(2.0))
        nodes = written(sums.withColumn("log_w", more).withColumn("weight", F.exp(F.col("own") - F.log(F.lit(2.0)) - F.col("log_w"))), "nodes")
        levels.append(nodes)
    guess = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    above = levels[-1].select("context", "place", (F.col("weight") * guess).alias("sure"), (1 - F.col("weight")).alias("rest"))
    for level in levels[-2::-1]:
        parent = above.select(F.col("context").alias("up"), "place", F.col("sure").alias("sure_"), F.col("rest").alias("rest_"))
        level = level.withColumn("up", F.shiftright("context", 8)).join(parent, ["up", "place"])
        above = level.select("context", "place", (F.col("sure_") + F.col("rest_") * F.col("weight") * guess).alias("sure"), (F.col("rest_") * (1 - F.col("weight"))).alias("rest"))
    return above


def values(counts: DataFrame) -> DataFrame:
    """kind, key, n, value: log10 of a sequence's probability, or of a word's count + 0.5."""
    deep = written(_deep(counts), "subtrees")
    upper = _upper(deep.where("top")).groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("sure", "rest")))).alias("at"))  # 255 places at most
    rows = deep.where(~F.col("top")).withColumn("context", F.shiftright("key", 8 * (DEPTH + 2 - SPLIT))).join(upper, "context")

    def log_p(bit: int) -> Column:
        above = F.element_at("at", F.expr(f"cast({1 << bit} | shiftright(key & 255, {8 - bit}) AS int)"))
        one = above["sure"] + above["rest"] * F.get("ones", F.lit(bit))
        return F.log10(F.when(F.expr(f"shiftright(key, {7 - bit}) & 1") == 1, one).otherwise(1 - one))

    rows = rows.select(F.lit(GRAM).alias("kind"), "key", "n", sum((log_p(b) for b in range(1, 8)), log_p(0)).alias("value"))
    words = counts.where(F.col("kind") == WORD).select("kind", "key", "n", F.log10(F.col("n") + 0.5).alias("value"))
    return rows.unionByName(words)


def _commonest(table: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and values of the commonest ones, COMMON[kind] at most: those over a count that the histogram gives."""
    table = table.where(F.col("kind") == kind)
    class_ = F.floor(F.log2(F.col("n") + 1) * 8)
    sizes = {r[0]: r[1] for r in table.groupBy(class_.alias("c")).count().collect()}  # some hundred classes
    least, total = max(sizes, default=0) + 1, 0
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > COMMON[kind]:
            break
        least = c
    got = table.where(class_ >= least).select("key", "value").toArrow()
    keys, value = got.column("key").to_numpy().view(np.uint64), got.column("value").to_numpy()
    order = np.argsort(keys)
    return keys[order], value[order]


def _parts(texts: DataFrame, common) -> DataFrame:
    """A row a text: what is known of its score and base score, and its keys (kind, key, n) that aren't common."""
    kind_of_id = texts.schema["doc_id"].dataType.simpleString()
    RARE = "array<struct<kind:int,key:long,n:long>>"

    def score(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40

        def summed(keys, first, kind):
            """Of each text: the sum of common values, how many common ones; the rest as (text, key, n)."""
            distinct, of = np.unique(keys, return_inverse=True)
            known, value = common.value[kind]
            at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
            hit = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
            worth = np.where(hit, value[at], 0.0) if len(known) else np.zeros(len(distinct))
            hits = np.r_[0, np.cumsum(hit[of])]
            last = np.r_[first[1:], len(keys)]
            rare = np.flatnonzero(~hit[of])
            text = np.searchsorted(first, rare, side="right") - 1
            pair, n = np.unique(text << 32 | of[rare], return_counts=True)
            total = np.add.reduceat(worth[of], first)  # by text, each of which has its end at least
            return total, hits[last] - hits[first], pair >> 32, distinct[pair & 0xFFFFFFFF], n

        for batch in batches:
            data, offsets = string_buffer(batch.column(2))
            for i, j in steps(offsets, SCORE_STEP):
                own, m = offsets[i : j + 1] - offsets[i], j - i
                part = _FOLD[data[offsets[i] : offsets[j]]]
                g, first = grams(part, own)
                total, _, t0, k0, n0 = summed(g, first, GRAM)
                words, of = _words(part, own)
                counts = np.bincount(of, minlength=m)
                at = np.arange(len(words)) + of
                tokens = np.full(len(words) + m, np.uint64(END_WORD))
                tokens[at] = words
                base, hits, t1, k1, n1 = summed(tokens, np.r_[0, np.cumsum(counts + 1)[:-1]], WORD)
                text, kind = np.r_[t0, t1], np.r_[np.full(len(t0), GRAM, np.int32), np.full(len(t1), WORD, np.int32)]
                order = np.argsort(text, kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(text.astype(np.int64), minlength=m))].astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(kind[order]), pa.array(np.r_[k0, k1][order].view(np.int64)), pa.array(np.r_[n0, n1][order])], ["kind", "key", "n"])
                rare = pa.ListArray.from_arrays(pa.array(ends), items)
                figures = (np.arange(row, row + m), np.diff(own), counts + 1, hits)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], *(pa.array(x.astype(np.int64)) for x in figures), pa.array(base), pa.array(total), rare], names=["doc_id", "held_out", "row", "n_bytes", "n_tokens", "n_known", "base", "score", "rare"])
                row += m

    return texts.select("doc_id", "held_out", "text").mapInArrow(score, f"doc_id {kind_of_id}, held_out boolean, row long, n_bytes long, n_tokens long, n_known long, base double, score double, rare {RARE}")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    texts = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    counts = written(corpus_counts(texts), "counts")
    table = written(values(counts), "values")
    common = docs.sparkSession.sparkContext.broadcast({k: _commonest(table, k) for k in COMMON})
    parts = written(_parts(texts, common), "parts")
    rare = parts.select("row", F.explode("rare").alias("x")).select("row", "x.*")
    found = rare.join(table.select("kind", "key", "value"), ["kind", "key"], "left")
    word, times = F.col("kind") == WORD, F.col("n")
    rest = found.groupBy("row").agg(
        F.sum(F.when(word, times * F.coalesce("value", F.log10(F.lit(0.5))))).alias("base_"), F.sum(F.when(~word, times * F.col("value"))).alias("score_"), F.sum(F.when(word & F.col("value").isNotNull(), times)).alias("known_")
    )
    size = counts.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.count(F.lit(1)).alias("v"))
    rows = parts.drop("rare").join(rest, "row", "left").fillna(0, ["base_", "score_", "known_"]).crossJoin(F.broadcast(size))  # one row: the sizes
    base = F.col("base") + F.col("base_") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("v") + 1))
    score = F.col("score") + F.col("score_")
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known_")).alias("n_known"), "train_tokens", base.alias("base_score"), score.alias("score"), "n_bytes", (-score * np.log2(10).item() / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
