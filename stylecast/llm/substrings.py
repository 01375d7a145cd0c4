"""Substring dedup by content-defined chunking.

A gear hash rolls over the hashes of each text's words; where it is low, a chunk ends, and
so it does after MOST_WORDS words without such a cut.  As only the last words decide, an
insertion moves no cut but those next to it, and a passage that stands twice falls into the
same chunks both times but for its two ends, however short its words are.

Chunks are deduplicated by digest: each is told whether it stands anywhere else, in its
own text or in another.  Repeated chunks in a row make a region.  A repeated passage can't
reach past the gear's cuts next to a region, which bounds its words from above; regions that
can't hold ``min_words`` go.  In the others every window of ``min_words`` words is hashed
(96 bits), and a window that has an earlier occurrence (by document id, then place) is
repeated, whichever document has it and whatever stands around it there.  Windows that
overlap are put together.

Both shuffles carry what a step of the scan has seen first only: its further occurrences
are known to be repeats without being sent, so a passage that a third of all rows share
is sent once a step.

Defined cases: a null text counts as an empty one; texts without a word have no chunk; equal
rows count once; rows that share an id but differ in text are told apart by place (those of
the smaller text hash first); rows without an id are left out; other columns are ignored by
``repeated_passages`` and kept by ``deduplicated``; an empty table gives an empty result.  A
passage is found if the gear cuts it twice (a cut stands after one word in CHUNK_WORDS): of
passages of 50 different words two in ten thousand have fewer cuts, whatever their length in
bytes.  Where words repeat so that no cut is found, the fixed cuts give equal chunks; an end of
such a passage may then lack a word or so.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import mix, span_hashes, steps, string_buffer, word_spans, written

#: Words that decide on a cut; words of a chunk on average; most words of a chunk (a prime, so that fixed cuts in periodic text fall on all places of the period).
REACH, CHUNK_WORDS, MOST_WORDS = 2, 5, 17
#: Words of a repeated passage at least.
MIN_WORDS = 50
#: Bits of the words of a chunk, and of those beside it, as they are packed beside its number.
_WORDS = 12
_LOW = (1 << 32) - 1


def chunk_bounds(data: np.ndarray, begins: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """First word, end (word), words to the gear's cut before and to the one after, and text of each chunk.

    a, b: where the words of a step start and stop; begins: the first word of each text, and the number of words.
    """
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    g = (span_hashes(data, a, b, fold_case=False) >> np.uint64(32)).astype(np.uint32)
    h = g.copy()
    for k in range(1, min(REACH, len(g))):
        h[k:] += g[:-k] << np.uint32(k)
    ends = (h < (1 << 32) // CHUNK_WORDS) & (np.arange(len(a)) - begins[text] >= REACH - 1)  # what stands before a text decides nothing
    ends[begins[1:][np.diff(begins) > 0] - 1] = True
    stop = np.flatnonzero(ends) + 1  # of what lies between the gear's cuts
    start = np.r_[0, stop[:-1]]
    size, owner = stop - start, text[start]
    same = np.r_[False, owner[1:] == owner[:-1], False]
    before, after = np.where(same[:-1], np.r_[0, size[:-1]], 0), np.where(same[1:], np.r_[size[1:], 0], 0)
    n = -(-size // MOST_WORDS)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(start, n) + k * MOST_WORDS
    end = np.r_[first[1:], len(a)]
    left = np.where(k > 0, k * MOST_WORDS, np.repeat(before, n))
    right = np.where(end < np.repeat(stop, n), np.repeat(stop, n) - end, np.repeat(after, n))
    return first, end, left, right, np.repeat(owner, n)


def _cut_up(texts):
    """(first, last text, bytes, offsets, where words start and stop, first word of each text, chunks (as above), first chunk of each text) of each step with a word."""
    data, offsets = string_buffer(texts)
    for i, j in steps(offsets):
        part = offsets[i : j + 1]
        if part[0] == part[-1]:
            continue
        step, place = data[part[0] : part[-1]], part - part[0]
        a, b = word_spans(step, place[1:])
        if not len(a):
            continue
        begins = np.searchsorted(a, place, side="left")
        cut = chunk_bounds(step, begins, a, b)
        yield i, j, step, place, a, b, begins, cut, np.searchsorted(cut[4], np.arange(j - i), side="left")


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys, where a group of equal ones begins in it, and rows of each row's group."""
    order = np.argsort(key, kind="stable")
    x = key[order]
    fresh = np.r_[True, x[1:] != x[:-1]]
    n = np.diff(np.r_[np.flatnonzero(fresh), len(x)])
    return order, fresh, np.repeat(n, n)


def _not_first(key: np.ndarray, tail: np.ndarray, uid: np.ndarray, at: np.ndarray, before: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Which of sorted windows stand elsewhere than their hash's first (equal rows share a place), and the last hash with its first place."""
    fresh = np.r_[before is None or before[:2] != (key[0], tail[0]), (key[1:] != key[:-1]) | (tail[1:] != tail[:-1])]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
    first_uid, first_at = uid[first], at[first]
    if not fresh[0]:
        goes_on = first < 0
        first_uid[goes_on], first_at[goes_on] = before[2:]
    return (uid != first_uid) | (at != first_at), (key[-1], tail[-1], first_uid[-1], first_at[-1])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.where(F.col("doc_id").isNotNull())


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each chunk that its step has first, or knows to be repeated: key (digest; any for those known), doc_id, chunk (its number, words in it and beside it), known."""

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, step, _, a, b, _, (w0, w1, left, right, of), first in _cut_up(batch.column(1)):
                beside = np.minimum(np.maximum(left, right), (1 << _WORDS) - 1)
                chunk = ((np.arange(len(of)) - first[of]) << (2 * _WORDS)) | ((w1 - w0) << _WORDS) | beside
                digest = span_hashes(step, a[w0], b[w1 - 1], fold_case=False).view(np.int64)
                order, fresh, n = _grouped(digest)
                key, known = digest[order], n > 1
                key[~fresh] = batch.column(2).to_numpy()[i:j][of[order][~fresh]]  # any will do: they go with their text
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)[i:j].take(pa.array(of[order])), pa.array(chunk[order]), pa.array(known)], names=["key", "doc_id", "chunk", "known"])

    rows = _rows(docs, id_col, text_col).withColumn("place", F.xxhash64("doc_id"))
    return rows.mapInArrow(split, f"key long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, chunk long, known boolean")


def _repeated(rows: DataFrame) -> DataFrame:
    """The chunks that stand twice or more: doc_id, chunk.  One shuffle by digest, of which each task runs through its sorted rows."""

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            batch = batch.select(["key", "doc_id", "chunk", "known"])
            table = pa.Table.from_batches([b for b in (held, batch) if b is not None and b.num_rows])
            if not table.num_rows:
                continue
            key = table.column("key").to_numpy()
            same = key[1:] == key[:-1]
            twice = np.r_[False, same] | np.r_[same, False] | table.column("known").to_numpy()
            out = table.select(["doc_id", "chunk"]).slice(0, table.num_rows - 1).filter(pa.array(twice[:-1]))
            yield from out.to_batches()
            # whether the last row repeats may depend on the next batch
            last = table.slice(table.num_rows - 1).combine_chunks()
            held = last.set_column(3, "known", pa.array([bool(twice[-1])])).to_batches()[0]
        if held is not None and held.column("known")[0].as_py():
            yield held.select(["doc_id", "chunk"])

    sorted_ = rows.repartition("key").sortWithinPartitions("key")
    return sorted_.select("key", "doc_id", "chunk", "known").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, chunk long")


def regions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Texts with regions of repeated chunks that may hold a passage of min_words: doc_id, spans (first and last chunk of each region in turn)."""

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            packed = lists.values.to_numpy()[bounds[0] : bounds[-1]]
            of = np.repeat(np.arange(len(lists)), np.diff(bounds))
            k, most = packed >> (2 * _WORDS), (1 << _WORDS) - 1
            words, beside = (packed >> _WORDS) & most, packed & most
            if not len(k):
                continue
            fresh = np.r_[True, (k[1:] > k[:-1] + 1) | (of[1:] != of[:-1])]
            at = np.flatnonzero(fresh)
            # those in the region and beside it, and before by what decides on a cut
            total = np.add.reduceat(words, at) + 2 * np.maximum.reduceat(beside, at) + REACH
            full = np.maximum.reduceat(beside, at) == most
            good = np.flatnonzero((total >= min_words) | full)
            lo, hi, doc = k[at[good]], k[np.r_[at[1:], len(k)][good] - 1], of[at[good]]
            spans = np.stack([lo, hi], 1).reshape(-1).astype(np.int32)
            n = np.bincount(doc, minlength=len(lists))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(2 * n)].astype(np.int32)), pa.array(spans))], names=["doc_id", "spans"])
            yield out.filter(pa.array(n > 0))

    twice = _repeated(chunks(docs, id_col, text_col)).groupBy("doc_id").agg(F.sort_array(F.collect_set("chunk")).alias("chunks"))
    return twice.mapInArrow(find, f"doc_id {twice.schema['doc_id'].dataType.simpleString()}, spans array<int>")


def windows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each window of min_words words in the regions that its step has first, and for each row of windows that it knows to be repeats.

    key, tail (hash), doc_id, uid (of the text), place (first word, and in the lower 32 bits the repeated windows from there on; 0 if the
    step has it first), span (start, and in the lower 32 bits end, in bytes): packed, as these rows are most of what is shuffled.
    """
    names = ["key", "tail", "doc_id", "uid", "place", "span"]

    def split(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            rank = pc.rank(batch.column(0), tiebreaker="dense").to_numpy().astype(np.int64)
            uid = batch.column(3).to_numpy()
            for i, j, step, place, a, b, begins, (c0, c1, left, right, _), first in _cut_up(batch.column(1)):
                mine = flat[bounds[i] : bounds[j]].reshape(-1, 2).astype(np.int64)
                doc = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]) // 2)
                inside = np.zeros(len(a) + 1, np.int64)  # windows that lie in a region
                # up to the gear's cuts on each side, and what may decide on the first one
                lo, hi = first[doc] + mine[:, 0], first[doc] + mine[:, 1]
                w0 = np.maximum(c0[lo] - left[lo] - REACH, begins[doc])
                w1 = c1[hi] + right[hi] - min_words + 1
                fits = w1 > w0
                np.add.at(inside, w0[fits], 1)
                np.add.at(inside, w1[fits], -1)
                w = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
                if not len(w):
                    continue
                text = np.searchsorted(place, a[w], side="right") - 1
                start, end = a[w], b[w + min_words - 1]
                key = span_hashes(step, start, end, fold_case=False).view(np.int64)
                each = np.r_[np.uint64(0), np.cumsum(mix(span_hashes(step, a, b, fold_case=False)))]
                tail = ((each[w + min_words] - each[w]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                at = w - begins[text]
                start, end = start - place[text], end - place[text]
                order = np.lexsort((at, uid[i:j][text], rank[i:j][text], tail, key))
                again = np.zeros(len(w), bool)
                again[order] = _not_first(key[order], tail[order], uid[i:j][text[order]], at[order])[0]
                # rows of windows known to be repeats: one row each
                k = np.flatnonzero(again)
                fresh = np.r_[True, (w[k][1:] != w[k][:-1] + 1) | (text[k][1:] != text[k][:-1])] if len(k) else np.zeros(0, bool)
                head = k[fresh]
                tailend = k[np.r_[fresh[1:], True]] if len(k) else k
                new = np.flatnonzero(~again)
                put = lambda x, y: pa.array(np.concatenate([x, y]))
                pick = np.concatenate([text[new], text[head]])
                yield pa.RecordBatch.from_arrays(
                    [
                        put(key[new], mix((uid[i:j][text[head]] + at[head]).view(np.uint64)).view(np.int64)), put(tail[new], np.zeros(len(head), np.int32)), batch.column(0)[i:j].take(pa.array(pick)), pa.array(uid[i:j][pick]),
                        put(at[new] << 32, at[head] << 32 | (w[tailend] - w[head] + 1)), put(start[new] << 32 | end[new], start[head] << 32 | end[tailend]),
                    ],
                    names=names,
                )

    rows = _rows(docs, id_col, text_col).withColumn("uid", F.xxhash64("doc_id", "text"))
    rows = rows.join(found.withColumnRenamed("doc_id", "found_id"), F.col("doc_id") == F.col("found_id")).select("doc_id", "text", "spans", "uid")
    return rows.mapInArrow(split, f"key long, tail int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, uid long, place long, span long")


def _repeats(rows: DataFrame) -> DataFrame:
    """The windows that have an earlier occurrence: doc_id, uid, place, span.  One shuffle by hash."""
    kept = ["doc_id", "uid", "place", "span"]

    def run(batches):
        import pyarrow as pa

        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("key", "tail", *kept)}
            key, tail, uid, place = (col[c].to_numpy() for c in ("key", "tail", "uid", "place"))
            at, take = place >> 32, (place & _LOW) > 0
            known = take.copy()
            unknown = np.flatnonzero(~take)
            if len(unknown):
                take[unknown], before = _not_first(*(x[unknown] for x in (key, tail, uid, at)), before)
            out = pa.RecordBatch.from_arrays([pa.array(place + ~known) if c == "place" else col[c] for c in kept], names=kept)
            yield out.filter(pa.array(take))

    sorted_ = rows.repartition("key").sortWithinPartitions("key", "tail", "doc_id", "uid", "place")
    return sorted_.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, uid long, place long, span long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of min_words words or more that have stood before: doc_id, uid (xxhash64 of id and text), start, end (UTF-8 bytes), n_words."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(regions(docs, min_words=min_words), "regions")
    again = _repeats(windows(docs, found, min_words=min_words))
    by_text = again.groupBy("doc_id", "uid").agg(F.sort_array(F.collect_set(F.struct("place", "span"))).alias("w"))
    kind = by_text.schema["doc_id"].dataType.simpleString()

    def put_together(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            place, span = (lists.values.field(k).to_numpy()[bounds[0] : bounds[-1]] for k in range(2))
            at, n, start, end = place >> 32, place & _LOW, span >> 32, span & _LOW
            if not len(at):
                continue
            of = np.repeat(np.arange(len(lists)), np.diff(bounds))
            # windows overlap if the next begins before the furthest of the same text ends
            reach = np.maximum.accumulate(at + n - 1 + min_words + of * (1 << 40)) - of * (1 << 40)
            fresh = np.r_[True, (of[1:] != of[:-1]) | (at[1:] >= reach[:-1])]
            k = np.flatnonzero(fresh)
            words = np.maximum.reduceat(at + n - 1 + min_words, k) - at[k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[k])), batch.column(1).take(pa.array(of[k])), pa.array(start[k]), pa.array(np.maximum.reduceat(end, k)), pa.array(words)], names=["doc_id", "uid", "start", "end", "n_words"])

    return by_text.mapInArrow(put_together, f"doc_id {kind}, uid long, start long, end long, n_words long")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns, repeated passages cut out of the text."""
    spans = repeated_passages(docs, id_col, text_col, min_words).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans_")).withColumnRenamed("uid", "uid_")
    uid = F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col], F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    rows = docs.join(spans, uid == spans["uid_"], "left")
    columns = docs.columns

    def cut_out(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, spans in zip(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), batch.column(batch.schema.get_field_index("spans_")).to_pylist(), strict=True):
                data, kept, i = (text or "").encode(), [], 0
                for x in spans or []:
                    kept.append(data[i : max(i, x["start"])])
                    i = max(i, x["end"])
                out.append(text if not spans else b"".join([*kept, data[i:]]).decode())
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, text_col, pa.array(out, pa.string())).select(columns)

    return rows.select(*(docs[c] for c in docs.columns), "spans_").mapInArrow(cut_out, docs.schema)
