"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch are held as one ragged numpy array of symbol ids, cut where no
piece spans two characters.  In each round every sequence applies its own lowest-rank pair
wherever it stands, all sequences at once, until no sequence has a pair left; the surviving
symbols are counted.  Where a merge makes a pair of lower rank than its own, those to the
right of it wait for the next round.  Only distinct pre-tokens are merged; counts are then
looked up for each occurrence, and short ones are remembered within a bound of bytes.  A stretch of more than LONG characters (no white space, no
cut) would take as many rounds as it has ranks: its pairs are merged in order from a heap.

The merges are those of a sentencepiece BPE model with an identity normaliser: pieces and
their order are read from the model file, which also gives the byte fallback (a symbol
that is no piece counts as its UTF-8 bytes).

Defined cases: a null text counts as an empty one; an empty text has 0 tokens; rows
repeat in the result as they do in the input; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Bytes of pre-tokens that a worker remembers before it starts anew, their place in the dictionary included,
#: and characters of one at most: longer ones (text without blanks) hardly recur.
HELD_BYTES, HELD_CHARS, ENTRY_BYTES = 32 << 20, 64, 100
#: Symbols of a stretch that is merged in rounds at most.
LONG = 256
_NONE = np.iinfo(np.int32).max
_PRE = re.compile("▁+[^▁]*|[^▁]+")


class PieceMerges:
    """Pair ranks of a sentencepiece BPE model, and the ragged merging."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or train.model_type != 2 or not train.byte_fallback:
            raise ValueError("a BPE model with identity normaliser, escaped white space and byte fallback is needed")
        self.prefix = "▁" if norm.add_dummy_prefix else ""
        pieces = sorted((-p.score, p.piece) for p in model.pieces if p.type == 1)
        if any(re.search("[^▁]▁", p) for _, p in pieces) or any(p.type == 4 for p in model.pieces):
            raise ValueError("pieces that span a word start, or user-defined ones, are not supported")
        self.ids = {p: i for i, (_, p) in enumerate(pieces)}
        score = [s for s, _ in pieces]
        rank = np.unique(score, return_inverse=True)[1]
        keys, to, ranks = [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                # single characters that are no pieces still take part in merges, as symbols of their own
                a = self._symbol(p[:k]) if a is None and k == 1 else a
                b = self._symbol(p[k:]) if b is None and len(p) - k == 1 else b
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    to.append(i)
                    ranks.append(rank[i])
        order = np.argsort(keys)
        self.keys, self.to, self.rank = (np.asarray(x)[order] for x in (keys, to, ranks))
        self.rank = self.rank.astype(np.int32)
        #: Two characters side by side in some piece.
        self.beside = np.unique([self._point(a) << 32 | self._point(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)])
        #: A piece that takes part in a pair of lower rank than its own.
        own = np.full(1 << 21, -1, np.int64)
        for i in range(len(pieces)):
            own[i] = rank[i] if len(pieces[i][1]) > 1 else -1
        a, b = self.keys >> 32, self.keys & 0xFFFFFFFF
        self.careful = np.zeros(len(pieces), bool)
        for side in (a, b):
            early = (own[side] > self.rank) & (side < len(pieces))
            self.careful[side[early]] = True
        self.cost: dict[str, int] = {}
        self.held = 0
        self._table: dict[int, tuple[int, int]] = {}

    def _point(self, char: str) -> int:
        return self.ids.get(char, self._symbol(char))

    def _symbol(self, char: str) -> int:
        """Ids of characters that are no pieces: above those of the pieces."""
        return len(self.ids) + ord(char)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.to[np.searchsorted(self.keys, left.astype(np.int64) << 32 | right)]

    def counts(self, pre: list[str]) -> np.ndarray:
        """Surviving symbols of each non-empty pre-token, bytes for those that are no pieces."""
        chars = "".join(pre)
        points = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.int64)
        distinct, inverse = np.unique(points, return_inverse=True)
        sym = np.array([self.ids.get(chr(c), len(self.ids) + c) for c in distinct], np.int64)[inverse]
        lens = np.fromiter(map(len, pre), np.int64, len(pre))
        of = np.repeat(np.arange(len(pre)), lens)
        key = sym[:-1] << 32 | sym[1:]
        spanned = self.beside[np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)] == key
        starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | ~spanned])
        owner, sizes = of[starts], np.diff(np.r_[starts, len(sym)])
        out = np.zeros(len(starts), np.int64)
        for k in np.flatnonzero(sizes > LONG):
            out[k] = self._in_order(sym[starts[k] : starts[k] + sizes[k]].tolist())
        seq, short = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= LONG, sizes)
        sym, seq = sym[short], seq[short]
        ranks = np.full(len(sym), _NONE, np.int32)  # of the pair that starts here
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        ranks[inside] = self._ranks(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            if (done := low == _NONE).any():
                over = np.repeat(done, sizes)
                np.add.at(out, seq[over], self._tokens(sym[over]))
                keep = ~over
                sym, seq, ranks = sym[keep], seq[keep], ranks[keep]
                if not len(sym):
                    break
                low, sizes = low[~done], sizes[~done]
            hit = np.flatnonzero(ranks == np.repeat(low, sizes))
            # equal pairs that overlap: the first, the third ... of each run
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1] | np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]
            begin = hit[np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))]
            hit = hit[(hit - begin) % 2 == 0]
            merged = self._merged(sym[hit], sym[hit + 1])
            if (wary := self.careful[merged]).any():
                k = np.flatnonzero(wary)
                own, r = hit[k], ranks[hit[k]]
                # what stands on the left has been merged before, what stands on the right has not
                left = np.where((k > 0) & (hit[k - 1] == own - 2), merged[k - 1], sym[own - 1])
                loud = (own > 0) & (seq[own - 1] == seq[own]) & (self._ranks(left, merged[k]) < r)
                right = np.minimum(own + 2, len(sym) - 1)
                loud |= (own + 2 < len(sym)) & (seq[right] == seq[own]) & (self._ranks(merged[k], sym[right]) < r)
                before = np.zeros(len(hit) + 1, np.int64)
                before[k[loud] + 1] = 1
                before = np.cumsum(before)
                begun = np.maximum.accumulate(np.where(np.r_[True, seq[hit[1:]] != seq[hit[:-1]]], before[:-1], 0))
                keep = before[:-1] == begun
                hit, merged = hit[keep], merged[keep]
            sym[hit] = merged
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            place = np.cumsum(~gone) - 1
            sym, seq, ranks = sym[~gone], seq[~gone], ranks[~gone]
            at = place[hit]
            ranks[at] = _NONE
            right = at[(at + 1 < len(sym))]
            right = right[seq[right + 1] == seq[right]]
            ranks[right] = self._ranks(sym[right], sym[right + 1])
            left = at[at > 0] - 1
            left = left[seq[left + 1] == seq[left]]
            ranks[left] = self._ranks(sym[left], sym[left + 1])
        return np.bincount(owner, out, len(pre)).astype(np.int64)

    def _tokens(self, sym: np.ndarray) -> np.ndarray:
        """Tokens of each symbol: one that is no piece falls back to the bytes of its character."""
        points = sym - len(self.ids)
        return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)

    def _in_order(self, sym: list[int]) -> int:
        """Tokens of a long stretch: pairs by rank, then from the left, in n log n steps."""
        if not self._table:
            self._table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.to.tolist(), strict=True), strict=True))
        get, end = self._table.get, len(sym)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(m[0], i, m[1], k) for i in range(end - 1) if (m := get(k := sym[i] << 32 | sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, to, key = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= end or sym[i] << 32 | sym[j] != key:
                continue
            sym[i], sym[j] = to, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if m := get(key := to << 32 | sym[k]):
                    heapq.heappush(heap, (m[0], i, m[1], key))
            h = before[i]
            if h >= 0 and (m := get(key := sym[h] << 32 | to)):
                heapq.heappush(heap, (m[0], h, m[1], key))
        left = np.array(sym)
        return int(self._tokens(left[left >= 0]).sum())

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        pre = [_PRE.findall(self.prefix + t.replace(" ", "▁")) if t else [] for t in texts]
        if self.held > HELD_BYTES:
            self.cost.clear()
            self.held = 0
        new = list(set().union(*pre).difference(self.cost))
        once = {}  # pre-tokens of these texts only
        if new:
            for p, n in zip(new, self.counts(new).tolist(), strict=True):
                if len(p) > HELD_CHARS:
                    once[p] = n
                else:
                    self.cost[p] = n
                    self.held += sys.getsizeof(p) + ENTRY_BYTES
        of = (lambda p: once[p] if p in once else self.cost[p]) if once else self.cost.__getitem__
        for i, p in enumerate(pre):
            out[i] = sum(map(of, p))
        return out


@lru_cache(maxsize=2)
def merges(model_path: str) -> PieceMerges:
    return PieceMerges(model_path)


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[slice]:
    """Consecutive texts of some length together, so that a step's arrays stay small."""
    i = held = 0
    for j, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(i, j)
            i, held = j, 0
        held += len(t)
    if i < len(texts):
        yield slice(i, len(texts))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: the id as doc_id, n_bytes, n_tokens, and whether n_tokens is over the limit."""

    def count(batches):
        import pyarrow as pa

        model = merges(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.concatenate([model.count(texts[s]) for s in _groups(texts)]) if texts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
