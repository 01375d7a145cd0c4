"""BPE encoding and decoding by tree concatenation.

A text is halved until its parts are short; the parts are encoded in parallel, and
neighbours are joined again, level by level.  At each join a window of the tokens on both
sides is encoded anew and grows until its outer tokens are those that both sides already
had; what lies outside the window then stands as it is.  Texts over ``spread_chars`` have
their parts spread over tasks as rows of their own; shorter ones are halved in their task.

Special strings (added tokens) are never cut.  Decoding concatenates the bytes of the
tokens, as a byte-level decoder does.

Defined cases: a null text counts as an empty one; an empty text has no tokens; rows
repeat in the result as they do in the input; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import _WHITE, bounded_batches, give_back, spread, string_buffer

#: Characters of a part that is encoded at once.
PART_CHARS = 4096
#: Characters of a text from which its parts are spread over tasks, and of such a part.
SPREAD_CHARS = 1 << 15
#: Bytes of units and their ids that a worker remembers before it starts anew, their place in the dictionary included,
#: and bytes of a unit at most: longer ones (parts without white space or signs) hardly recur.
HELD_BYTES, HELD_CHARS, ENTRY_BYTES = 80 << 20, 64, 140
#: Tokens that must agree at each end of a window.
AGREE = 2
#: Bytes of new units that are encoded in a row.
ROW_BYTES = 1 << 15
#: ASCII letters, and what else ASCII has to see.
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_SIGN = np.array([0x21 <= b < 0x7F for b in range(256)]) & ~_LETTER


def _inked(x: np.ndarray) -> np.ndarray:
    """Bytes that surely end a character other than white space, if they end one; of the others some may, too."""
    out = ~_WHITE[x]
    out[(x >= 0x1C) & (x <= 0x1F)] = False
    # U+0085, U+00A0 and their like: two bytes from C2, or three from E1 to E3
    out[1:] &= (x[1:] < 0x80) | (x[:-1] != 0xC2)
    three = (x[:-2] >= 0xE1) & (x[:-2] <= 0xE3)
    out[2:] &= (x[2:] < 0x80) | ~three
    return out


class TreeCoder:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splits = spec["pre_tokenizer"].get("use_regex", True) and not any(" " in t for t in self.special) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self._forget()
        size = self.lib.get_vocab_size()
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.bytes = [added[i].encode() if i in added else bytes(byte_of[c] for c in self.lib.id_to_token(i)) for i in range(size)]
        self.n_bytes = np.fromiter(map(len, self.bytes), np.int64, size)

    def cut_near(self, text: str, at: int) -> int:
        """The place at or just before ``at`` that cuts no special string."""
        for s in self.special:
            k = text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)
            if 0 <= k < at:
                return k
        return at

    def parts(self, text: str, most: int) -> list[str]:
        """The leaves of the tree: halves of halves, down to ``most`` characters."""
        if len(text) <= most or not 0 < (k := self.cut_near(text, len(text) // 2)) < len(text):
            return [text] if text else []
        return self.parts(text[:k], most) + self.parts(text[k:], most)

    def leaves(self, parts: list[bytes]) -> list[np.ndarray]:
        """Token ids of each part, from those of its units.

        Each distinct unit of these parts is looked up once; short units' ids are remembered, as most of them recur.
        """
        import pyarrow as pa

        data, ends = b"".join(parts), np.cumsum(list(map(len, parts)))
        if not data:
            return [np.zeros(0, np.int64) for _ in parts]
        at = self._cuts(data, ends)
        units = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        if self.held > HELD_BYTES:
            self._forget()
        distinct, get = units.dictionary.to_pylist(), self.known.get
        number = np.fromiter((get(u, -1) for u in distinct), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        ids, begin = self.ids, self.begin
        if len(new):
            new, ids_of, n_ids, short = self._ids_of(units.dictionary, new)
            number[new] = len(self.known) + np.arange(len(new))
            ids, begin = np.concatenate([ids, ids_of]), np.concatenate([begin, begin[-1] + np.cumsum(n_ids)])
            # the long ones come last and are those of these parts only
            kept = [distinct[k] for k in new[:short]]
            self.known.update(zip(kept, number[new[:short]].tolist(), strict=True))
            self.begin = begin[: len(self.known) + 1].copy()
            self.held += sum(map(sys.getsizeof, kept)) + short * ENTRY_BYTES + 4 * int(self.begin[-1] - len(self.ids))
            self.ids = ids[: self.begin[-1]].copy()
        code = units.indices.to_numpy()
        start, n = begin[number][code], (begin[number + 1] - begin[number])[code]
        bounds = np.r_[0, np.cumsum(n)][np.searchsorted(at, ends)]
        return np.split(ids[spread(start, n)].astype(np.int64), bounds[:-1])

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.held = 0

    def _ids_of(self, units, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The new ones of distinct units in another order, their ids back to back, how many each has, and how many come first that are short."""
        import pyarrow as pa

        data, offsets = string_buffer(units)
        first, last = data[offsets[new]], offsets[new + 1] - 1
        long = offsets[new + 1] - offsets[new] > HELD_CHARS
        # those that may follow one another in one text: each starts with a blank and ends in something else
        apart = long | (first != 0x20) | ~_inked(data)[last]
        order = np.argsort(apart + 1 * long, kind="stable")
        new, n_row = new[order], int((~apart).sum())
        ids, n_ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        if n_row:
            row, stops = string_buffer(units.take(pa.array(new[:n_row])))
            j = 0
            while (i := j) < n_row:
                j = max(i + 1, int(np.searchsorted(stops, stops[i] + ROW_BYTES)) - 1)
                got = np.asarray(self.lib.encode_batch_fast([row[stops[i] : stops[j]].tobytes().decode()], add_special_tokens=False)[0].ids, np.int32)
                # a unit's last token ends where the unit ends
                n = np.searchsorted(np.cumsum(self.n_bytes[got]), stops[i : j + 1] - stops[i], side="right")
                ids.append(got)
                n_ids.append(np.diff(n))
        for e in self.lib.encode_batch_fast([u.decode() for u in units.take(pa.array(new[n_row:])).to_pylist()], add_special_tokens=False) if n_row < len(new) else ():
            ids.append(np.asarray(e.ids, np.int32))
            n_ids.append(np.array([len(ids[-1])]))
        return new, np.concatenate(ids), np.concatenate(n_ids), int((~long).sum())

    def _cuts(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Where units begin, and where the last one ends: places that no pre-token of a byte-level file runs across, however
        the text goes on at either side, and that don't lie in a special string."""
        x = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(x) + 1, bool)
        if self.splits:
            ink = _inked(x)
            # before white space, between an ASCII letter and a digit or sign, after a line break that stands alone
            cut[1:-1] = ink[:-1] & _WHITE[x[1:]] | _LETTER[x[:-1]] & _SIGN[x[1:]]
            cut[2:-1] |= (x[1:-1] == 0x0A) & ink[:-2] & (_LETTER | _SIGN)[x[2:]]
            for s in self.special:
                s = s.encode()
                k = data.find(s)
                while k >= 0:
                    cut[k + 1 : k + len(s)] = False
                    k = data.find(s, k + 1)
        cut[0] = True
        cut[ends] = True
        return np.flatnonzero(cut)

    def joined(self, sides: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        """The tokens of neighbouring parts together: level by level, two by two."""
        while len(sides) > 1:
            sides = [self._join(*sides[k : k + 2]) if k + 1 < len(sides) else sides[k] for k in range(0, len(sides), 2)]
        return sides[0][1] if sides else np.zeros(0, np.int64)

    def _edge(self, data: bytes, ends: np.ndarray, k: int, step: int) -> int:
        """The token boundary k or the next in direction step that is no boundary inside a character."""
        while 0 < k < len(ends) - 1 and data[ends[k]] & 0xC0 == 0x80:
            k += step
        return k

    def _join(self, a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
        (left, x), (right, y) = a, b
        both = left + right
        if not len(x) or not len(y):
            return both, np.concatenate([x, y])
        reach = 4
        while True:
            # only the ends of both sides are looked at
            xs, ys = x[-min(len(x), 2 * reach + 8) :], y[: 2 * reach + 8]
            begin = np.r_[0, np.cumsum(self.n_bytes[xs])] + (len(left) - int(self.n_bytes[xs].sum()))
            stop = np.r_[0, np.cumsum(self.n_bytes[ys])]
            i = self._edge(left, begin, max(0, len(xs) - reach), -1)
            j = self._edge(right, stop, min(len(ys), reach), 1)
            at_start, at_end = i == 0 and len(xs) == len(x), j == len(ys) and len(ys) == len(y)
            window = left[begin[i] :] + right[: stop[j]]
            # white space at a text's end is one pre-token, before other characters it is two
            inked = at_end or _inked(np.frombuffer(right[max(0, stop[j] - 3) : stop[j]], np.uint8))[-1]
            if inked and (at_start or left[begin[i]] & 0xC0 != 0x80) and (at_end or right[stop[j]] & 0xC0 != 0x80):
                z = np.asarray(self.lib.encode(window.decode(), add_special_tokens=False).ids, np.int64)
                agree_left = at_start or (len(xs) - i >= AGREE and np.array_equal(z[:AGREE], xs[i : i + AGREE]))
                agree_right = at_end or (j >= AGREE and np.array_equal(z[-AGREE:], ys[j - AGREE : j]))
                if agree_left and agree_right:
                    return both, np.concatenate([x[: len(x) - len(xs) + i], z, y[j:]])
            reach *= 2

    def encode(self, texts: list[str], part_chars: int = PART_CHARS) -> list[np.ndarray]:
        """Token ids of each text."""
        trees = [[p.encode() for p in self.parts(t, part_chars)] for t in texts]
        ids = iter(self.leaves([p for t in trees for p in t]))
        return [self.joined([(p, next(ids)) for p in t]) for t in trees]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> TreeCoder:
    return TreeCoder(path)


def _slices(texts: list[str], most: int = 1 << 20):
    i = held = 0
    for j, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(i, j)
            i, held = j, 0
        held += len(t)
    if i < len(texts):
        yield slice(i, len(texts))


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """Per row: the id as doc_id, the text, its token ids (array of int)."""
    return _coded(docs, tokenizer_path, id_col, text_col, spread_chars, "text string, ids array<int>", _with_text)


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the ids (little-endian 32-bit) and of the decoded text."""
    return _coded(docs, tokenizer_path, id_col, text_col, spread_chars, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _with_text(c: TreeCoder, texts: list[str], ids: list[np.ndarray]) -> list:
    import pyarrow as pa

    return [pa.array(texts, pa.string()), _lists(ids)]


def _digests(c: TreeCoder, texts: list[str], ids: list[np.ndarray]) -> list:
    import pyarrow as pa

    sha = lambda data: hashlib.sha256(data).hexdigest()
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.astype("<u4").tobytes()) for x in ids], pa.string()), pa.array([sha(c.decode(x).encode()) for x in ids], pa.string())]


def _coded(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, spread_chars: int, fields: str, finish) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in fields.split(", "))]
    long = F.length("text") > spread_chars

    def whole(batches):
        import pyarrow as pa

        c = coder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s in _slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], *finish(c, texts[s], c.encode(texts[s]))], names=names)
            del texts
            give_back()  # encoding takes many times what its ids do

    def spread(batches):
        import pyarrow as pa

        c = coder(tokenizer_path)
        for batch in batches:
            for k, (row, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                parts = c.parts(text, spread_chars)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), batch.column(0).take(pa.array([k] * len(parts))), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["row", "doc_id", "place", "text"])

    def encode_parts(batches):
        import pyarrow as pa

        c = coder(tokenizer_path)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for s in _slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(k)[s.start : s.stop] for k in range(4)] + [_lists(c.encode(texts[s]))], names=["row", "doc_id", "place", "text", "ids"])

    def join_parts(batches):
        import pyarrow as pa

        c = coder(tokenizer_path)
        for batch in batches:
            for k in range(batch.num_rows):
                parts = batch.column(1)[k].as_py()
                ids = c.joined([(p["text"].encode(), np.asarray(p["ids"], np.int64)) for p in parts])
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], *finish(c, ["".join(p["text"] for p in parts)], [ids])], names=names)

    short = rows.where(~long).mapInArrow(whole, f"doc_id {kind}, {fields}")
    # the row number tells rows apart that share an id; it is set once, as the parts are made
    parts = rows.where(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(spread, f"row long, doc_id {kind}, place int, text string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(n, "row", "place").mapInArrow(encode_parts, f"row long, doc_id {kind}, place int, text string, ids array<int>")
    joined = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("place", "text", "ids"))).alias("parts"))
    return short.unionByName(joined.select("doc_id", "parts").mapInArrow(join_parts, f"doc_id {kind}, {fields}"))


def _lists(ids: list[np.ndarray]):
    import pyarrow as pa

    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)), pa.array(flat))


def decoded(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds what the ids decode to, as decoded."""

    def decode(batches):
        import pyarrow as pa

        c = coder(tokenizer_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for k in range(batch.num_rows):
                text = c.decode(ids[k].values.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(x[k : k + 1] for x in batch.columns), pa.array([text], pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(decode, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string")
