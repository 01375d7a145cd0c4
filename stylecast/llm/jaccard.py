"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document is the set of its 5-word shingles, held as sorted 64-bit hashes.  Documents
with equal sets form a class, and only the classes' representatives are compared.  Two
sets of similarity 0.8 or more have sizes within a fifth of each other and share one of
the first fifth of their shingles, in any order that is the same for all.  In that order,
shingles that many documents begin with come last (how well these are known only bears on
speed); the others go by their hash.  If such a shingle is the first that both have, no more
is shared than follows it in either; sets that no other of the shingle's can be similar to by
this are dropped.  A tile is the sets of one band of sizes and the band above it that are left.  Within a tile each set only meets the sizes it can be
similar to, and a parity bitmap of the set bounds the overlap from above: each bit that
differs is a shingle that only one of both has.  What passes is verified on the whole
sorted arrays.

Large groups of near copies would pass in all pairs.  So a first round only ties each set
to one pivot, the smallest id of one of its first shingles' groups, and links those that are
similar; sets that already belong together aren't compared again, which loses no link
between components; of two components that meet in tiles, the pair with the fewest
differing bits is verified before the others, and a tile with many pairs gives each set's
best one first and the others only when nothing more is tied together that way.  A tile too
large for one task is cut into blocks, and its pairs of
blocks are tiles of their own.  Pairs are verified a pivot at a time; a pivot's text is sent
once for each TOGETHER of its partners.

Defined cases: null texts and texts without words have no shingles and link with nothing;
fewer words than a shingle has count as one shingle; rows without an id link with nothing;
rows that share an id are one document that holds the sets of all of them; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import kept, mix, span_hashes, steps, string_buffer, word_spans, written
from .components import components

#: Words of a shingle, and the similarity of a link in per cent.
WORDS, PER_CENT = 5, 80
#: First shingles that the first round looks at.
FIRST = 4
#: Shingles that are put last: at most so many, and only if so many sets of a partition's begin with them together.
COMMON, COMMON_SETS = 100_000, 32
#: Sets of a tile that one task compares at once, and partners of a pivot that are verified together.
BLOCK, TOGETHER = 1024, 64
#: Pairs of a tile whose signatures are compared in one numpy step.
PAIRS_AT_ONCE = 1 << 18
#: Pairs a set beyond which a tile's best ones come first.
DENSE = 4
#: Steps of sizes and of places in which first shingles are shuffled, and documents of a shingle that are compared by these.
SIZE_STEP, PLACE_STEPS, GROUP = 1.0125, 155, 1 << 16
#: Growth of sizes from band to band: a little more than two linked sets can differ; and bands of a tile, besides the one above them.
BAND, BANDS = 1.26, 4
#: Hash places of wanted documents, a filter of fixed size: beyond it more texts are shuffled, once each at most.
PLACES = 1 << 21


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts of a step, and where each text's begin."""
    n = len(offsets) - 1
    starts, stops = word_spans(data, offsets[1:])
    at = np.searchsorted(offsets, starts, side="right") - 1
    h = span_hashes(data, starts, stops, fold_case=True)
    words = np.bincount(at, minlength=n)
    first = np.r_[0, np.cumsum(words)]
    mul = np.uint64(0x9E3779B97F4A7C15)
    if len(h) >= WORDS:
        win = h[: len(h) - WORDS + 1].copy()
        for k in range(1, WORDS):
            win = win * mul + h[k : len(h) - WORDS + 1 + k]
        inside = np.flatnonzero(at[WORDS - 1 :] == at[: len(at) - WORDS + 1])
        keys, of = mix(win[inside]), at[inside]
    else:
        keys, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((words > 0) & (words < WORDS))
    if len(few):
        short = []
        for k in few:
            x = np.uint64(words[k])
            for w in h[first[k] : first[k + 1]]:
                x = np.uint64((int(x) * int(mul) + int(w)) & (2**64 - 1))
            short.append(x)
        keys, of = np.concatenate([keys, mix(np.array(short, np.uint64))]), np.concatenate([of, few])
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    if len(keys):
        fresh = np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]
        keys, of = keys[fresh], of[fresh]
    return keys, np.r_[0, np.cumsum(np.bincount(of, minlength=n))]


def _signature(s: np.ndarray) -> bytes:
    """Parity bitmap of a set: about as many bits as it has shingles, a power of two, 256 at least."""
    bits = 256
    while bits < len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _over_sets(texts: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow over (ids, sets): make(ids, keys, bounds) gives the arrays of a step."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = string_buffer(batch.column(1))
            for i, j in steps(offsets):
                part = offsets[i : j + 1]
                keys, bounds = _sets(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays(make(batch.column(0)[i:j], keys, bounds), names=names)

    return texts.mapInArrow(run, schema)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (shingles), fp1 and fp2 (fingerprint of the set), firsts (its first shingles by hash), bits (signature)."""
    texts = _texts(docs, id_col, text_col)

    def make(ids, keys, bounds):
        import pyarrow as pa
        import xxhash

        n, fp, firsts, bits = np.diff(bounds), [], [], []
        for a, b in zip(bounds, bounds[1:], strict=False):
            s = keys[a:b]
            d = xxhash.xxh3_128_digest(s.tobytes())
            fp.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            firsts.append(s[:FIRST].view(np.int64))
            bits.append(_signature(s))
        flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(list(map(len, firsts)))].astype(np.int32)), pa.array(flat))
        return [ids, pa.array(n.astype(np.int64)), pa.array([x for x, _ in fp], pa.int64()), pa.array([y for _, y in fp], pa.int64()), lists, pa.array(bits, pa.binary())]

    kind = texts.schema["doc_id"].dataType.simpleString()
    return _over_sets(texts, make, f"doc_id {kind}, n long, fp1 long, fp2 long, firsts array<long>, bits binary")


def common_shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The shingles that most sets begin with, sorted; COMMON at most.

    Each step of a task only passes on those that several of its own distinct sets begin with.
    """

    def make(ids, keys, bounds):
        import pyarrow as pa

        kept = _distinct(keys, bounds)
        n = np.diff(bounds)
        place = np.arange(len(keys)) - np.repeat(bounds[:-1], n)
        h, times = np.unique(keys[(place < np.repeat(_prefixes(n), n)) & np.repeat(kept, n)], return_counts=True)
        return [pa.array(h[times > 1].view(np.int64)), pa.array(times[times > 1].astype(np.int64))]

    rows = _over_sets(_texts(docs, id_col, text_col), make, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_SETS)
    return np.sort(np.array([r[0] for r in rows.orderBy(F.desc("n"), "h").limit(COMMON).collect()], np.int64).view(np.uint64))


def posts(docs: DataFrame, common: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h, ids, ats: the documents of a step with h among their first shingles when the common ones come last, one of those with equal sets; and h's place in each."""
    texts = _texts(docs, id_col, text_col).where(F.col("doc_id").isNotNull())

    def make(ids, keys, bounds):
        import pyarrow as pa

        n = np.diff(bounds)
        of = np.repeat(np.arange(len(n)), n)
        last = np.zeros(len(keys), bool)
        if len(common):
            last = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys
        order = np.lexsort((keys, last, of))
        place = np.arange(len(keys)) - np.repeat(bounds[:-1], n)
        kept = (place < np.repeat(_prefixes(n), n)) & np.repeat(_distinct(keys, bounds), n)
        h, of, place = keys[order][kept], of[kept], place[kept]
        order = np.argsort(h, kind="stable")
        h, of, at = h[order], of[order], _packed(n[of], place)[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        bounds = pa.array(np.r_[starts, len(h)].astype(np.int32))
        return [pa.array(h[starts].view(np.int64)), pa.ListArray.from_arrays(bounds, ids.take(pa.array(of))), pa.ListArray.from_arrays(bounds, pa.array(at))]

    kind = texts.schema["doc_id"].dataType.simpleString()
    return _over_sets(texts, make, f"h long, ids array<{kind}>, ats array<smallint>")


def _packed(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Size of a set and a first shingle's place in it in 16 bits: steps of SIZE_STEP, and of PLACE_STEPS to the whole, both rounded down."""
    return (np.floor(np.log(n) / np.log(SIZE_STEP)).astype(np.int64) << 5 | place * PLACE_STEPS // n).astype(np.uint16).view(np.int16)


def _partnered(group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which sets of a group, all with one shingle, can be linked to another of it if that shingle is the first that both have.

    Of two such sets no more is shared than follows in either; what a link needs grows with both sizes.
    Rounded sizes and places err on the side of a link.
    """
    size, place = at.view(np.uint16).astype(np.int64) >> 5, at.view(np.uint16) & 31
    order = np.lexsort((size, group))
    group, size, place = group[order], size[order], place[order]
    low = SIZE_STEP**size * (1 - 1e-9)
    # the largest partner that what follows here is enough for
    most = SIZE_STEP ** (size + 1) * (1 + 1e-9) * (1 - place / PLACE_STEPS) * (100 + PER_CENT) / PER_CENT - low
    key = group << 12 | size
    to = np.searchsorted(key, (group << 12) + np.floor(np.log(np.maximum(most, 0.9)) / np.log(SIZE_STEP) + 1e-6).clip(-1, 4095).astype(np.int64), side="right")
    at = np.arange(len(key))
    tops = [most]
    while 2 << len(tops) <= 2 * len(key):
        half = 1 << len(tops) - 1
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))

    def top(begin, end):
        out = np.full(len(begin), -np.inf)
        level = np.frexp(np.maximum(end - begin, 0))[1] - 1
        for k in np.unique(level[level >= 0]):
            x = np.flatnonzero(level == k)
            out[x] = np.maximum(tops[k][begin[x]], tops[k][end[x] - (1 << k)])
        return out

    out = np.zeros(len(key), bool)
    out[order] = np.maximum(top(np.searchsorted(group, group), np.minimum(at, to)), top(at + 1, to)) >= low
    return out


def _prefixes(n: np.ndarray) -> np.ndarray:
    """Shingles of which similar sets share one."""
    return np.where(n > 0, n - (n * PER_CENT + 99) // 100 + 1, 0)


def _distinct(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which sets of a step are the first of those equal to them."""
    n = np.diff(bounds)
    sums = [np.r_[np.uint64(0), np.cumsum(mix(keys ^ np.uint64(x)))] for x in (0, 0xA5A5)]
    id_ = np.stack([n.astype(np.uint64), *(x[bounds[1:]] - x[bounds[:-1]] for x in sums)], 1)
    out = np.zeros(len(n), bool)
    if len(n):
        out[np.unique(id_, axis=0, return_index=True)[1]] = True
    return out


def _fold(x: np.ndarray, to: int) -> np.ndarray:
    """Parity bitmaps (rows of words) as bitmaps of fewer words."""
    while x.shape[1] > to:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _shared(rows: DataFrame, most: int = GROUP) -> DataFrame:
    """h, id: of the rows of posts, the documents that another one's set can be similar to by this shingle.  One shuffle by shingle; each task runs through its sorted rows.

    A shingle of more than ``most`` documents isn't held from batch to batch: those beyond pass.
    """
    kind = rows.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        import pyarrow as pa

        held, whole = None, None

        def passing(table):
            if table.num_rows:
                h, at = table.column("h").to_numpy(), table.column("at").to_numpy()
                good = _partnered(np.cumsum(np.r_[0, h[1:] != h[:-1]]), at)
                if whole is not None:
                    good |= h == whole
                yield from table.filter(pa.array(good)).select(["h", "id"]).to_batches()

        for batch in batches:
            n = batch.column(1).value_lengths().to_numpy()
            table = pa.table([pa.array(np.repeat(batch.column(0).to_numpy(), n)), batch.column(1).flatten(), batch.column(2).flatten()], names=["h", "id", "at"])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            h = table.column("h").to_numpy()
            first = int(np.searchsorted(h, h[-1]))
            yield from passing(table.slice(0, first))
            # the last shingle may go on in the next batch
            held = table.slice(first).combine_chunks()
            if held.num_rows > most:
                whole = int(h[-1])  # all of it passes from here on
                yield from passing(held)
                held = None
        if held is not None:
            yield from passing(held)

    return rows.repartition("h").sortWithinPartitions("h").select("h", "ids", "ats").mapInArrow(run, f"h long, id {kind}")


def _differing(bits: list[np.ndarray], words: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits that differ between the parity bitmaps of sets i and j, the larger folded to the size of the smaller."""
    out = np.zeros(len(i), np.int64)
    for w in np.unique(words[i]):
        for v in np.unique(words[j[words[i] == w]]):
            k = np.flatnonzero((words[i] == w) & (words[j] == v))
            out[k] = np.bitwise_count(bits[w][place[i[k]]] ^ _fold(bits[v][place[j[k]]], w)).sum(1)
    return out


def _passing(tile: np.ndarray, n: np.ndarray, comp: np.ndarray, lower: np.ndarray, block: np.ndarray, cross: np.ndarray, signatures) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, differing bits in thousandths of both sizes) whose sizes and signatures allow a link, of rows sorted by tile and size; the smaller set is in its tile's lower band."""
    data, offsets = signatures
    words = np.diff(offsets) // 8
    place, bits = np.zeros(len(n), np.int64), {}
    for w in np.unique(words):
        k = np.flatnonzero(words == w)
        place[k] = np.arange(len(k))
        bits[w] = np.ascontiguousarray(data[(offsets[k][:, None] + np.arange(8 * w))]).view(np.uint64).reshape(len(k), w)
    span = int(n.max()) * 2 + 1
    ends = np.searchsorted(tile * span + n, tile * span + np.minimum(n * 100 // PER_CENT, span - 1), side="right")
    partners = np.where(lower, ends - np.arange(len(n)) - 1, 0)
    total, found, at = np.r_[0, np.cumsum(partners)], [], 0
    while at < len(n):  # about PAIRS_AT_ONCE pairs at once
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, side="right")) - 1)
        i = np.repeat(np.arange(at, to), partners[at:to])
        j = i + 1 + np.arange(len(i)) - (total[i] - total[at])
        k = (comp[i] != comp[j]) & (~cross[i] | (block[i] != block[j]))
        i, j = i[k], j[k]
        differ = _differing(bits, words, place, i, j)
        # |A - B| + |B - A| <= (100 - p) / (100 + p) * (|A| + |B|)
        k = differ * (100 + PER_CENT) <= (n[i] + n[j]) * (100 - PER_CENT)
        found.append((i[k], j[k], differ[k] * 1000 // (n[i[k]] + n[j[k]])))
        at = to
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _tile_pairs(members: DataFrame, every: bool) -> DataFrame:
    """Candidate pairs of all tiles: a, b, differ (differing bits in thousandths of both sizes); members: h, tile, bi, bj (blocks that meet), block, lower, id, n, comp, bits.

    Unless every pair is asked for, of a tile with more than DENSE pairs a set only the best of
    each set are given, and a row that names the tile: h, tile.
    """
    kind = members.schema["id"].dataType.simpleString()
    keys, names = ["h", "tile", "bi", "bj"], ["h", "tile", "bi", "bj", "id", "n", "comp", "lower", "block", "bits"]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def pairs(table):
            if not table.num_rows:
                return
            col = {c: table.column(c).combine_chunks() for c in names}
            h, t, bi, bj = (col[c].to_numpy() for c in keys)
            fresh = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]
            comp = pc.rank(col["comp"], tiebreaker="dense").to_numpy().astype(np.int64)
            number = np.cumsum(fresh)
            i, j, differ = _passing(number, col["n"].to_numpy(), comp, col["lower"].to_numpy(zero_copy_only=False), col["block"].to_numpy(), bi != bj, string_buffer(col["bits"]))
            dense = np.zeros(0, np.int64)
            if not every and len(i):
                sets, pairs_ = np.bincount(number), np.bincount(number[i], minlength=number[-1] + 1)
                over = pairs_ > DENSE * sets
                dense = np.flatnonzero(fresh & over[number])
                # the best partner of each set of these, on either side
                best = ~over[number[i]]
                for x in (i, j):
                    order = np.lexsort((differ, x))
                    best[order[np.r_[True, x[order][1:] != x[order][:-1]]]] = True
                i, j, differ = i[best], j[best], differ[best]
            none = pa.nulls(len(dense), col["id"].type)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([col["id"].take(pa.array(i)), none]), pa.concat_arrays([col["id"].take(pa.array(j)), none]), pa.concat_arrays([pa.array(differ), pa.nulls(len(dense), pa.int64())]), pa.concat_arrays([pa.nulls(len(i), pa.int64()), pa.array(h[dense])]), pa.concat_arrays([pa.nulls(len(i), pa.int32()), pa.array(t[dense])])], names=["a", "b", "differ", "h", "tile"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch.select(names)])
            table = table if held is None else pa.concat_tables([held, table])
            if table.num_rows:  # the last tile may go on
                last = [table.column(c)[-1].as_py() for c in keys]
                same = np.logical_and.reduce([table.column(c).to_numpy() == x for c, x in zip(keys, last, strict=True)])
                first = int(np.argmax(same))
                yield from pairs(table.slice(0, first))
                held = table.slice(first)
        if held is not None:
            yield from pairs(held)

    rows = members.repartition(*keys).sortWithinPartitions(*keys, "n").select(*names)
    return rows.mapInArrow(run, f"a {kind}, b {kind}, differ long, h long, tile int").groupBy("a", "b", "h", "tile").agg(F.min("differ").alias("differ"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of which a set is similar enough; a's text goes once to each TOGETHER of its partners, whose texts go once a pair."""
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    parted = kept(pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / TOGETHER)).cast("int").alias("part")))
    routes = parted.select(F.col("b").alias("id"), "a", "part", F.lit(True).alias("partner")).unionByName(parted.select(F.col("a").alias("id"), "a", "part", F.lit(False).alias("partner")).distinct())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES))
    places = routes.select(place("id").alias("place")).distinct()
    near = texts.withColumn("place", place("doc_id")).join(F.broadcast(places), "place", "left_semi").select("doc_id", "text")
    rows = near.join(routes.hint("merge"), near["doc_id"] == routes["id"]).select("text", "a", "part", "partner", "id")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        key, pivots = None, []
        for batch in batches:
            data, offsets = string_buffer(batch.column(0))
            keyed = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            partner = batch.column(3).to_numpy(zero_copy_only=False)
            good = []
            for i, j in steps(offsets):
                at = offsets[i : j + 1]
                keys, bounds = _sets(data[at[0] : at[-1]], at - at[0])
                k = i
                while k < j:
                    if keyed[k] != key:
                        key, pivots = keyed[k], []
                    if not partner[k]:
                        pivots.append(keys[bounds[k - i] : bounds[k - i + 1]].copy())
                        k += 1
                        continue
                    e = k
                    while e < j and partner[e] and keyed[e] == key:
                        e += 1
                    mine, own = keys[bounds[k - i] : bounds[e - i]], bounds[k - i : e - i + 1] - bounds[k - i]
                    linked = np.zeros(e - k, bool)
                    for p in pivots:
                        linked |= _similar(p, mine, own)
                    good.append(k + np.flatnonzero(linked))
                    k = e
            if good:
                at = pa.array(np.concatenate(good))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(4).take(at)], names=["a", "b"])

    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "partner")
    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _similar(pivot: np.ndarray, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of several sorted sets, back to back, are similar enough to a sorted set: exact intersections by binary search."""
    n = np.diff(bounds)
    if not len(pivot) or not len(keys):
        return np.zeros(len(n), bool)
    met = pivot[np.minimum(np.searchsorted(pivot, keys), len(pivot) - 1)] == keys
    met = np.r_[0, np.cumsum(met)]
    both = met[bounds[1:]] - met[bounds[:-1]]
    return (n > 0) & (both * 100 >= (n + len(pivot) - both) * PER_CENT)


def _now(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """rows with a column of components brought up to date."""
    names = rows.columns
    return rows.join(known.select(F.col("id").alias(column), F.col("component").alias("now_")), column, "left").withColumn(column, F.coalesce("now_", column)).select(names)


def _linked(pairs: DataFrame, comps: DataFrame, links: DataFrame, known: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """known and links with those of candidate pairs (a, b, differ), and whether there are more of them now.

    Of each two components the most promising pair, twice, then all pairs that are still apart.
    """
    met = pairs.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(comps.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
    met, some = kept(met), False
    for last in (False, False, True):
        if met.isEmpty():
            break
        tried = met.select("a", "b")
        if not last:
            tried = kept(met.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.min_by(F.struct("a", "b"), F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b"))
        more = kept(_verified(tried, texts).join(met, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        if not more.isEmpty():
            some, links = True, kept(links.unionByName(more))
            known = components(links)
        if not last:
            met = kept(_now(_now(met, known, "ca"), known, "cb").where(F.col("ca") != F.col("cb")).join(tried, ["a", "b"], "left_anti"))
    return known, links, some


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id of those that links can reach)."""
    texts = _texts(docs, id_col, text_col)
    all_ = written(sketches(docs, id_col, text_col), "sketches")
    filled = all_.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = kept(filled.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("class")))
    of = kept(filled.select("doc_id", "n", "fp1", "fp2").join(classes, ["fp1", "fp2"]).select(F.col("doc_id").alias("id"), "n", "class").distinct())
    # an id with several sets ties their classes together
    tied = of.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where(F.col("a") != F.col("b"))
    tied = kept(of.join(tied.select("id", "a"), "id").where(F.col("class") != F.col("a")).select("a", F.col("class").alias("b")).distinct())

    # first round: each class and the pivot it shares most first shingles with
    reps = of.where(F.col("id") == F.col("class")).select(F.col("id").alias("doc_id")).distinct()
    first = filled.join(reps.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", F.explode("firsts").alias("h"))
    pivots = kept(first.groupBy("h").agg(F.min(F.struct("id", "n")).alias("p"), F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("h", "p"))
    stars = first.join(pivots, "h").where((F.col("id") != F.col("p.id")) & (F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * PER_CENT))
    stars = stars.groupBy("id", F.col("p.id").alias("a")).agg(F.count(F.lit(1)).alias("votes")).groupBy("id").agg(F.min_by("a", F.struct(-F.col("votes"), "a")).alias("a"))
    links = kept(_verified(kept(stars.select("a", F.col("id").alias("b"))), texts)).unionByName(tied)
    known = components(links)

    # (what grows with the documents is never broadcast, so that the plan is the same at every size)
    # second round: tiles of sets that share a first shingle and are not yet together
    of = kept(of.join(known.withColumnRenamed("id", "class"), "class", "left").select("id", "n", F.coalesce("component", "class").alias("comp")))
    shared = _shared(posts(docs, common_shingles(docs, id_col, text_col), id_col, text_col))
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
    tile = F.floor(band / BANDS).cast("int")
    # the lowest band of a tile is also the one above the tile before
    where = F.when(F.pmod(band, F.lit(BANDS)) == 0, F.array(tile, tile - 1)).otherwise(F.array(tile))
    placed = kept(shared.join(of.hint("merge"), "id").select("h", "id", "n", "comp", tile.alias("own"), F.explode(where).alias("tile")))
    lower = F.col("own") == F.col("tile")
    comps, every = kept(of.select("id", "comp").distinct()), False
    while True:
        tiles = placed.groupBy("h", "tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or(lower).alias("lower"), F.count(F.lit(1)).alias("m"))
        tiles = kept(tiles.where((F.col("lo") != F.col("hi")) & F.col("lower")).select("h", "tile", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
        members = placed.join(tiles.hint("merge"), ["h", "tile"]).select("h", "tile", "id", "n", "comp", lower.alias("lower"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "blocks")
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.select("h", "tile", "id", "n", "comp", "lower", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
        members = members.join(filled.select(F.col("doc_id").alias("id"), "n", "bits").distinct().hint("merge"), ["id", "n"])
        met = kept(_tile_pairs(members, every))
        dense = kept(met.where(F.col("a").isNull()).select("h", "tile").distinct())
        known, links, linked = _linked(met.where(F.col("a").isNotNull()).select("a", "b", "differ"), comps, links, known, texts)
        if dense.isEmpty():
            break
        # tiles with more pairs than were given, with what is now known of their sets
        every = not linked
        comps = kept(_now(comps, known, "comp"))
        placed = kept(_now(placed.join(dense, ["h", "tile"], "left_semi"), known, "comp"))

    # each document through its class
    classes = classes.join(known.withColumnRenamed("id", "class"), "class", "left").select("fp1", "fp2", F.coalesce("component", "class").alias("component"))
    out = all_.select("doc_id", "n", "fp1", "fp2").join(classes, ["fp1", "fp2"], "left")
    # a row without an id links with nothing, whatever it says
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(linked, "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that of the component's id.  Of rows that share that id the one of the smallest hash stays; rows without an id all stay."""
    gone = near_duplicates(docs, id_col, text_col).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("copy_")).distinct()
    left = docs.join(gone, docs[id_col].eqNullSafe(gone["copy_"]), "left_anti")
    # rows without an id are spread, those of one id follow its partition
    one = Window.partitionBy(id_col, F.when(F.col(id_col).isNull(), F.xxhash64(*docs.columns))).orderBy(F.xxhash64(*docs.columns))
    return left.withColumn("row_", F.row_number().over(one)).where((F.col("row_") == 1) | F.col(id_col).isNull()).drop("row_")
