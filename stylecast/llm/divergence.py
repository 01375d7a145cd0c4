"""Source divergence audit by iceberg prefix refinement.

Which terms of a language stand in at least ``least_docs`` of its documents is found from
prefixes: the distinct documents of every prefix of ``LEVELS[0]`` bytes are counted, prefixes
below the threshold go with all terms that begin so, the others are extended to the next
level, until only complete terms are left.  A term no longer than a level's prefixes is
complete there, and its own count decides.

Texts are read once: each step of texts of one language becomes a row of its distinct terms
and of (term, document, occurrences), written to the shared folder.  A level reads these rows,
leaves out terms whose prefix went (a filter of fixed size; what it lets through wrongly is
counted exactly), counts a step's documents by prefix, and only these counts are shuffled.

Each source of a language is then held against the language and against each other source.
Frequencies are integers of ``SCALE`` parts; terms that a source lacks are never listed: they
all have the same value, so that their number is enough.  Sources are compared in tiles of
``TILE`` by ``TILE``, so that a task's memory doesn't grow with the number of sources.

Defined cases: null text, language or source is ''; a document is a row, whatever its id, so
repeated rows are documents of their own; groups without terms count as groups; a language
without kept terms gives pairs of value 0; one with a single source has no pairs; ties are
ranked by the item's bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import distinct_spans, ink_spans, span_hashes, spread, steps, string_buffer, text_or_empty, written
from .keyset import found, key_filter

#: Bytes of a prefix at each level; beyond the last, every level doubles.
LEVELS = (2, 4, 8, 16)
LEAST_DOCS, SCALE, TOP_TERMS = 10, 1_000_000_000, 10
#: Bytes of text that a step holds, if it is more than one text; and sources on a side of a tile.
STEP, TILE = 3 << 20, 256

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32

#: terms stand one after the other, in order; term_docs: in how many documents each is; pair_doc, pair_n: document and occurrences of each term's documents.
POSTINGS = "lang string, terms binary, ends binary, term_docs binary, pair_doc binary, pair_n binary, doc_source binary, sources array<string>"


def _lang_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _step(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Distinct terms of a step in byte order (bytes, ends), the documents of each, and (document, occurrences) term by term."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data = _FOLD[data]
    starts, stops = ink_spans(_LETTER[data], offsets[1:])
    first, of = distinct_spans(data, starts, stops, span_hashes(data, starts, stops, fold_case=False))
    lengths = (stops - starts)[first]
    blob, ends = data[spread(starts[first], lengths)], np.cumsum(lengths, dtype=np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.r_[np.int64(0), ends]), pa.py_buffer(blob)])
    order = pc.sort_indices(terms).to_numpy() if len(first) else np.zeros(0, np.int64)
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    pairs, n = np.unique(rank[of] << 32 | doc, return_counts=True)
    lengths = lengths[order]
    return blob[spread((ends - (stops - starts)[first])[order], lengths)], np.cumsum(lengths), np.bincount(pairs >> 32, minlength=len(first)), pairs & 0xFFFFFFFF, n


def postings(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """One row for each step of texts of one language."""

    def gather(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def row(lang, part):
            data, offsets = string_buffer(part.column(2))
            for i, j in steps(offsets, STEP):
                own = offsets[i : j + 1]
                out = _step(data[own[0] : own[-1]], own - own[0])
                names = pc.dictionary_encode(part.column(1)[i:j])
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (out[0], *(x.astype(np.int32) for x in out[1:3]), *map(_narrow, out[3:]), names.indices.to_numpy().astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), *blobs, pa.array([names.dictionary.to_pylist()], pa.list_(pa.string()))], names=[c.split()[0] for c in POSTINGS.split(", ")])

        for batch in batches:
            langs = pc.dictionary_encode(batch.column(0))
            code = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                yield from row(lang, batch.take(pa.array(np.flatnonzero(code == k))))

    rows = docs.select(*(text_or_empty(c).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return rows.mapInArrow(gather, POSTINGS)


def _narrow(x: np.ndarray) -> np.ndarray:
    """As 16 bits where the numbers are that small."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.int32)


def _ints(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32)


def _pairs(batch, i: int, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The term of each (term, document) of a row, and the column of these pairs, whose width its length tells."""
    docs, value = _ints(batch.column("term_docs")[i]), batch.column(column)[i].as_buffer()
    term = np.repeat(np.arange(len(docs)), docs)
    return term, np.frombuffer(value, np.uint16 if value.size == 2 * len(term) else np.int32)


def _alive(batch, i: int, before: int, parents, length: int | None):
    """Of a row: terms whose prefix of ``before`` bytes was kept, the hash of their prefix of ``length`` bytes (None: whole), and the key of the language."""
    blob, ends = np.frombuffer(batch.column("terms")[i].as_buffer(), np.uint8), _ints(batch.column("ends")[i]).astype(np.int64)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    key = _lang_key(batch.column("lang")[i].as_py())
    alive = np.arange(len(ends))
    if before:
        alive = alive[(ends - starts) > before]
        alive = alive[found(parents.value, span_hashes(blob, starts[alive], starts[alive] + before, fold_case=False) ^ key)]
    starts, ends = starts[alive], ends[alive]
    stops = ends if length is None else np.minimum(ends, starts + length)
    return blob, alive, starts, stops, ends, span_hashes(blob, starts, stops, fold_case=False) ^ key


def _counted(rows: DataFrame, length: int, before: int, parents) -> DataFrame:
    """Documents of each prefix of ``length`` bytes within each step: lang, key, complete, h, docs."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                blob, alive, starts, stops, ends, h = _alive(batch, i, before, parents, length)
                if not len(alive):
                    continue
                complete = ends == stops
                new = np.r_[True, (h[1:] != h[:-1]) | complete[1:] | complete[:-1]]  # terms are in order, so a prefix's stand together
                run = np.full(int(alive[-1]) + 1, -1)
                run[alive] = np.cumsum(new) - 1
                term, doc = _pairs(batch, i, "pair_doc")
                inside = term <= alive[-1]
                of, doc = run[term[inside]], doc[inside].astype(np.int64)
                once = np.unique((of << 32 | doc)[of >= 0])
                docs = np.bincount(once >> 32, minlength=int(new.sum()))
                at = np.flatnonzero(new)
                lengths = (stops - starts)[at]
                keys = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.py_buffer(blob[spread(starts[at], lengths)])])
                lang = pa.array([batch.column("lang")[i].as_py()]).take(pa.array(np.zeros(len(at), np.int32)))
                yield pa.RecordBatch.from_arrays([lang, keys, pa.array(complete[at]), pa.array(h[at].view(np.int64)), pa.array(docs.astype(np.int64))], names=["lang", "key", "complete", "h", "docs"])

    columns = ("lang", "terms", "ends", "term_docs", "pair_doc")
    return rows.select(*columns).mapInArrow(count, "lang string, key binary, complete boolean, h long, docs long")


def kept_terms(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, h, docs of each term in so many documents of its language; rows as ``postings`` gives them."""
    kept, before, parents, level = None, 0, None, 0
    while True:
        length = LEVELS[level] if level < len(LEVELS) else 2 * before
        counted = _counted(rows, length, before, parents).groupBy("lang", "key", "complete", "h").agg(F.sum("docs").alias("docs"))
        enough = written(counted.where(F.col("docs") >= least_docs), "prefixes")
        whole = enough.where("complete").select("lang", F.col("key").cast("string").alias("term"), "h", "docs")
        kept = whole if kept is None else kept.unionByName(whole)
        longer = enough.where(~F.col("complete"))
        if longer.isEmpty():
            return kept
        parents, before, level = key_filter(longer), length, level + 1


def _occurrences(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term, n of the kept terms."""
    wanted = key_filter(kept)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                blob, alive, starts, stops, _, h = _alive(batch, i, 0, None, None)
                keep = found(wanted.value, h)
                (term, doc), (_, n) = _pairs(batch, i, "pair_doc"), _pairs(batch, i, "pair_n")
                names = batch.column("sources")[i].as_py()
                source = _ints(batch.column("doc_source")[i])[doc]
                inside = keep[term]
                cell, of = np.unique(term[inside].astype(np.int64) * len(names) + source[inside], return_inverse=True)
                total = np.bincount(of, weights=n[inside], minlength=len(cell)).astype(np.int64)
                at = cell // max(1, len(names))
                lengths = (stops - starts)[at]
                terms = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.py_buffer(blob[spread(starts[at], lengths)]))
                source = pa.array(names, pa.string()).take(pa.array(cell % max(1, len(names))))
                lang = pa.array([batch.column("lang")[i].as_py()]).take(pa.array(np.zeros(len(at), np.int32)))
                yield pa.RecordBatch.from_arrays([lang, source, terms, pa.array(total)], names=["lang", "source", "term", "n"])

    found_ = rows.mapInArrow(count, "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return found_.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")


def _frequency(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact beyond 64 bits."""
    return F.expr(f"1 + ((cast({n} + 2 AS decimal(20, 0)) * {SCALE}) div cast({total} + 2 * {terms} AS decimal(20, 0)))")


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _tile_sums(cells: DataFrame, absent: dict[str, np.ndarray]) -> DataFrame:
    """lang, a, b, part, n_terms: of two sources (by number, a < b), the sum over terms that stand in their tile, and the number of these terms.

    cells: lang, ti, tj, term, source number, p; absent: by language, the p of terms that a source lacks.
    """
    zeros = cells.sparkSession.sparkContext.broadcast(absent)

    def compare(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def changed(rows, names):
            new = np.ones(rows.num_rows, bool)
            new[1:] = False
            for c in names:
                col = rows.column(c).combine_chunks()
                new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
            return new

        sums: dict[tuple[str, int, int], list] = {}

        def add(rows):
            tile = np.flatnonzero(changed(rows, ("lang", "ti", "tj")))
            for i, j in zip(tile, [*tile[1:], rows.num_rows], strict=True):
                own = rows.slice(i, j - i)
                lang, ti, tj = (own.column(c)[0].as_py() for c in ("lang", "ti", "tj"))
                base = zeros.value[lang]
                left, right = base[ti * TILE : (ti + 1) * TILE], base[tj * TILE : (tj + 1) * TILE] if tj > ti else base[:0]
                term = np.cumsum(changed(own, ("term",))) - 1
                source, p = own.column("source").to_numpy(), own.column("p").to_numpy()
                at = np.where(source // TILE == ti, source - ti * TILE, len(left) + source - tj * TILE)
                total = np.zeros((len(left), len(right) or len(left)), np.int64)
                block = max(1, (1 << 21) // (len(left) + len(right)))
                for t in range(0, int(term[-1]) + 1, block):
                    inside = (term >= t) & (term < t + block)
                    full = np.tile(np.r_[left, right], (min(block, int(term[-1]) + 1 - t), 1))
                    full[term[inside] - t, at[inside]] = p[inside]
                    other = full[:, len(left) :] if tj > ti else full
                    for a in range(len(left)):
                        apart, both = full[:, a : a + 1] - other, full[:, a : a + 1] + other
                        total[a] += (apart * apart // both).sum(0)
                if (lang, ti, tj) in sums:
                    sums[lang, ti, tj][0] += total
                    sums[lang, ti, tj][1] += int(term[-1]) + 1
                else:
                    yield from told()  # tiles come one after the other
                    sums[lang, ti, tj] = [total, int(term[-1]) + 1]

        def told():
            for (lang, ti, tj), (total, n) in sums.items():
                a, b = np.nonzero(np.ones(total.shape, bool)) if tj > ti else np.triu_indices(len(total), 1)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(a), "a": a + ti * TILE, "b": b + tj * TILE, "part": total[a, b], "n_terms": np.full(len(a), n)})
            sums.clear()

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            last = int(np.flatnonzero(changed(rows, ("lang", "ti", "tj", "term")))[-1])  # its term may go on in the next batch
            rest = rows.slice(last)
            if last:
                yield from add(rows.slice(0, last))
        if rest is not None and rest.num_rows:
            yield from add(rest)
        yield from told()

    spread_ = cells.repartition("lang", "ti", "tj", "term").sortWithinPartitions("lang", "ti", "tj", "term")
    return spread_.mapInArrow(compare, "lang string, a long, b long, part long, n_terms long").groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("n_terms").alias("n_terms"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` holds each source against each other one of its language, ``term`` the terms that it overuses most."""
    rows = written(postings(docs, text_col, lang_col, source_col), "postings")
    kept = kept_terms(rows, least_docs)
    counts = written(_occurrences(rows, kept), "occurrences")
    order = Window.partitionBy("lang").orderBy("source")
    groups = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source")).distinct().withColumn("number", (F.row_number().over(order) - 1).cast("long"))
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang", "left")
    groups = groups.fillna(0, ["total", "terms"]).withColumn("lacks", F.when(F.col("terms") > 0, _frequency("0", "total", "terms")))
    groups = written(groups, "groups")

    totals = groups.groupBy("lang").agg(F.sum("total").alias("all_n"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("m")).join(totals, "lang")
    cells = counts.join(groups, ["lang", "source"]).withColumn("p", _frequency("n", "total", "terms"))
    over = cells.join(whole, ["lang", "term"]).withColumn("q", _frequency("m", "all_n", "terms")).where(F.col("p") > F.col("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence("p", "q").alias("value"))
    of_terms = of_terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    # one row a source at most: the result has one for each two of them
    absent: dict[str, np.ndarray] = {r["lang"]: np.array(r["lacks"]) for r in groups.where("terms > 0").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("number", "lacks"))).alias("s")).select("lang", F.col("s.lacks").alias("lacks")).toLocalIterator()}
    tiles = groups.groupBy("lang").agg((F.max("number").cast("int").alias("last")))
    block = F.expr(f"cast(number div {TILE} AS int)")
    dealt = cells.join(tiles, "lang").select("lang", "term", F.col("number").alias("source"), "p", block.alias("own"), F.explode(F.sequence(F.lit(0), F.expr(f"cast(last div {TILE} AS int)"))).alias("other"))
    dealt = dealt.select("lang", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "term", "source", "p")
    sums = _tile_sums(dealt, absent)
    one = groups.select("lang", F.col("source"), F.col("number").alias("a"), F.col("lacks").alias("lacks_a"), "terms")
    two = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("lacks").alias("lacks_b"))
    pairs = one.join(two, "lang").where(F.col("a") < F.col("b")).join(sums, ["lang", "a", "b"], "left").fillna(0, ["part", "n_terms"])
    value = F.when(F.col("terms") > 0, F.col("part") + (F.col("terms") - F.col("n_terms")) * _divergence("lacks_a", "lacks_b")).otherwise(F.lit(0))
    pairs = pairs.select("lang", value.cast("long").alias("value"), F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"))
    of_pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(best))
    return of_pairs.unionByName(of_terms)


DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN size USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)),
f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + ((coalesce(n, 0) + 2)::HUGEINT * {SCALE}) // (total + 2 * v)::HUGEINT AS p
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + ((sum(n) + 2)::HUGEINT * {SCALE}) // (any_value(whole) + 2 * any_value(v))::HUGEINT AS q
  FROM c JOIN size USING (lang) JOIN (SELECT lang, sum(n) AS whole FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
t AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM f JOIN l USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT 'pair' AS part, * FROM o UNION ALL BY NAME SELECT 'term' AS part, * FROM t)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
