"""Line dedup with a segment-partition edit join (DataFrame functions only).

Of equal lines the first occurrence stays (by document id, then place): lines are equal if
their lengths and 96 bits of hashes are.  Of lines of ``min_chars`` characters or more, one
that has an earlier line within one edit goes everywhere too; in shorter ones an edit makes
another line as often as not.

Lines within one edit of each other are near copies.  A line is split into two segments
(the threshold plus one): a near copy has one of them intact, and, as the other differs by
one edit at most, one half of that as well.  So each line is indexed under four substring
hashes, each leaving out one quarter, along with its length; and it probes the index of
lines that are one shorter, with what follows the quarter shifted by one.  Groups under
one hash are verified pair by pair with a banded bit-parallel edit distance of the quarter
that is left out.  A group of more than ``MOST_TOGETHER`` lines isn't paired: as its lines
differ within one quarter only, each is keyed by what remains when one character of that
quarter goes, and is verified against the earliest line under the same key (lines of one
length), or against the shorter line that remains (lengths that differ), which is as exact
and linear.

Defined cases: a null text has no lines and stays null; an empty one has none to drop;
lines without a word stay; rows without an id stay as they are; rows that share an id are
taken as one document and lose lines of the same numbers; other columns are ignored by
``dropped_lines`` and kept by ``deduplicated``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Characters of a line that is compared with others by edit distance at least.
MIN_CHARS = 20
#: Lines under one hash that are paired with each other; more are keyed anew.
MOST_TOGETHER = 32
#: Hash places of what is looked for: what is broadcast to leave out the rest before it is shuffled has no more rows.
PLACES = 1 << 18


def _bounds(n: Column) -> list[Column]:
    """Where the four quarters of a line of n characters begin and end."""
    half = F.ceil(n / 2).cast("int")
    return [F.lit(0), F.ceil(half / 2).cast("int"), half, half + F.ceil((n - half) / 2).cast("int"), n]


def _key(line: Column, n: Column, quarter: int, more: int) -> Column:
    """Hash of a line's rest without one quarter, as a line of n characters has it; the line has ``more`` characters more."""
    b = _bounds(n)
    left = F.substring(line, F.lit(1), b[quarter])
    right = F.substring(line, b[quarter + 1] + more + 1, n + more)
    return F.xxhash64(F.lit(quarter), n, left, F.lit("\0"), right)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no (from 0), line, n (characters), hash, tail (32 more bits): the lines with a word."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
    rows = rows.where(F.trim("line", F.lit(" \t\x0b\x0c\r")) != "")
    return rows.withColumn("n", F.length("line")).withColumn("hash", F.xxhash64("line")).withColumn("tail", F.hash("n", "line"))


def _distance_within_one(x: Column, y: Column) -> Column:
    """Whether the edit distance of two arrays of characters is 1 at most: one pass over y with a band of three rows of x held as bits.

    vp and vn hold where the distance grows or falls from row to row of the band, and low
    is the distance at its lowest row; the last step walks up to the end of x.
    """
    width, full = 3, 7
    n, m = F.size(x), F.size(y)

    def column(acc: Column, j: Column) -> Column:
        c = F.get(y, j)
        match = sum((F.when(F.get(x, j - 1 + k) == c, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)), F.lit(0))
        vp, vn = acc["vp"], acc["vn"]
        d0 = ((((match.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(vn)).bitwiseAND(F.lit(full))
        hp = vn.bitwiseOR((F.lit(full) - d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(F.lit(full) - down.bitwiseOR(hp)).alias("vp"), down.bitwiseAND(hp).alias("vn"),
            (acc["low"] + F.when(d0 >= F.lit(1 << (width - 1)), F.lit(0)).otherwise(F.lit(1))).alias("low"),
        )

    start = F.struct(F.lit(6).alias("vp"), F.lit(0).alias("vn"), F.lit(1).alias("low"))

    def end(acc: Column) -> Column:
        over = lambda bits: sum((F.when((F.lit(k) >= n - m + 1) & (bits.bitwiseAND(F.lit(1 << k)) != 0), F.lit(1)).otherwise(F.lit(0)) for k in range(2)), F.lit(0))
        return acc["low"] - (over(acc["vp"]) - over(acc["vn"]))

    return (F.abs(n - m) <= 1) & F.when(m == 0, True).otherwise(F.aggregate(F.sequence(F.lit(0), m - 1), start, column, end) <= 1)


def distinct_lines(lines: DataFrame, min_chars: int) -> DataFrame:
    """One row for each distinct line: hash, tail, n, first (where it stands first), times, and its keys, which are the same everywhere.

    lines: doc_id, line_no, line, n, hash, tail.
    """
    n = F.col("n")
    keyed = lines.select("doc_id", "line_no", "n", "hash", "tail", *(F.when(n >= min_chars, _key(F.col("line"), n - more, q, more)).alias(f"k{more}{q}") for more in (0, 1) for q in range(4)))
    return keyed.groupBy("hash", "tail", "n").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("times"), *(F.min(f"k{more}{q}").alias(f"k{more}{q}") for more in (0, 1) for q in range(4)))


def near_copies(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct lines that have an earlier line within one edit: first (where such a line stands first)."""
    keys = distinct.where(F.col("k00").isNotNull()).select("hash", F.inline(F.array(*(F.struct(F.col(f"k{more}{q}").alias("key"), F.lit(4 * more + q).alias("kind")) for more in (0, 1) for q in range(4)))))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("together"), F.min("hash").alias("a"), F.max("hash").alias("b"), F.min("kind").alias("kind")).where((F.col("a") != F.col("b")) & (F.col("kind") < 4))
    members = keys.join(met.select("key", "together").hint("shuffle_hash"), "key")  # few keys meet: the smaller side by far
    members = cut(members.select("key", "together", "hash", (F.col("kind") >= 4).alias("longer"), (F.col("kind") % 4).alias("quarter")).join(distinct.select("hash", "n", "first"), "hash"))

    few = members.where(F.col("together") <= MOST_TOGETHER)
    a, b = few.where(~F.col("longer")).alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.first") != F.col("b.first")) & (F.col("b.longer") | (F.col("a.hash") <= F.col("b.hash"))))
    pairs = pairs.select("a.quarter", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("n", "first")))

    many = _by_remainder(members.where(F.col("together") > MOST_TOGETHER), docs, id_col, text_col)
    pairs = cut(pairs.unionByName(many).groupBy("n_a", "n_b", "first_a", "first_b").agg(F.min("quarter").alias("quarter")))

    # the characters as columns of their own, split once a line
    texts = cut(_texts(pairs.select(F.explode(F.array("first_a", "first_b")).alias("first")).distinct(), docs, id_col, text_col).select("first", F.split("line", "").alias("chars")))
    for s in "ab":
        pairs = pairs.join(texts.select(F.col("first").alias(f"first_{s}"), F.col("chars").alias(f"chars_{s}")), f"first_{s}")
    # all but one quarter is equal
    bounds = F.array(*_bounds(F.least("n_a", "n_b")))
    begin = F.get(bounds, F.col("quarter"))
    part = lambda s: F.slice(f"chars_{s}", begin + 1, F.get(bounds, F.col("quarter") + 1) - begin + F.col(f"n_{s}") - F.least("n_a", "n_b"))
    # as a lambda's variables they are cut out once a pair, not once a character
    near = F.exists(F.array(F.struct(part("a").alias("x"), part("b").alias("y"))), lambda p: _distance_within_one(p["x"], p["y"]))
    return pairs.where(near).select(F.greatest("first_a", "first_b").alias("first")).distinct()


def _places(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.pmod(F.xxhash64(column), F.lit(PLACES)).alias("place")).distinct()


def _texts(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The text of each wanted line (first), from the document where it stands."""
    at = wanted.select("first", F.col("first.doc_id").alias("at_doc"), F.col("first.line_no").alias("at_line"))
    holders = docs.withColumn("place", F.pmod(F.xxhash64(id_col), F.lit(PLACES))).join(F.broadcast(_places(at, "at_doc")), "place", "left_semi")
    lines = _lines(holders, id_col, text_col)
    return lines.join(at, (lines["doc_id"] == F.col("at_doc")) & (F.col("line_no") == F.col("at_line"))).groupBy("first").agg(F.min("line").alias("line"))


def _by_remainder(members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of each line with the earliest line that is left with the same text and place when one character of the quarter goes."""
    texts = _texts(members.select("first").distinct(), docs, id_col, text_col)
    rows = members.join(texts, "first")
    n = F.col("n") - F.col("longer").cast("int")
    bounds = F.array(*_bounds(n))
    begin, end = F.get(bounds, F.col("quarter")), F.get(bounds, F.col("quarter") + 1) + F.col("longer").cast("int")
    without = F.xxhash64("key", F.substring("line", F.lit(1), F.col("at")), F.lit("\0"), F.substring("line", F.col("at") + 2, F.col("n")))
    # equal lengths: the same place goes in both; else the shorter line stays whole
    same = rows.where(~F.col("longer")).withColumn("at", F.explode_outer(F.when(end > begin, F.sequence(begin, end - 1)))).where(F.col("at").isNotNull()).withColumn("rest", F.xxhash64(without, F.col("at")))
    shorter = rows.where(~F.col("longer")).withColumn("rest", F.xxhash64("key", "line"))
    longer = rows.where("longer").withColumn("at", F.explode(F.sequence(begin, end - 1))).withColumn("rest", F.xxhash64("key", F.concat(F.substring("line", F.lit(1), F.col("at")), F.substring("line", F.col("at") + 2, F.col("n")))))
    same = cut(same.select("rest", "n", "first", "quarter"))
    first = same.groupBy("rest").agg(F.min(F.struct("first", "n")).alias("e"), F.max("first").alias("hi")).where(F.col("e.first") != F.col("hi")).select("rest", F.col("e.n").alias("n_a"), F.col("e.first").alias("first_a"))
    one = shorter.select("rest", F.col("n").alias("n_a"), F.col("first").alias("first_a"))

    def with_(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("rest", "quarter", F.col("n").alias("n_b"), F.col("first").alias("first_b"))
        return a.join(b, "rest").where(F.col("first_a") != F.col("first_b")).drop("rest")

    return with_(first, same).unionByName(with_(one, longer))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document that loses lines: doc_id, dropped (array of line numbers, from 0)."""
    lines = _lines(docs, id_col, text_col)
    distinct = cut(distinct_lines(lines, min_chars))
    near = near_copies(distinct, docs, id_col, text_col).withColumn("near", F.lit(True))
    verdict = distinct.select("hash", "tail", "n", "first", "times").join(near, "first", "left").where((F.col("times") > 1) | F.col("near"))
    verdict = cut(verdict.select("hash", "tail", "n", "first", F.coalesce("near", F.lit(False)).alias("near")))
    # a line that very many documents hold makes a skewed side, which is split: the verdict has it once
    out = lines.select("hash", "tail", "n", "doc_id", "line_no").join(verdict, ["hash", "tail", "n"]).where(F.col("near") | ~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    return out.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with all their columns, without the dropped lines, plus n_lines and n_dropped."""
    gone = dropped_lines(docs, id_col, text_col, min_chars).withColumnRenamed("doc_id", "doc_id_").withColumnRenamed("dropped", "dropped_")
    rows = docs.join(gone, docs[id_col].eqNullSafe(gone["doc_id_"]), "left")
    parts = F.split(F.col(text_col).cast("string"), "\n")
    kept = F.when(F.col("dropped_").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(parts, lambda x, k: ~F.array_contains(F.col("dropped_"), k)), "\n"))
    n_lines = F.coalesce(F.when(F.col(text_col) != "", F.size(parts)), F.lit(0)).cast("long")
    return rows.select(*(kept.alias(c) if c == text_col else docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")), n_lines.alias("n_lines"), F.coalesce(F.size("dropped_"), F.lit(0)).cast("long").alias("n_dropped"))


LINES_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM s),
e AS (SELECT * FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
u AS (SELECT line, length(line) AS n, min({{'d': doc_id, 'l': line_no}}) AS first FROM e GROUP BY line),
k AS (SELECT line, n, first, left(line, CAST(floor(m / 2) AS INT)) AS lk, right(line, CAST(floor(m / 2) AS INT)) AS rk, m
      FROM (SELECT *, unnest([n, n - 1]) AS m FROM u WHERE n >= {MIN_CHARS})),
near AS (SELECT DISTINCT b.line FROM k a JOIN k b ON a.m = b.m AND a.lk = b.lk WHERE a.first < b.first AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1
         UNION SELECT DISTINCT b.line FROM k a JOIN k b ON a.m = b.m AND a.rk = b.rk WHERE a.first < b.first AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1),
v AS (SELECT l.doc_id, l.line_no, l.line, coalesce(u.line IS NOT NULL AND (near.line IS NOT NULL OR u.first <> {{'d': l.doc_id, 'l': l.line_no}}), false) AS gone
      FROM l LEFT JOIN u ON l.line = u.line LEFT JOIN near ON l.line = near.line),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text FROM v GROUP BY doc_id)
SELECT d.doc_id, o.text AS text, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE o.n_lines END AS n_lines, coalesce(o.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
