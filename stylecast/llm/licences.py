"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory (DataFrame functions only).

A document's sections are each of its lines, each block of lines between blank ones, its
header (the first HEADER_LINES lines with a word together) and the whole text.  A section
and a template are sparse vectors of their words' counts times the words' inverse document
frequency over all texts of the corpus.  A document's own licence is that of the best
cosine over the threshold.  Templates marked whole are full texts of licences: they meet
whole texts only, have to be WHOLE_THRESHOLD alike, and come before all others, as full
texts quote notices, even those of other licences.  A document of which that section is a
good part acts as the licence file of its directory; documents without a licence of their
own inherit from the nearest directory above them that has such a file.

A section reaches the threshold only if it shares one of a template's anchors: its rarest
words, without which the rest is too light.  So only sections with an anchor are weighed;
this drops none that would be found.  Directories are resolved once each, not once a document.

Defined cases: null or empty texts have no licence of their own and may inherit; a null path
has no directory; ties go to the smaller name, then to lines before blocks, header and whole
text; equal rows give one result; other columns are ignored; an empty table gives an empty
result; rows without an id have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, written
from .licence_texts import FULL_TEXTS, TEMPLATES

HEADER_LINES, THRESHOLD, FILE_SHARE = 20, 0.6, 0.3
#: Cosine from which a text is that of a licence.
WHOLE_THRESHOLD = 0.85
#: Words of all templates together at most: they are broadcast.
MOST_TEMPLATE_WORDS = 1_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def sections(docs: DataFrame, id_col: str, text_col: str, header_lines: int = HEADER_LINES) -> DataFrame:
    """row (numbers the texts), doc_id, kind (0 line, 1 block of lines, 2 header, 3 whole text), k (its number), words, n_words (of the text)."""
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull() & F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    numbered = lambda kind, parts: F.filter(F.transform(parts, lambda p, k: F.struct(F.lit(kind).alias("kind"), k.cast("int").alias("k"), _words(p).alias("words"))), lambda s: F.size(s["words"]) > 0)
    rows = rows.withColumn("lines", numbered(0, F.split("text", "\n")))
    blocks = numbered(1, F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda b: F.contains(b, F.lit("\n"))))
    one = lambda kind, lines: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("k"), F.flatten(F.transform(lines, lambda s: s["words"])).alias("words")))
    rows = rows.withColumn("n_words", F.aggregate("lines", F.lit(0), lambda n, s: n + F.size(s["words"]))).where("n_words > 0")
    return rows.select("row", "doc_id", "n_words", F.inline(F.concat("lines", blocks, one(2, F.slice("lines", 1, header_lines)), one(3, F.col("lines")))))


def template_terms(templates: DataFrame, frequencies: DataFrame, total: int) -> DataFrame:
    """One row for each word of each template: template (its number), licence, whole, word, weight, norm, idf; frequencies: word, df."""
    rows = templates.select("template", "licence", "whole", F.explode(_words(F.col("notice"))).alias("word")).groupBy("template", "licence", "whole", "word").agg(F.count(F.lit(1)).alias("tf"))
    rows = rows.join(frequencies, "word", "left").withColumn("idf", F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    rows = rows.withColumn("weight", F.col("tf") * F.col("idf"))
    return rows.withColumn("norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("template"))))


def own_licences(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document with a licence of its own: doc_id, licence, score, share (of the text's words).

    templates: licence, notice, and whole (false where there is no such column).
    """
    templates = templates.select("licence", "notice", (F.coalesce("whole", F.lit(False)) if "whole" in templates.columns else F.lit(False)).alias("whole"))
    n_words = templates.agg(F.sum(F.size(_words(F.col("notice"))))).first()[0] or 0
    if n_words > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of {n_words} words together; {MOST_TEMPLATE_WORDS} can be broadcast")
    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    frequencies = cut(texts.select(F.explode(F.array_distinct(_words(F.col(text_col).cast("string")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    total = texts.count()
    numbered = templates.select(F.xxhash64("licence", "notice", "whole").alias("template"), "licence", "notice", "whole").distinct()
    terms = cut(template_terms(numbered, frequencies, total))
    # the rarest words of each template, until what is left is under the threshold by itself
    rarest = Window.partitionBy("template").orderBy(F.desc("idf"), "word").rowsBetween(0, Window.unboundedFollowing)
    bound = F.when(F.col("whole"), WHOLE_THRESHOLD).otherwise(threshold)
    anchors = terms.withColumn("left", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(rarest))).where(F.col("left") >= F.col("norm") * bound * 0.999999)
    anchors = anchors.select("whole", "word").distinct().collect()  # words of the templates: bounded above
    has = lambda whole: F.arrays_overlap("words", F.array(*(F.lit(r["word"]) for r in sorted(anchors) if r["whole"] == whole)).cast("array<string>"))

    found = sections(docs, id_col, text_col).where(has(False) | ((F.col("kind") == 3) & has(True)))
    found = written(found.select("row", "doc_id", "kind", "k", (F.size("words") / F.col("n_words")).alias("share"), F.size(F.array_distinct("words")).alias("distinct"), "words"), "licence_sections")
    heavy = F.broadcast(terms.select("word", "template", "licence", "whole", "norm", "idf", (F.col("weight") * F.col("idf")).alias("heavy")))  # words of the templates
    meets = ~F.col("whole") | (F.col("kind") == 3)
    section = ["row", "kind", "k"]

    # what the words outside a template weigh at least, as no idf is under 1, bounds its cosine before frequencies are joined
    spoken = found.select(*section, "distinct", F.size("words").alias("n"), F.explode("words").alias("word")).join(heavy, "word").where(meets)
    spoken = spoken.groupBy(*section, "distinct", "n", "template", "whole", "norm").agg(F.sum("heavy").alias("dot"), F.sum(F.col("idf") * F.col("idf")).alias("inside"), F.count(F.lit(1)).alias("n_inside"))
    outside = F.col("n") - F.col("n_inside")
    least = F.sqrt(F.col("inside") + outside * outside / F.col("distinct"))
    likely = spoken.where(F.col("dot") >= F.col("norm") * least * bound * 0.999999).select(*section).distinct()

    found = found.join(likely, section, "left_semi").select(*section, "doc_id", "share", F.explode("words").alias("word"))
    found = found.groupBy(*section, "doc_id", "share", "word").agg(F.count(F.lit(1)).alias("tf"))
    weighed = cut(found.join(frequencies, "word").withColumn("own", F.col("tf") * (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1)))
    norms = weighed.groupBy(*section, "doc_id", "share").agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("own_norm"))
    dots = weighed.join(heavy, "word").where(meets).groupBy(*section, "template", "licence", "whole", "norm").agg(F.sum(F.col("tf") * F.col("heavy")).alias("dot"))
    scored = dots.join(norms, section).withColumn("score", F.round(F.col("dot") / (F.col("own_norm") * F.col("norm")), 6)).where(F.col("score") >= bound)
    pick = F.min_by(F.struct("licence", "score", "share"), F.struct(~F.col("whole"), -F.col("score"), F.col("licence"), F.col("kind"), F.col("k"), -F.col("share")))
    return scored.groupBy("doc_id").agg(pick.alias("x")).select("doc_id", "x.*")


def _ancestors(path: Column) -> Column:
    """Directories of a path, the nearest first; the last is the root, an empty string."""
    parts = F.split(path, "/")
    return F.when(path.isNotNull(), F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def scanned(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """One row a document: doc_id, licence, score, origin ('own', 'inherited' or null), licence_dir."""
    own = cut(own_licences(docs, templates, id_col, text_col, threshold))
    places = docs.select(F.col(id_col).alias("doc_id"), F.element_at(_ancestors(F.col(path_col).cast("string")), 1).alias("dir")).distinct()
    known = cut(places.join(own, "doc_id", "left"))
    files = known.where((F.col("share") >= file_share) & F.col("dir").isNotNull()).groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("file_licence"))
    above = known.select("dir").where(F.col("dir").isNotNull()).distinct().select("dir", F.posexplode(_ancestors(F.concat("dir", F.lit("/")))).alias("depth", "up"))
    nearest = above.join(files.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.min_by(F.struct("up", "file_licence"), "depth").alias("near"))
    # texts without a directory would all meet in one task
    rows = known.where(F.col("dir").isNotNull()).join(nearest, "dir", "left").unionByName(known.where(F.col("dir").isNull()), allowMissingColumns=True)
    mine, near = F.col("licence").isNotNull(), F.col("near").isNotNull()
    return rows.select(
        "doc_id", F.coalesce("licence", "near.file_licence").alias("licence"), F.when(mine, F.col("score")).alias("score"),
        F.when(mine, F.lit("own")).when(near, F.lit("inherited")).alias("origin"), F.when(~mine & near, F.col("near.up")).alias("licence_dir"),
    )


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES, full_texts: tuple[tuple[str, str], ...] = FULL_TEXTS) -> DataFrame:
    return spark.createDataFrame([(*t, False) for t in templates] + [(*t, True) for t in full_texts], "licence string, notice string, whole boolean")


#: Lines of a page, and its host and directories.
PAGE_TEXT, PAGE_PATH = "<[^>]*>", "^[a-z]+://([^?#]*)"


def pages_and_documents(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """item (table_name and id), text, path: pages have tags as line breaks, host and path of the URL; documents have no path."""
    item = lambda name, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("table_name"), F.col(c).cast("long").alias("id"))).alias("item")
    path = F.regexp_extract("url", PAGE_PATH, 1)
    pages = pages.select(item("pages", "page_id"), F.regexp_replace("html", PAGE_TEXT, "\n").alias("text"), F.when(path != "", path).alias("path"))
    return pages.unionByName(documents.select(item("documents", "doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("path")))


def licence_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, full_texts: tuple[tuple[str, str], ...] = FULL_TEXTS) -> str:
    both = [(*t, False) for t in templates] + [(*t, True) for t in full_texts]
    rows = ", ".join("({}, '{}', '{}', {})".format(k, a, b.replace("'", "''"), w) for k, (a, b, w) in enumerate(both))
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
WITH t(nr, licence, notice, whole) AS (VALUES {rows}),
src AS (SELECT CASE WHEN page_id IS NOT NULL THEN {{'table_name': 'pages', 'id': CAST(page_id AS BIGINT)}} END AS item, regexp_replace(html, '{PAGE_TEXT}', chr(10), 'g') AS text, nullif(regexp_extract(url, '{PAGE_PATH}', 1), '') AS path FROM pages
        UNION ALL SELECT CASE WHEN doc_id IS NOT NULL THEN {{'table_name': 'documents', 'id': CAST(doc_id AS BIGINT)}} END, text, NULL FROM documents),
d AS (SELECT DISTINCT * FROM src),
a AS (SELECT item, text FROM src WHERE text IS NOT NULL AND item IS NOT NULL),
n AS (SELECT count(*) AS total FROM a),
f AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct({words.format("text")})) AS word FROM a) GROUP BY word),
tw AS (SELECT nr, licence, whole, word, count(*) AS tf FROM (SELECT nr, licence, whole, unnest({words.format("notice")}) AS word FROM t) GROUP BY ALL),
tx AS (SELECT nr, licence, whole, tw.word, ln((n.total + 1) / (coalesce(df, 0) + 1)) + 1 AS idf, tf FROM tw LEFT JOIN f ON tw.word = f.word CROSS JOIN n),
tn AS (SELECT nr, sqrt(sum(power(tf * idf, 2))) AS norm FROM tx GROUP BY nr),
ls AS (SELECT item, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM d WHERE text IS NOT NULL),
lw AS (SELECT item, k, {words.format("part")} AS words FROM ls WHERE regexp_matches(lower(part), '[a-z0-9]')),
lk AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY k) AS place FROM lw),
bs AS (SELECT item, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS k FROM (SELECT item, list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda b: contains(b, chr(10))) AS p FROM d WHERE text IS NOT NULL)),
w AS (SELECT item, 0 AS kind, k, unnest(words) AS word FROM lw
      UNION ALL SELECT item, 1, k, unnest({words.format("part")}) FROM bs
      UNION ALL SELECT item, 2, 0, unnest(words) FROM lk WHERE place <= {HEADER_LINES}
      UNION ALL SELECT item, 3, 0, unnest(words) FROM lw),
c AS (SELECT item, kind, k, word, count(*) AS tf FROM w GROUP BY ALL),
m AS (SELECT item, kind, k, sqrt(sum(power(tf * (ln((n.total + 1) / (df + 1)) + 1), 2))) AS own_norm, sum(tf) AS size FROM c JOIN f USING (word) CROSS JOIN n GROUP BY item, kind, k),
dots AS (SELECT item, kind, k, nr, licence, whole, sum(c.tf * tx.tf * idf * idf) AS dot FROM c JOIN tx ON c.word = tx.word AND (NOT whole OR kind = 3) GROUP BY ALL),
s AS (SELECT item, kind, k, licence, whole, round(dot / (own_norm * norm), 6) AS score, size / (SELECT size FROM m y WHERE y.item = dots.item AND y.kind = 3) AS share
      FROM dots JOIN m USING (item, kind, k) JOIN tn USING (nr)),
own AS (SELECT item, licence, score, share FROM s WHERE score >= CASE WHEN whole THEN {WHOLE_THRESHOLD} ELSE {THRESHOLD} END QUALIFY row_number() OVER (PARTITION BY item ORDER BY whole DESC, score DESC, licence, kind, k, share DESC) = 1),
ps AS (SELECT DISTINCT item, CASE WHEN path IS NOT NULL THEN array_to_string(string_split(path, '/')[:-2], '/') END AS dir FROM d),
kn AS (SELECT ps.item, dir, licence, score, share FROM ps LEFT JOIN own ON ps.item = own.item),
fi AS (SELECT dir, licence AS file_licence FROM kn WHERE share >= {FILE_SHARE} AND dir IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1),
ups AS (SELECT dir, unnest(range(len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM kn WHERE dir IS NOT NULL)),
ab AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[:len(string_split(dir, '/')) - depth], '/') AS up FROM ups),
near AS (SELECT ab.dir, up, file_licence FROM ab JOIN fi ON ab.up = fi.dir QUALIFY row_number() OVER (PARTITION BY ab.dir ORDER BY depth) = 1)
SELECT item.table_name AS table_name, item.id AS id, coalesce(licence, file_licence) AS licence, score,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN file_licence IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN licence IS NULL THEN up END AS licence_dir
FROM kn LEFT JOIN near ON kn.dir = near.dir
"""
