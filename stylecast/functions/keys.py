"""Column functions on codes, names and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import BRAND_NAMES, BRAND_PREFIXES, GROSS_STATUSES, JUNK_PLACES, MARKETPLACES, NULL_WORDS, PLACEHOLDER_SKUS, SIZE_ALIAS, SIZE_ORDER, SIZE_TOKENS, SOLD_STATUSES, UNCLASSIFIED, WEBSITES


def _null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def _upper(c: Column) -> Column:
    return F.upper(F.trim(c))


def title(c: Column) -> Column:
    """Every run of letters begins with a capital, as Python's str.title does for Latin text."""
    words = F.regexp_extract_all(c, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def design_key(code: Column) -> Column:
    """The first two segments of a code; only the first if the second is a size."""
    segment, sizes = "[A-Z0-9]+", "|".join(t for t in SIZE_TOKENS if t.isalnum())
    return F.nullif(F.regexp_extract(_upper(code), rf"^({segment}(?=-(?:{sizes})(?![A-Z0-9]))|{segment}-{segment})", 1), F.lit(""))


def stock_design(code: Column) -> Column:
    """The colour-level design of letter series, else the design key."""
    return F.coalesce(_null_if_empty(F.regexp_extract(_upper(code), r"^([A-Z]+-\d+-\d{2})$", 1)), design_key(code))


def clean_design_no(raw: Column) -> Column:
    norm = stock_design(raw)
    return F.when(norm.isNotNull() & (norm != _upper(raw)), norm).otherwise(raw)


def design_and_size(code: Column) -> tuple[Column, Column]:
    """Design and size of a product code: three segments and the fourth for letter series, else two and the third."""
    up = _upper(code)
    parts = F.split(up, "-")
    colour = up.rlike(r"^[A-Z]+-\d+-\d{2}-")
    design = F.when(colour, F.array_join(F.slice(parts, 1, 3), "-")).otherwise(F.array_join(F.slice(parts, 1, 2), "-"))
    size = F.when(colour, F.get(parts, F.lit(3))).otherwise(F.get(parts, F.lit(2)))
    return design, F.trim(F.coalesce(size, F.lit("")))


def sku_key(code: Column, design: Column) -> Column:
    """One spelling of a SKU code: separators, an inner second design, a letter after the size, second names of sizes."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(_upper(c), r"[-_\s]+", "-"), r"^-+|-+$", "")
    key, prefix = norm(code), norm(F.coalesce(design, F.lit("")))
    sizes = "|".join(SIZE_ORDER)
    tail = F.substring(key, F.length(prefix) + 2, F.length(key))
    inner = F.regexp_extract(tail, rf"^\d+-\d+-((?:{sizes})(?:-.*)?)$", 1)
    key = F.when((prefix != "") & key.startswith(F.concat(prefix, F.lit("-"))) & (inner != ""), F.concat(prefix, F.lit("-"), inner)).otherwise(key)
    key = F.regexp_replace(key, rf"^(.*-(?:{sizes}))-[A-Z]$", "$1")
    for other, size in SIZE_ALIAS.items():
        key = F.regexp_replace(key, rf"^(.+)-{other}$", f"$1-{size}")
    return key


def size_of(sku: Column, design: Column) -> Column:
    rest = F.regexp_replace(F.substring(sku, F.length(design) + 1, F.length(sku)), "^-+", "")
    return F.coalesce(F.when(F.upper(sku).startswith(F.upper(design)), _null_if_empty(rest)), F.lit("UNKNOWN"))


def marketplace(channel: Column, source: Column) -> Column:
    name = F.lower(F.trim(channel))
    site = oms = None
    for word, label in WEBSITES:
        site = F.when(name.contains(word), label) if site is None else site.when(name.contains(word), label)
    for word, label in MARKETPLACES:
        oms = F.when(name.contains(word), label) if oms is None else oms.when(name.contains(word), label)
    return F.when(source.eqNullSafe("WEBSITE"), site.otherwise(channel)).otherwise(oms.otherwise(channel))


def _place(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def norm_place(c: Column) -> Column:
    t = F.regexp_replace(_place(c), r"\s+\d+$", "")
    return F.when(~F.lower(t).isin(*JUNK_PLACES) & t.rlike(r"\p{L}"), F.initcap(t))


def norm_warehouse(c: Column) -> Column:
    t = _place(c)
    return F.when(~F.lower(t).isin(*JUNK_PLACES) & ~F.lower(t).startswith("default") & t.rlike(r"\p{L}"), t)


def is_combo(product: Column, listing: Column) -> Column:
    has = lambda c, x: F.coalesce(c.contains(x), F.lit(False))
    return has(product, "&") | has(product, "--") | has(listing, "&")


def is_placeholder(product: Column) -> Column:
    out = F.lit(False)
    for p in PLACEHOLDER_SKUS:
        out = out | F.coalesce(_upper(product).startswith(p), F.lit(False))
    return out


def _is_one(status: Column, names: tuple[str, ...]) -> Column:
    """Whether it is one of the names, however spaced; most are spelled as they should be, which spares the pattern."""
    name = F.lower(F.trim(status))
    return F.coalesce(name.isin(*names) | F.regexp_replace(name, r"\s+", " ").isin(*names), F.lit(False))


def is_gross(status: Column) -> Column:
    return _is_one(status, GROSS_STATUSES)


def is_net(status: Column) -> Column:
    return _is_one(status, SOLD_STATUSES)


def is_return(status: Column) -> Column:
    return F.coalesce(F.lower(status).contains("return"), F.lit(False))


def norm_brand(c: Column) -> Column:
    raw = F.trim(F.coalesce(c, F.lit("")))
    key = F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]", "")
    out = F.when(key.isin("", "nan", "none", "na"), "")
    for p, name in BRAND_PREFIXES:
        out = out.when(key.startswith(p), name)
    for k, name in BRAND_NAMES:
        out = out.when(key == k, name)
    return out.otherwise(title(raw))


def clean_token(c: Column) -> Column:
    """Upper case, empty where it stands for nothing."""
    t = _upper(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(t.isin(*NULL_WORDS), "").otherwise(t)


def clean_display(c: Column) -> Column:
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.upper(t).isin(*NULL_WORDS), "").otherwise(t)


def clean_attribute(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    return F.when(F.upper(t).isin(*NULL_WORDS), "").otherwise(title(t))


def clean_neck(c: Column) -> Column:
    t = clean_attribute(c)
    return F.when((t != "") & ~t.endswith("Neck") & (F.size(F.split(t, " ")) <= 2), F.concat(t, F.lit(" Neck"))).otherwise(t)


def tier_order(tier: Column) -> Column:
    """A sort key: unclassified last, then by number."""
    number = F.regexp_replace(F.coalesce(tier, F.lit("")), r"\D", "")
    return F.when(F.coalesce(tier, F.lit(UNCLASSIFIED)) == UNCLASSIFIED, F.lit(1_000_000)).otherwise(F.coalesce(F.try_to_number(number, F.lit("999999")).cast("int"), F.lit(999_999)))


def unified_case(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds one spelling for names that differ in capitals only: the most used mixed one, else the title case."""
    spelled = df.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("_k"), F.col(name).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    mixed = (F.col("_v") != F.upper("_v")) & (F.col("_v") != F.lower("_v"))
    first = F.row_number().over(Window.partitionBy("_k").orderBy(F.when(mixed, 0).otherwise(1), F.desc("_n"), "_v"))
    best = spelled.withColumn("_r", first).where("_r = 1").select("_k", F.when(mixed, F.col("_v")).otherwise(title(F.col("_v"))).alias(out))
    return df.join(best, F.lower(df[name]) == best["_k"], "left").drop("_k")
