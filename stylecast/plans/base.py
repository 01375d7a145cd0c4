"""Frames over the shared tables that many queries start from, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import GROSS_STATUSES, SIZE_TOKENS, SOLD_STATUSES
from ..sources import orders
from ..sources.shared import new_path
from .fixtures import TODAY, VIEWS, order_lines, view

NOW = f"DATE '{TODAY.isoformat()}'"


#: Folders of the written base frames by application, folder of the tables, and name.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A base frame that many steps start from: written once an application, then read; a folder that is gone is written anew."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key in _WRITTEN:
        try:
            return spark.read.parquet(_WRITTEN[key])
        except AnalysisException:
            pass
    path = new_path(spark, what)
    make().write.parquet(path)
    _WRITTEN[key] = path
    return spark.read.parquet(path)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned lines, sorted by date within a file, so that a range of dates reads few row groups."""
    return once(spark, sf_dir, "cleaned", lambda: orders.clean(order_lines(spark, sf_dir), TODAY, by="l_orderkey"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales base with category and sub-category."""

    def make() -> DataFrame:
        # written first, so that its own size and not that of all parts decides how it is joined
        styles = once(spark, sf_dir, "styles", lambda: view(spark, sf_dir, "attributes_v").select("style", "category", "sub_category").coalesce(1))
        return orders.sales_base(cleaned(spark, sf_dir)).join(styles, "style", "left").fillna("Unclassified", ["category", "sub_category"])

    return once(spark, sf_dir, "sales", make)


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.labelled(cleaned(spark, sf_dir)).where("net")


def _list(names) -> str:
    return ", ".join("'" + n + "'" for n in names)


def design_sql(code: str) -> str:
    two = f"nullif(regexp_extract(upper(trim({code})), '^([A-Z0-9]+-[A-Z0-9]+)', 1), '')"
    return f"CASE WHEN split_part({two}, '-', 2) IN ({_list(SIZE_TOKENS)}) THEN split_part({two}, '-', 1) ELSE {two} END"


def chunk_sql(d: str) -> str:
    return f"make_date(year({d}), month({d}), CASE WHEN day({d}) <= 7 THEN 1 WHEN day({d}) <= 15 THEN 8 WHEN day({d}) <= 23 THEN 16 ELSE 24 END)"


MARKET_SQL = """CASE WHEN source = 'WEBSITE' THEN CASE WHEN lower(trim(channel_name)) LIKE '%mokosh%' THEN 'MOKOSH' WHEN lower(trim(channel_name)) LIKE '%colorsofearth%' THEN 'Color''s Of Earth' ELSE channel_name END
 WHEN lower(channel_name) LIKE '%amazon%' THEN 'Amazon' WHEN lower(channel_name) LIKE '%flipkart%' THEN 'Flipkart' WHEN lower(channel_name) LIKE '%meesho%' THEN 'Meesho' WHEN lower(channel_name) LIKE '%myntra%' THEN 'Myntra'
 WHEN lower(channel_name) LIKE '%nykaa%' THEN 'Nykaa' WHEN lower(channel_name) LIKE '%wishlink%' THEN 'Amazon' WHEN lower(channel_name) LIKE '%ajio%' THEN 'Ajio' ELSE channel_name END"""
GROSS_SQL = f"lower(trim(order_status)) IN ({_list(GROSS_STATUSES)})"
NET_SQL = f"lower(trim(order_status)) IN ({_list(SOLD_STATUSES)})"

VIEWS["clean_v"] = f"""SELECT DISTINCT * FROM orders_v WHERE product_sku_code NOT LIKE '%&%' AND product_sku_code NOT LIKE '%--%' AND listing_sku_code NOT LIKE '%&%'
 AND upper(trim(product_sku_code)) NOT LIKE 'INACTIVE%' AND upper(trim(product_sku_code)) NOT LIKE 'FREEBIE-POUCH%' AND upper(trim(product_sku_code)) NOT LIKE 'CTA-K%'
 AND lower(channel_name) NOT LIKE '%shopify%' AND order_date <= {NOW}"""
VIEWS["sales_v"] = f"""SELECT s.*, coalesce(category, 'Unclassified') AS category, coalesce(sub_category, 'Unclassified') AS sub_category FROM (
 SELECT {design_sql('product_sku_code')} AS style, product_sku_code AS sku, order_date AS day, strftime(order_date, '%Y-%m') AS month, {chunk_sql('order_date')} AS chunk_start,
        {MARKET_SQL} AS marketplace, source, qty, total FROM clean_v WHERE {GROSS_SQL}) s
 LEFT JOIN (SELECT style AS style_, category, sub_category FROM attributes_v) a ON s.style = a.style_ WHERE style IS NOT NULL"""
VIEWS["net_v"] = f"SELECT * FROM clean_v WHERE {NET_SQL}"
