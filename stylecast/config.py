"""Business rules as data: statuses, sizes, marketplaces, thresholds.  All are parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Order statuses that count as sold (net) and as gross sale, in lower case.
SOLD_STATUSES = (
    "delivered", "shipped", "in transit", "ready to ship", "ready for pickup", "packed", "new", "processing", "pending",
    "manifested", "out for delivery", "picked up", "reached at destination", "delayed",
)
GROSS_STATUSES = (
    "delivered", "new", "rto delivered", "manifested", "out for delivery", "reverse closed", "return received",
    "cancelled return received", "shipped", "cancel init", "ready to ship", "in transit", "return init", "packed",
    "rto in transit", "reached at destination", "reverse delivered", "undelivered", "reverse in transit",
    "partial return received", "rto processing", "partial cancelled return received", "rto out for delivery",
    "return rejected", "pending", "reverse out for delivery", "reverse out for pickup", "delayed", "reverse cancelled",
    "picked up", "reverse not picked", "damaged", "rto undelivered", "reverse manifest", "processing", "lost",
    "misrouted", "out of delivery area", "reached at origin", "reverse picked up",
)
# Size names, and second names of sizes.
SIZE_TOKENS = ("S", "M", "L", "XL", "XXL", "XXXL", "2XL", "3XL", "4XL", "5XL", "FREE SIZE", "FREESIZE")
SIZE_ORDER = ("XXS", "XS", "S", "M", "L", "XL", "XXL", "2XL", "XXXL", "3XL", "4XL", "5XL", "6XL", "7XL", "8XL")
SIZE_ALIAS = {"2XL": "XXL", "3XL": "XXXL"}
# Marketplaces by a keyword of the channel's name, in order.
MARKETPLACES = (("amazon", "Amazon"), ("flipkart", "Flipkart"), ("meesho", "Meesho"), ("myntra", "Myntra"), ("nykaa", "Nykaa"), ("wishlink", "Amazon"), ("ajio", "Ajio"))
WEBSITES = (("mokosh", "MOKOSH"), ("colorsofearth", "Color's Of Earth"))
BRAND_PREFIXES = (("mokosh", "Mokosh"), ("jturritopsis", "J.Turritopsis"), ("curlytales", "Curly Tales"), ("colorsofearth", "C.O.E"))
BRAND_NAMES = (("coe", "C.O.E"), ("coloursofearth", "C.O.E"))
# What stands for nothing.
JUNK_PLACES = ("", "unknown", "nan", "na", "null", "none", "n/a", "-")
NULL_WORDS = ("", "UNKNOWN", "NOT APPLIED", "NOT_APPLIED", "-", "N/A", "NA", "NONE")
PLACEHOLDER_SKUS = ("INACTIVE", "FREEBIE-POUCH", "CTA-K")
UNCLASSIFIED = "Unclassified"
TIER_PREFIX = "T"

# Production factor and the health, risk and priority parts of each lifecycle stage.
STAGES = {
    "Emerging": (1.40, 0.85, 0.35, 0.90),
    "Growing": (1.25, 0.95, 0.15, 0.95),
    "Stable": (1.00, 0.60, 0.30, 0.50),
    "Reviving": (1.15, 0.70, 0.50, 0.70),
    "Declining": (0.50, 0.25, 0.80, 0.20),
    "Dead": (0.00, 0.00, 1.00, 0.00),
}


@dataclass(frozen=True)
class Config:
    """Thresholds; dates that the operators take as now are given with each call."""

    runrate_days: int = 60
    runrate_spike: float = 2.0
    runrate_min_clean: int = 21
    blend: float = 0.5
    horizon: int = 40
    lead_days: int = 84
    service_z: float = 1.65
    p80_z: float = 0.841621
    hist_weeks: int = 8
    launch_window: int = 20
    dead_days: int = 60
    grow: float = 0.20
    decline: float = -0.30
    winner: float = 1.00
    tier_cuts: tuple[float, ...] = (0.40, 0.70, 0.90)
    axis_start: date = date(1995, 4, 3)
    min_launch: date = date(2015, 1, 1)


DEFAULT = Config()
