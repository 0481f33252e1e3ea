"""Symbol filters and classes, and interval codes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Instruments of traditional finance that the exchange lists.
ALLOWED = (
    "AAPLXUSDT", "TSLAXUSDT", "NVDAXUSDT", "GOOGLXUSDT", "METAXUSDT", "AMZNXUSDT", "MSFTXUSDT", "COINXUSDT",
    "HOODXUSDT", "MCDXUSDT", "SPXUSDT", "SPXPERP", "GASUSDT", "OILUSDT", "XAUTUSDT", "XAGUSDT",
)
# Parts of symbols that are wanted, and that are not.
WANTED, UNWANTED = ("XAU", "XAG", "GAS", "OIL", "SPX"), ("SPXL", "BANANA", "PERP")
# Exchange code, other names, folder, milliseconds; codes that are letters have no time of day.
INTERVALS = (
    ("1", "1m", "1min", 60_000), ("3", "3m", "3min", 180_000), ("5", "5m", "5min", 300_000), ("15", "15m", "15min", 900_000),
    ("30", "30m", "30min", 1_800_000), ("60", "1h,60m", "1hour", 3_600_000), ("120", "2h", "2hour", 7_200_000),
    ("240", "4h", "4hour", 14_400_000), ("360", "6h", "6hour", 21_600_000), ("720", "12h", "12hour", 43_200_000),
    ("D", "1d,daily", "daily", 86_400_000), ("W", "1w,weekly", "weekly", 604_800_000), ("M", "1M,monthly", "monthly", 2_592_000_000),
)
# Parts of symbols that tell what an instrument is; the first class that fits counts.
CLASSES = (
    ("index", ("SPX", "NAS", "DJI", "NDX", "DAX", "FTSE", "NIKKEI", "HSI", "ASX")),
    ("commodity", ("OIL", "GAS", "BRENT", "WTI", "NGAS")),
    ("metal", ("XAU", "XAG", "GOLD", "SILVER", "COPPER", "PLATINUM")),
    ("forex", ("EUR", "GBP", "JPY", "AUD", "CAD", "CHF", "NZD")),
)


def allowed(symbol: Column) -> Column:
    return symbol.isin(*ALLOWED)


def likely_stock(symbol: Column) -> Column:
    """A listed instrument in the tokenized-stock form; no other symbol is taken on its looks."""
    return symbol.endswith("XUSDT") & allowed(symbol)


def wanted(symbol: Column) -> Column:
    return symbol.rlike("|".join(WANTED)) & ~symbol.rlike("|".join(UNWANTED))


def not_crypto(symbol: Column, coins: list[str]) -> Column:
    """True where no coin code is part of the symbol."""
    return ~symbol.rlike("|".join(coins)) if coins else F.lit(True)


def classify(symbol: Column) -> Column:
    """The instrument's class; short symbols without the quote currency may be stocks."""
    found = F.when((F.length(symbol) < 15) & ~symbol.contains("USDT"), F.lit("possible stock")).otherwise(F.lit("other"))
    for name, parts in reversed(CLASSES):
        found = F.when(symbol.rlike("|".join(parts)), F.lit(name)).otherwise(found)
    return found


def interval_code(name: Column) -> Column:
    """The exchange's code of an interval name; daily for any other."""
    found = F.lit("D")
    for code, names, _, _ in INTERVALS:
        found = F.when(name.isin(code, *names.split(",")), F.lit(code)).otherwise(found)
    return found


def interval_table(spark):
    """``code, folder, millis`` of all intervals."""
    return spark.createDataFrame([(c, f, m) for c, _, f, m in INTERVALS], "code string, folder string, millis long")


def time_text(code: Column, millis: Column) -> Column:
    """UTC day, with the time of day for intervals below a day."""
    at = F.timestamp_millis(millis)
    return F.when(code.isin("D", "W", "M"), F.date_format(at, "yyyyMMdd")).otherwise(F.date_format(at, "yyyyMMdd HH:mm:ss"))
