"""Currency conversion to US dollars. Rates say how much of a currency one dollar is: amounts are divided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Currency names, and two tables of rates (1 USD = x).
CODES = {
    "US Dollar": "USD", "Euro": "EUR", "Australian Dollar": "AUD", "Swiss Franc": "CHF", "Yuan": "CNY",
    "Shekel": "ILS", "Rupee": "INR", "UK Pound": "GBP", "Yen": "JPY", "Ruble": "RUB",
    "Canadian Dollar": "CAD", "Mexican Peso": "MXN", "Saudi Riyal": "SAR", "Brazil Real": "BRL", "Bitcoin": "BTC",
}
BANK_RATES = {
    "USD": 1.0000, "AUD": 1.4128, "BTC": 0.0001, "BRL": 5.6465, "CAD": 1.3193,
    "EUR": 0.8534, "MXN": 21.1431, "RUB": 77.804, "INR": 73.444, "SAR": 3.7511,
    "ILS": 3.377, "CHF": 0.915, "GBP": 0.7742, "JPY": 105.4, "CNY": 6.6976,
}
MIXED_RATES = {
    "USD": 1.0000, "EUR": 0.8814, "GBP": 0.7404, "JPY": 142.61, "CHF": 0.8214,
    "AED": 3.6725, "HKD": 7.8317, "SGD": 1.2843, "BSD": 1.0000, "SCR": 13.7500,
    "BBD": 2.0000, "BMD": 1.0000, "BZD": 2.0150, "VUV": 118.50, "XCD": 2.7000,
}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def rate(currency: Column, rates: dict[str, float], codes: dict[str, str] | None = None) -> Column:
    """The rate of a currency (by name, if ``codes`` are given), null if there is none."""
    code = F.try_element_at(_map(codes), currency) if codes else currency
    return F.try_element_at(_map(rates), code)


def unmapped(df: DataFrame, currency: str, rates: dict[str, float], codes: dict[str, str] | None = None) -> DataFrame:
    """Distinct currencies without a rate."""
    return df.filter(rate(F.col(currency), rates, codes).isNull()).select(currency).distinct()


def to_usd(df: DataFrame, amount: str, currency: str, rates: dict[str, float], codes: dict[str, str] | None = None) -> DataFrame:
    """``amount`` in dollars. A row with an unknown currency fails the query and names it."""
    known = rate(F.col(currency), rates, codes)
    stop = F.raise_error(F.concat(F.lit("unmapped currency: "), F.coalesce(F.col(currency), F.lit("null")))).cast("double")
    return df.withColumn(amount, F.col(amount) / F.coalesce(known, stop))
