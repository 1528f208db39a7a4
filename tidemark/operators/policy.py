"""Which columns a model may see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Columns that would leak the target or identify a row.
IDENTITY_COLUMNS = (
    "row_id", "split", "history_price", "history_date", "fullAddress", "postcode", "outcode", "country",
    "history_percentageChange", "history_numericChange",
)
# Third-party columns, by name prefix.
VENDOR_PREFIXES = ("saleEstimate_", "rentEstimate_")
# Vendor columns that stay out of the assisted features as well.
ASSISTED_EXCLUDED = (
    "saleEstimate_valueChange.numericChange", "saleEstimate_valueChange.percentageChange",
    "saleEstimate_valueChange.saleDate", "saleEstimate_ingestedAt",
)
# Numeric whatever their storage type.
FORCED_NUMERIC = ("history_year", "history_month")


@dataclass(frozen=True)
class FeatureSpec:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def columns(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


def by_type(schema: T.StructType, names, forced: tuple[str, ...] = ()) -> FeatureSpec:
    """Numeric and boolean columns are numbers, everything else a category."""
    numeric = tuple(
        n for n in names
        if n in forced or isinstance(schema[n].dataType, (T.NumericType, T.BooleanType)))
    return FeatureSpec(numeric, tuple(n for n in names if n not in numeric))


def mainline_policy(schema: T.StructType) -> FeatureSpec:
    """Property attributes and calendar only; no vendor estimate gets through."""
    names = [
        n for n in schema.names if n not in IDENTITY_COLUMNS and not n.startswith(VENDOR_PREFIXES)]
    spec = by_type(schema, names, FORCED_NUMERIC)
    assert_mainline(spec)
    return spec


def assert_mainline(spec: FeatureSpec) -> None:
    """The release rule: a mainline model never sees a vendor column."""
    leaked = [n for n in spec.columns if n.startswith(VENDOR_PREFIXES) or n in IDENTITY_COLUMNS]
    if leaked:
        raise ValueError(f"forbidden mainline features: {', '.join(leaked)}")


def assisted_policy(
    schema: T.StructType, *, rent_estimates: bool = True, vendor_categories: bool = True
) -> FeatureSpec:
    """Mainline columns plus vendor estimates.

    By default rent estimates and non-numeric vendor columns are kept too;
    the switches give the narrower reading of the rule.
    """
    names = [n for n in schema.names if n not in IDENTITY_COLUMNS + ASSISTED_EXCLUDED]
    if not rent_estimates:
        names = [n for n in names if not n.startswith("rentEstimate_")]
    spec = by_type(schema, names)
    if not vendor_categories:
        kept = tuple(n for n in spec.categorical if not n.startswith(VENDOR_PREFIXES))
        spec = FeatureSpec(spec.numeric, kept)
    return spec
