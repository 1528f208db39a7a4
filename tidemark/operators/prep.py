"""Preprocessing fitted on train rows only.

The fitted preprocessor is an ordinary ``pyspark.ml`` PipelineModel of native
stages, so it can be saved, loaded and applied anywhere Spark runs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import named
from tidemark.functions.quantiles import approx_quantiles, exact_medians
from tidemark.operators.policy import FeatureSpec
from tidemark.sources.tables import safe_name

#: Widest category dictionary; learners hold the matrix width on the driver.
MAX_CATEGORIES = 100_000


def number_sql(name: str) -> str:
    """NaN counts as missing, like NULL."""
    return f"nanvl(CAST(`{name}` AS DOUBLE), CAST(NULL AS DOUBLE))"


def literal_sql(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_medians(
    train: DataFrame, columns: Sequence[str], *, accuracy: int | None = None, **options
) -> dict[str, float | None]:
    """Exact medians of all columns together; ``accuracy`` opts into a sketch."""
    if accuracy is not None:
        found = approx_quantiles(train, {c: [0.5] for c in columns}, accuracy)
        return {c: q[0] for c, q in found.items()}
    return exact_medians(train, columns, **options)


def impute(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.expr(number_sql(c)), F.lit(v)) for c, v in values.items() if v is not None})


def _scale_aggregates(medians: Mapping[str, float | None]):
    """Per imputed column its mean and its population deviation."""
    filled = [F.coalesce(F.expr(number_sql(c)), F.lit(m)) for c, m in medians.items() if m is not None]
    return [f(x) for x in filled for f in (F.avg, F.stddev_pop)]


def _read_scaler(medians: Mapping[str, float | None], row) -> dict[str, tuple[float, float]]:
    columns = [c for c, m in medians.items() if m is not None]
    return {c: (row[2 * i], row[2 * i + 1] or 1.0) for i, c in enumerate(columns)}


def fit_scaler(train: DataFrame, medians: Mapping[str, float | None]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation after imputing; a constant column scales by 1."""
    aggregates = _scale_aggregates(medians)
    return _read_scaler(medians, train.agg(*aggregates).first()) if aggregates else {}


def standardize(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (named(c) - F.lit(mean)) / F.lit(scale) for c, (mean, scale) in scaler.items()})


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value, n): one partially aggregated pass for all columns."""
    cells = [F.struct(F.lit(c).alias("name"), named(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells))).where("value IS NOT NULL").groupBy("name", "value").agg(
        F.count("*").alias("n"))


def fit_categories(
    train: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES,
    sizes: Sequence[int] | None = None,
) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Most frequent value (ties: smallest) and the sorted values of each column.

    The dictionary size is checked before anything is collected.
    """
    if not columns:
        return {}, {}
    if sizes is None:
        sizes = train.agg(*[F.approx_count_distinct(named(c)) for c in columns]).first()
    wide = [c for c, n in zip(columns, sizes) if n > max_categories]
    if wide:
        raise ValueError(f"too many categories for one-hot columns: {', '.join(wide)}")
    seen = defaultdict(list)
    for row in category_counts(train, columns).collect():
        seen[row["name"]].append((-row["n"], row["value"]))
    modes = {c: min(seen[c])[1] for c in columns if seen[c]}
    return modes, {c: sorted(v for _, v in seen[c]) for c in modes}


@dataclass(frozen=True)
class Preprocessor:
    """Impute, scale, one-hot and assemble, with everything learnt from train."""

    pipeline: PipelineModel
    feature_names: tuple[str, ...]
    medians: Mapping[str, float]
    scaler: Mapping[str, tuple[float, float]]
    modes: Mapping[str, str]
    categories: Mapping[str, list[str]]
    helpers: tuple[str, ...]

    @property
    def feature_dim(self) -> int:
        return len(self.feature_names)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` plus the vector column ``features``."""
        return self.pipeline.transform(df).drop(*self.helpers)


def fit_preprocessor(
    train: DataFrame, spec: FeatureSpec, *, max_categories: int = MAX_CATEGORIES, **options
) -> Preprocessor:
    """Three aggregate passes over ``train``, whatever the column count.

    A column without any train value carries no information and is left out.
    """
    medians = {c: m for c, m in fit_medians(train, spec.numeric, **options).items() if m is not None}
    scales = _scale_aggregates(medians)
    row = train.agg(F.count(F.lit(1)), *scales, *[F.approx_count_distinct(named(c)) for c in spec.categorical]).first()
    scaler = _read_scaler(medians, row[1:])
    modes, categories = fit_categories(train, spec.categorical, max_categories, row[1 + len(scales):])
    return build_preprocessor(train, medians, scaler, modes, categories)


def build_preprocessor(
    train: DataFrame, medians: Mapping[str, float], scaler: Mapping[str, tuple[float, float]],
    modes: Mapping[str, str], categories: Mapping[str, list[str]],
) -> Preprocessor:
    """The preprocessor of known statistics; only the schema of ``train`` is read."""
    numbers = {c: f"num_{i}_{safe_name(c)}" for i, c in enumerate(scaler)}
    texts = {c: f"cat_{i}_{safe_name(c)}" for i, c in enumerate(modes)}
    projected = [
        f"(coalesce({number_sql(c)}, {literal_sql(medians[c])}) - {literal_sql(mean)}) / {literal_sql(scale)} AS {numbers[c]}"
        for c, (mean, scale) in scaler.items()]
    projected += [f"coalesce(CAST(`{c}` AS STRING), {quoted(modes[c])}) AS {texts[c]}" for c in modes]
    stages = [SQLTransformer(statement=", ".join(["SELECT *", *projected]) + " FROM __THIS__")]
    indexed = {c: f"{t}_ix" for c, t in texts.items()}
    encoded = {c: f"{t}_hot" for c, t in texts.items()}
    if modes:
        # An unseen value takes the extra last index, which dropLast maps to all zeros.
        stages += [
            StringIndexerModel.from_labels(categories[c], texts[c], indexed[c], handleInvalid="keep") for c in modes]
        encoder = OneHotEncoder(inputCols=list(indexed.values()), outputCols=list(encoded.values()), dropLast=True)
        # The indexer's column metadata names all categories, so this fit reads no rows.
        stages.append(encoder.fit(PipelineModel(stages).transform(train)))
    stages.append(VectorAssembler(inputCols=[*numbers.values(), *encoded.values()], outputCol="features"))
    names = tuple(scaler) + tuple(f"{c}_{v}" for c in modes for v in categories[c])
    helpers = (*numbers.values(), *texts.values(), *indexed.values(), *encoded.values())
    return Preprocessor(PipelineModel(stages), names, medians, scaler, modes, categories, helpers)
