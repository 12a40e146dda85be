"""Names, identifiers, labels and missing values: column expressions and column renames."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_nan(c: Column | str) -> Column:
    """NaN becomes null: aggregates skip nulls but are poisoned by NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def all_no_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: no_nan(c) for c, t in df.dtypes if t in ("double", "float")})


def clean_names(df: DataFrame) -> DataFrame:
    """Trims column names, joins words by ``_``, spells ``^2`` as ``r2`` and dots as ``_``."""
    return df.toDF(*[re.sub(r"\s+", "_", c.strip()).replace("^2", "r2").replace(".", "_") for c in df.columns])


def normalize_colnames(df: DataFrame) -> DataFrame:
    """Lower case, other characters than letters and digits as single ``_``; an empty name k becomes ``colk``."""
    made = [re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") for c in df.columns]
    return df.toDF(*[c or f"col{i}" for i, c in enumerate(made, 1)])


def rename_first_match(df: DataFrame, aliases: Mapping[str, Iterable[str]]) -> DataFrame:
    """Each target name that is absent takes its first candidate that is present."""
    names = {}
    for target, candidates in aliases.items():
        if target not in df.columns and (hit := next((c for c in candidates if c in df.columns), None)):
            names[hit] = target
    return df.withColumnsRenamed(names)


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def harmonize_sex(c: Column) -> Column:
    c = F.lower(F.trim(c))
    return F.when(c.isin("m", "male"), "M").when(c.isin("f", "female"), "F")


def experiment_from_path(path: Column, names: Iterable[str]) -> Column:
    """The only registered name in the file's name, or else in its whole path; null for none or several."""
    known = F.array(*[F.lit(n) for n in names])
    only = lambda text: F.filter(known, lambda n: F.contains(text, n))
    in_file, in_path = only(F.element_at(F.split(path, "/"), -1)), only(path)
    return F.when(F.size(in_file) == 1, in_file[0]).when((F.size(in_file) == 0) & (F.size(in_path) == 1), in_path[0])


def subject_uid(experiment: Column, subject: Column) -> Column:
    return F.format_string("E%02d_S%03d", experiment.cast("int"), subject.cast("int"))


def trailing_number(c: Column) -> Column:
    """The digits at the end as a number; null where there are none."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+)$", 1), F.lit("")).try_cast("int")


def parse_subject_ids(df: DataFrame, column: str) -> DataFrame:
    """(subject): distinct positive numbers at the end of the texts. Unparsable texts raise an error when read."""
    n = trailing_number(F.col(column))
    bad = F.raise_error(F.concat(F.lit("not a subject id: "), F.coalesce(F.col(column), F.lit("null"))))
    rows = df.select(F.when(n.isNull(), bad.cast("int")).otherwise(n).alias("subject"))
    return rows.where("subject > 0").distinct()


def coerce_numeric(c: Column) -> Column:
    """A finite number or null."""
    return no_nan(F.trim(c).try_cast("double"))


def factor_cast(c: Column) -> Column:
    return c.cast("string")


def prefix_columns(df: DataFrame, prefix: str, ids: Iterable[str]) -> DataFrame:
    """All columns but the ids take the prefix."""
    ids = list(ids)
    return df.select(*ids, *[F.col(c).alias(prefix + c) for c in df.columns if c not in ids])


def default_fill(c: Column, value: str = "unknown") -> Column:
    return F.coalesce(c, F.lit(value))


def label_normalise(label: Column, ordinal: Column) -> Column:
    """Without spaces and hyphens; an absent or empty one becomes ``Ch<ordinal>``."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(label), r"[\s-]", ""), F.lit("")), F.concat(F.lit("Ch"), ordinal.cast("string")))


def roi_label_normalise(c: Column) -> Column:
    """``lh-X`` becomes ``X-lh``."""
    return F.regexp_replace(c, r"^(lh|rh)-(.*)$", "$2-$1")


def hemisphere(c: Column) -> Column:
    """lh, rh, or null for a region of both."""
    return F.nullif(F.regexp_extract(c, r"-(lh|rh)$", 1), F.lit(""))


def region(c: Column) -> Column:
    return F.regexp_replace(c, r"-(lh|rh)$", "")


def sig_label(p: Column) -> Column:
    return F.when(p.isNull(), "n/a").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def is_ab_channel(label: Column) -> Column:
    return F.rlike(label, F.lit(r"^(A|B)0*[0-9]+$"))


def output_name(prefix: Column, subject: Column, tags: Column) -> Column:
    """``<prefix>NNN_tag1_tag2``."""
    return F.concat_ws("_", F.concat(prefix, F.format_string("%03d", subject.cast("int"))), F.array_compact(tags))


def phase_components(phase: str) -> dict[str, Column]:
    return {"sin_phase": F.sin(phase), "cos_phase": F.cos(phase)}


def signif(c: Column, digits: int) -> Column:
    """Rounded to significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


def melt(df: DataFrame, ids: list[str], name: str = "metric_name", value: str = "metric_value") -> DataFrame:
    """Wide to long: lower-case metric names, numbers only, missing values dropped."""
    metrics = [c for c in df.columns if c not in ids]
    rows = df.select(*ids, *[coerce_numeric(F.col(c).cast("string")).alias(c) for c in metrics])
    return rows.unpivot(ids, metrics, name, value).withColumn(name, F.lower(name)).where(F.col(value).isNotNull())
