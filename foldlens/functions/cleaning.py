"""Canonical categories, bins, paths and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised gender labels and what they become.
GENDERS = {"man": "male", "male": "male", "woman": "female", "female": "female", "other/unclear": "unclear", "unclear": "unclear", "unknown": "unknown", "missing": "missing"}
#: Appearance labels that stay as they are.
APPEARANCES = ("white", "black", "asian", "indian", "latino hispanic", "middle eastern", "unclear", "unknown", "missing")
#: Tokens that identify nothing.
NO_IDENTITY = ("", "unknown", "missing", "nan")


def normalized(text: Column) -> Column:
    """Trimmed and lower-cased; blank or NULL becomes 'missing'."""
    clean = F.lower(F.trim(text.cast("string")))
    return F.when(clean.isNull() | (clean == ""), "missing").otherwise(clean)


def number(text: Column) -> Column:
    """A double, NULL where the text is no number (or NaN)."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def right_closed(value: Column, edges: list[tuple[float, str]]) -> Column:
    """The label of the first edge that is not below ``value``; NULL above all and for NULL."""
    out = F.when(value <= edges[0][0], edges[0][1])
    for edge, label in edges[1:]:
        out = out.when(value <= edge, label)
    return out


def age_proxy(age: Column) -> Column:
    """Audit bins, right-closed; ages outside of 0 ... 120 are missing."""
    age = number(age)
    bins = right_closed(age, [(17, "0-17"), (59, "18-59"), (120, "60+")])
    return F.when(age.between(0, 120), bins).otherwise("missing")


def age_group_model(age: Column) -> Column:
    """The model input's bins; an unusable age is the text 'nan', as the models were trained with."""
    age = number(age)
    bins = right_closed(age, [(17, "child"), (29, "young_adult"), (44, "adult"), (64, "middle_aged"), (200, "senior")])
    return F.coalesce(F.when(age > -1, bins), F.lit("nan"))


def age_display_legacy(group: Column) -> Column:
    """The display buckets of the model's bins: 18-59 really goes to 64 here."""
    return (
        F.when(group == "child", "0-17")
        .when(group.isin("young_adult", "adult", "middle_aged"), "18-59")
        .when(group == "senior", "60+")
        .otherwise("unknown")
    )


def mapped(value: Column, mapping: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, value), F.lit(default))


def gender_proxy(raw: Column) -> Column:
    return mapped(normalized(raw), GENDERS, "unmapped")


def appearance_proxy(raw: Column) -> Column:
    value = normalized(raw)
    return F.when(value.isin(*APPEARANCES), value).otherwise("unmapped")


def composite(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("missing")) for p in parts])


def first_present(df: DataFrame, names: list[str], default: str) -> Column:
    """The first of ``names`` that ``df`` has, else a constant."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(default))


def identifies(value: Column, strip: bool = False) -> Column:
    """Whether an identifier is known. Only one of the callers strips blanks."""
    text = F.lower(F.trim(value.cast("string")) if strip else value.cast("string"))
    return value.isNotNull() & ~text.isin(*NO_IDENTITY)


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def without_prefix(path: Column, prefix: str) -> Column:
    """``path`` below ``prefix``; a path elsewhere is an error, as it would silently mismatch."""
    prefix = prefix.replace("\\", "/").rstrip("/") + "/"
    bad = F.raise_error(F.concat(F.lit("path lacks the explicit prefix: "), path))
    return F.when(F.startswith(posix(path), F.lit(prefix)), F.substring(posix(path), len(prefix) + 1, 1 << 30)).otherwise(bad)


def path_parts(path: Column) -> dict[str, Column]:
    """Split (first of three parts or more), label (parent folder, if there is one) and lower-cased base name of a relative path."""
    parts = F.split(posix(path), "/")
    return {
        "archive_split": F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(1))).otherwise("unknown"),
        "archive_label": F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise("unknown"),
        "basename": F.lower(F.element_at(parts, -1)),
    }


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")
