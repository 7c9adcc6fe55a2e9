"""Column expressions for the labels behind tree lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def human_size(size: Column) -> Column:
    """``1.50 KB``; the last unit takes everything larger.

    ``bround`` goes first because ``%.2f`` rounds half up in the JVM, while the expected labels round
    half to even (1152 B is 1.12 KB).
    """
    label = None
    for power, unit in enumerate(UNITS):
        text = F.format_string(f"%.2f {unit}", F.bround(size.cast("double") / float(1024**power), 2))
        if unit == UNITS[-1]:
            return label.otherwise(text)
        fits = size < F.lit(1024 ** (power + 1))
        label = F.when(fits, text) if label is None else label.when(fits, text)


def stats_label(
    size: Column,
    tokens: Sequence[tuple[str, Column]] = (),
    created: Column | None = None,
    modified: Column | None = None,
) -> Column:
    """`` (size; model:n; created: d; modified: d)``; absent parts are left out."""
    parts = [human_size(size)]
    parts += [F.concat(F.lit(f"{model}:"), n.cast("string")) for model, n in tokens]
    for name, value in (("created", created), ("modified", modified)):
        if value is not None:
            parts.append(F.when(value != "", F.concat(F.lit(f"{name}: "), value)))
    return F.concat(F.lit(" ("), F.concat_ws("; ", *parts), F.lit(")"))
