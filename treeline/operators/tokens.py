"""Token counts per model."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name prefixes and what serves them.
BYTE_PAIR_PREFIXES = ("gpt-", "o1-")
PIECE_PREFIXES = ("gemini-", "palm-")
REMOTE_PREFIXES = ("claude-",)
RATIO_PREFIX = "chars-"


@dataclass(frozen=True)
class TokenModel:
    """A model name and the expression that counts a text's tokens.

    ``native`` models are cheap expressions and run in the pass that measures all files; the others only
    see files that are kept.
    """

    name: str
    count: Callable[[Column], Column]
    native: bool = False

    @property
    def column(self) -> str:
        """Name of the count column in wide tables."""
        return "tokens:" + re.sub(r"[ ,;{}()\n\t=]", "_", self.name)


def ratio_model(name: str) -> TokenModel:
    """``chars-R``: one token per R code points, rounded up; R is any positive number."""
    try:
        ratio = float(name.replace(RATIO_PREFIX, ""))
    except ValueError:
        raise ValueError(f"no number in token model {name!r}") from None
    if not ratio > 0 or math.isnan(ratio):
        raise ValueError(f"the ratio of token model {name!r} must be positive")
    return TokenModel(name, lambda text: F.ceil(F.length(text) / F.lit(ratio)).cast("bigint"), True)


def token_models(names: Sequence[str], extra: Sequence[TokenModel] = ()) -> list[TokenModel]:
    """Models by name, checked before any job starts. Others than ``chars-R`` come through ``extra``: a name and an expression."""
    known = {m.name: m for m in extra}
    models = []
    for name in names:
        if name in known:
            models.append(known[name])
        elif name.startswith(RATIO_PREFIX):
            models.append(ratio_model(name))
        elif name.startswith(BYTE_PAIR_PREFIXES):
            raise ValueError(f"{name!r} needs a TokenModel of yours, given as extra")
        elif name.startswith(PIECE_PREFIXES):
            raise ValueError(f"{name!r} needs a TokenModel of yours, given as extra")
        elif name.startswith(REMOTE_PREFIXES):
            raise ValueError(f"{name!r} is counted by a remote service only, which jobs do not call")
        else:
            raise ValueError(f"unknown token model {name!r}")
    return models


def with_counts(contents: DataFrame, models: Sequence[TokenModel]) -> DataFrame:
    """One count column per model; NULL where a file has no text."""
    return contents.withColumns({m.column: F.when(F.col("has_text"), m.count(F.col("text"))) for m in models})


def unpivot_counts(wide: DataFrame, keys: Sequence[str], models: Sequence[TokenModel]) -> DataFrame:
    """Long form ``keys, model, n``; absent counts give no row."""
    pairs = F.array(*[F.struct(F.lit(m.name).alias("model"), F.col(f"`{m.column}`").cast("bigint").alias("n")) for m in models])
    return wide.select(*keys, F.inline(pairs)).where(F.col("n").isNotNull())


def token_counts(contents: DataFrame, models: Sequence[TokenModel]) -> DataFrame:
    """``repo_id, path, model, n`` for every file with text."""
    return unpivot_counts(with_counts(contents, models), ["repo_id", "path"], models)


def totals(wide: DataFrame, models: Sequence[TokenModel], by: Sequence[str] = ()) -> DataFrame:
    """Sums of the per-file counts: ``by..., model, n``."""
    summed = wide.groupBy(*by).agg(*[F.sum(f"`{m.column}`").alias(m.column) for m in models])
    return unpivot_counts(summed, list(by), models)


def token_map(models: Sequence[TokenModel]) -> Column:
    """``{model: n}`` of a wide row, without absent counts."""
    pairs = [F.struct(F.lit(m.name).alias("key"), F.col(f"`{m.column}`").alias("value")) for m in models]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
