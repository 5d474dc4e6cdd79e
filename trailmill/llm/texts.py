"""The texts inside a message list."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strings(messages: Column) -> Column:
    """Every `content`, each followed by its calls' `function.arguments`, without nulls; [] for null messages."""
    per_message = F.transform(
        messages,
        lambda m: F.concat(
            F.array(m["content"]),
            F.coalesce(F.transform(m["tool_calls"], lambda c: c["function"]["arguments"]), F.array().cast("array<string>")),
        ),
    )
    return F.coalesce(F.filter(F.flatten(F.filter(per_message, lambda x: x.isNotNull())), lambda s: s.isNotNull()), F.array().cast("array<string>"))


def n_chars(messages: Column) -> Column:
    """Code points of all `strings` together."""
    return F.aggregate(strings(messages), F.lit(0).cast("long"), lambda n, s: n + F.length(s))
