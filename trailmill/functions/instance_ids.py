"""Reading the repo out of an instance id, in whatever spelling.

Spellings (fixed values): `owner__name-N`, `owner/name#N`, `owner_1776_name-N`, `owner_s_name-N`,
`owner__name.COMMIT.change__HASH`, each with blanks around, in any letter case, after a `dataset::` prefix or before a
`::chunkN` suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def core_id(instance_id: Column) -> Column:
    """The id in lower case without surrounding blanks, data-set prefix and chunk suffix; null if nothing is left."""
    return F.nullif(_core(instance_id), F.lit(""))


# Each step is one pattern that uses the step before once: Spark inlines columns, and a step used twice doubles the code.
def _core(instance_id: Column) -> Column:
    s = F.lower(F.regexp_replace(instance_id, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    s = F.regexp_replace(s, r"(::chunk\d+)+$", "")
    # A prefix that is no id itself.
    return F.regexp_replace(s, r"(?s)^(?:(?!__|/|_1776_|::).)*::", "")


def unified_id(instance_id: Column) -> Column:
    """`core_id` with the separator of owner and name, and that of the number, brought to one spelling."""
    return F.nullif(_unified(instance_id), F.lit(""))


def _unified(instance_id: Column) -> Column:
    # An id that has the separator already keeps it, unless a slash comes first.
    s = F.regexp_replace(_core(instance_id), r"(?s)^(?=[^/_]+/|(?!.*__))([^/_]+)(?:/|_1776_|_s_)", "$1__")
    return F.regexp_replace(s, r"#(\d+)$", "-$1")


def repo_name(instance_id: Column) -> Column:
    """`owner__name` in lower case if the id has that form, else null."""
    s = F.regexp_replace(_unified(instance_id), r"(-\d+|\.[0-9a-f]{6,40}\..*)$", "")
    return F.nullif(F.regexp_extract(s, r"^[^_/]+__.(?s:.*)\z", 0), F.lit(""))


def issue_suffix(instance_id: Column) -> Column:
    """What follows the repo in the id: `-N` or `.COMMIT.change__HASH`; '' if nothing does."""
    return F.regexp_extract(unified_id(instance_id), r"(-\d+|\.[0-9a-f]{6,40}\..*)$", 1)


def repo_from_instance_id(instance_id: Column) -> Column:
    """The plain rule: what stands before the last `-`, the whole id if there is none."""
    return F.regexp_replace(instance_id, r"-[^-]*\z", "")
