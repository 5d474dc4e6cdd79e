"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let

#: What may not occur in generated code that is to be run.
BANNED = ("os.system", "subprocess", "shutil.rmtree", "__import__", "eval(", "exec(", "open(", "compile(")

_SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"


def trim_ws(c: Column) -> Column:
    """Without white space, in the sense of Unicode, at both ends."""
    return F.regexp_replace(F.regexp_replace(c, rf"\A{_SPACE}+", ""), rf"{_SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; never null."""
    return F.coalesce(trim_ws(c) == "", F.lit(True))


def json_string_length(c: Column) -> Column:
    """Characters of the string as JSON with its quotes, non-ASCII left as it is; 4 for null."""
    short = F.length(c) - F.length(F.regexp_replace(c, r'["\\\n\r\t\x08\f]', ""))
    long = F.length(c) - F.length(F.regexp_replace(c, r"[\x00-\x07\x0B\x0E-\x1F]", ""))
    return F.coalesce(F.length(c) + 2 + short + 5 * long, F.lit(4))


def elide(output: Column, limit: int = 10_000, keep: int = 5_000) -> Column:
    """An observation below `limit` characters as it is, else its head and tail around the number left out."""
    warning = "<warning>\nThe output of your last command was too long.\nPlease try a different command that produces less output.\n</warning>\n"
    long = F.concat(
        F.lit(warning + "<output_head>\n"), F.substring(output, 1, keep), F.lit("\n</output_head>\n<elided_chars>\n"),
        (F.length(output) - limit).cast("string"), F.lit(" characters elided\n</elided_chars>\n<output_tail>\n"), F.right(output, F.lit(keep)), F.lit("\n</output_tail>"),
    )
    return F.when(F.length(output) < limit, F.concat(F.lit("<output>\n"), output, F.lit("</output>"))).otherwise(long)


def error_tail(output: Column, prefix: str = "(truncated)\n", keep: int = 1_000) -> Column:
    """The last `keep` characters with a prefix."""
    return F.concat(F.lit(prefix), F.right(output, F.lit(keep)))


def extract_code(completion: Column) -> Column:
    """Of the fenced blocks the last with `def `, else the last, else the whole text; null if nothing is left."""
    def bare(code: Column) -> Column:
        inner = trim_ws(F.regexp_replace(F.regexp_replace(code, r"(?i)\A```(?:python)?\s*", ""), r"\s*```\z", ""))
        return F.when(code != "", F.when(code.startswith("```"), inner).otherwise(code))

    def choose(blocks: Column) -> Column:
        functions = F.filter(blocks, lambda b: b.contains("def "))
        return let(functions, lambda f: F.when(F.size(f) > 0, F.element_at(f, -1)).when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise(trim_ws(completion)))

    blocks = F.transform(F.regexp_extract_all(completion, F.lit(r"(?is)```(?:python)?\s*\n?(.*?)```"), F.lit(1)), trim_ws)
    return let(let(blocks, choose), bare)


def is_safe_code(code: Column) -> Column:
    """Holds none of BANNED, whatever the letter case; null for null."""
    low = F.lower(code)
    found = F.lit(False)
    for token in BANNED:
        found = found | low.contains(token)
    return ~found


def task_prompt(text: Column, tests: Column) -> Column:
    """The prompt of a code task: its text and its first three tests."""
    return F.concat(
        F.lit("You are an expert Python programmer, and here is your task:\n"), trim_ws(text), F.lit("\nYour code should pass these tests:\n"),
        F.array_join(F.slice(tests, 1, 3), "\n"), F.lit("\nPut your complete solution in a single ```python ... ``` code block."),
    )


def import_lines(setup: Column, listed: bool = False) -> Column:
    """The lines, or items, that are not blank; [] for null."""
    lines = setup if listed else F.split(setup, r"\r\n|\n|\r")
    return F.coalesce(F.filter(lines, lambda x: ~is_blank(x)), F.array().cast("array<string>"))


def container_image(instance_id: Column, image_name: Column, prefix: str, separator: str, suffix: str = ":latest") -> Column:
    """The given image, else prefix + id with `__` replaced, in lower case."""
    return F.coalesce(image_name, F.lower(F.concat(F.lit(prefix), F.replace(instance_id, F.lit("__"), F.lit(separator)), F.lit(suffix))))


def fingerprint(*settings: Column | str, separator: str = "\x1f") -> Column:
    """16 hexadecimal digits that stand for a list of settings."""
    return F.substring(F.sha2(F.concat_ws(separator, *settings), 256), 1, 16)


def round_up(n: Column, block: int) -> Column:
    return F.ceil(n / block) * block
