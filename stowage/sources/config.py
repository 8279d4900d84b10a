"""Configuration text: key = value lines, key := value to reset a list, quotes and # comments."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_line = re.compile(r"\s*([A-Za-z_][\w]*)\s*(:?=)\s*(.*?)\s*$").match


def parse_line(line: str) -> tuple[str, str, bool] | None:
    """Key, value and whether a list is reset; None for blank lines and comments."""
    if not line.strip() or line.lstrip().startswith("#"):
        return None
    if not (m := _line(line)):
        raise ValueError(f"not a setting: {line!r}")
    value = m[3]
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = re.sub(r"\\(.)", r"\1", value[1:-1])
    else:
        value = re.sub(r"\s+#.*$", "", value)
    return m[1], value, m[2] == ":="


def parse(text: str, read: Callable[[str], str] | None = None) -> dict[str, list[str]]:
    """All values of each key, in order. A line ". path" stands for the text of another file, which ``read`` returns."""
    out: dict[str, list[str]] = {}
    for line in text.splitlines():
        if read and (named := re.match(r"\s*\.\s+(\S.*?)\s*$", line)):
            for key, values in parse(read(named[1]), read).items():
                out[key] = [*out.get(key, []), *values]
        elif found := parse_line(line):
            key, value, reset = found
            out[key] = [value] if reset else [*out.get(key, []), value]
    return out


def overlay(base: dict[str, list[str]], own: dict[str, list[str]], append: frozenset[str] = frozenset()) -> dict[str, list[str]]:
    """A client's settings over the global ones; keys in ``append`` take both."""
    return base | {k: base.get(k, []) + v if k in append else v for k, v in own.items()}


def as_rows(spark: SparkSession, settings: dict[str, list[str]]) -> DataFrame:
    rows = [(k, i, v) for k, vs in settings.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "key string, ord int, value string")


def lines(settings: dict[str, list[str]], names: list[str]) -> list[str]:
    """Lines "name = value" of the settings that one side sends to the other; lists have a line for each value."""
    return [f"{name} = {value}" for name in names for value in settings.get(name, [])]


def from_lines(sent: list[str], names: list[str]) -> dict[str, list[str]]:
    """The settings in such lines; names that aren't to be sent are left out."""
    found = parse("\n".join(sent))
    return {name: found[name] for name in names if name in found}
