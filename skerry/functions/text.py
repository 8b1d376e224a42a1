"""Text: names without case and separators, tokens, colours, conditions from settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry import contracts


def normalized(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_ ]", ""))


def resolve(query: str, choices: dict) -> object:
    """A registered thing by its name, regardless of case, `-`, `_` and spaces."""
    plain = lambda s: s.lower().translate(str.maketrans("", "", "-_ "))
    found = [v for k, v in choices.items() if plain(k) == plain(query)]
    if not found:
        raise ValueError(f"{query!r} is none of {sorted(choices)}")
    return found[0]


def tokens(text: Column, mark: str) -> Column:
    """Parts of a text, stripped of white space at its ends, between literal marks; empty parts stay."""
    if not mark:
        raise ValueError("a mark to split at is needed")
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\\Q" + mark + "\\E", -1)


OPERATORS = {"lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v}


def conditions(config: dict[str, dict]) -> dict[str, Column]:
    """{name: {type: lt, lte, gt or gte, value}} to a predicate on the column of that name each."""
    out = {}
    for name, c in config.items():
        contracts.option(c.get("type"), OPERATORS, "type")
        out[name] = OPERATORS[c["type"]](F.col(name), F.lit(c["value"]))
    return out


def all_of(config: dict[str, dict]) -> Column:
    return reduce(lambda a, b: a & b, conditions(config).values(), F.lit(True))


def rgb(hex_color: Column) -> Column:
    """#rrggbb to an array of three shares of 255."""
    part = lambda i: F.conv(F.substring(F.ltrim(hex_color, F.lit("#")), i, 2), 16, 10).cast("double") / 255
    return F.array(part(1), part(3), part(5))
