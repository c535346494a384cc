"""Opening stores from properties, and the command line around it."""

from __future__ import annotations

import argparse
import re
from collections.abc import Callable

from pyspark.sql import SparkSession

from tesselon.operators.pipeline import Store
from tesselon.sources.store import open_store


def properties(text: str) -> dict[str, str]:
    """key = value lines; # and ! start comments; ${key} stands for another key's value."""
    out = {}
    for line in text.splitlines():
        if line.strip() and line.strip()[0] not in "#!":
            key, _, value = re.sub(r"\s*[=:]\s*", "=", line.strip(), count=1).partition("=")
            out[key] = value
    for _ in range(len(out)):
        out = {k: re.sub(r"\$\{([^}]+)\}", lambda m: out.get(m[1], m[0]), v) for k, v in out.items()}  # noqa: B023
    return out


def connect(spark: SparkSession, props: dict[str, str], f: Callable[[Store], object]) -> object:
    """f of the store at props["store"] (tables with props["prefix"] before their names)."""
    if "store" not in props:
        raise ValueError("the properties name no store")
    return f(open_store(spark, props["store"], props.get("prefix", "")))


def arguments(argv: list[str] | None = None) -> dict[str, str]:
    """--props FILE, --store PATH, --prefix NAME; what is given on the line wins."""
    parser = argparse.ArgumentParser(prog="tesselon")
    parser.add_argument("--props")
    parser.add_argument("--store")
    parser.add_argument("--prefix")
    given = parser.parse_args(argv)
    props = {}
    if given.props:
        with open(given.props) as file:
            props = properties(file.read())
    return props | {k: v for k in ("store", "prefix") if (v := getattr(given, k)) is not None}
