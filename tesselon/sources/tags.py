"""A translator of tags and roles with the interface of a dictionary.

Tags and roles are strings here, so every translation is the string itself, in both directions; what asks a translator keeps
working, and `in_use` answers what a dictionary would: which of some keys or tags a table of versions holds at all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TagTranslator:
    """Identities, singly and in bulk; with a table of versions, lookups of what is in use."""

    def __init__(self, versions: DataFrame | None = None):
        self.versions = versions

    def key(self, key: str) -> str:
        return key

    def tag(self, key: str, value: str) -> tuple[str, str]:
        return key, value

    def role(self, role: str) -> str:
        return role

    def keys(self, keys: Iterable[str]) -> dict[str, str]:
        return {k: k for k in keys}

    def tags(self, tags: Iterable[tuple[str, str]]) -> dict[tuple[str, str], tuple[str, str]]:
        return {t: t for t in tags}

    def roles(self, roles: Iterable[str]) -> dict[str, str]:
        return {r: r for r in roles}

    def in_use(self, keys: Iterable[str] = (), tags: Iterable[tuple[str, str]] = ()) -> tuple[set[str], set[tuple[str, str]]]:
        """Those of the keys and of the tags that some version has, in one scan."""
        if self.versions is None:
            raise ValueError("a table of versions is needed")
        keys, tags = list(keys), list(tags)
        value = lambda k: F.element_at(F.col("tags"), F.lit(k))
        found = [F.max(value(k).isNotNull()).alias(f"k{i}") for i, k in enumerate(keys)]
        found += [F.max(F.coalesce(value(k) == v, F.lit(False))).alias(f"t{i}") for i, (k, v) in enumerate(tags)]
        if not found:
            return set(), set()
        row = self.versions.agg(*found).first()
        return {k for i, k in enumerate(keys) if row[f"k{i}"]}, {t for i, t in enumerate(tags) if row[f"t{i}"]}
