"""Public-suffix rules and the domain hierarchy that follows from them.

The rules are a small table that is joined once per label depth. Each join is a broadcast hash join
against the same table, so finding the suffix of a name needs neither a shuffle nor a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.functions.names import is_domain, is_domain_or_wildcard
from scangraph.functions.urls import url_host

RULE, WILDCARD, EXCEPTION = 1, 2, 4
MAX_RULE_LINES = 200_000  # bounds the broadcast table; the public list has about 16,000 lines


@dataclass(frozen=True)
class SuffixRules:
    """Suffix rules by the tail of the name they speak about.

    ``table`` has ``tail``, ``icann`` and ``any``; the last two are sums of RULE, WILDCARD and
    EXCEPTION, without and with the private section. ``depth`` is the label count of the longest tail.
    """

    table: DataFrame
    depth: int

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> SuffixRules:
        """Read a list in the format of publicsuffix.org, which tells its sections by marker lines."""
        lines = [row.value.strip() for row in spark.read.text(path).take(MAX_RULE_LINES + 1)]
        if len(lines) > MAX_RULE_LINES:
            raise ValueError(f"{path} has more than {MAX_RULE_LINES} lines and is no suffix list")
        border = next((i for i, line in enumerate(lines) if "===BEGIN PRIVATE DOMAINS===" in line), len(lines))
        rules = [line.split()[0] if line and not line.startswith("//") else "" for line in lines]
        return cls.of(spark, filter(None, rules[:border]), filter(None, rules[border:]))

    @classmethod
    def of(cls, spark: SparkSession, icann: Iterable[str], private: Iterable[str] = ()) -> SuffixRules:
        """Build the lookup table. A rule also counts for the IDNA form of its labels."""
        flags: dict[str, list[int]] = {}
        for section, rules in enumerate((icann, private)):
            for rule in rules:
                kind = EXCEPTION if rule.startswith("!") else WILDCARD if rule.startswith("*.") else RULE
                tail = rule.lower().removeprefix("!").removeprefix("*.")
                for form in {tail, tail.encode("idna").decode("ascii")}:
                    known = flags.setdefault(form, [0, 0])
                    known[1] |= kind
                    if section == 0:
                        known[0] |= kind
        table = pa.table(
            {
                "tail": pa.array(list(flags), pa.string()),
                "icann": pa.array([f[0] for f in flags.values()], pa.int32()),
                "any": pa.array([f[1] for f in flags.values()], pa.int32()),
            }
        )
        depth = max((tail.count(".") + 1 for tail in flags), default=0)
        return cls(F.broadcast(spark.createDataFrame(table)), depth)


def with_suffix_length(df: DataFrame, name: str, rules: SuffixRules, private: bool, out: str) -> DataFrame:
    """Add the number of labels of the public suffix of column ``name``; null when no rule matches."""
    labels = F.split(F.lower(F.col(name)), r"\.")
    count = F.size(labels)
    flags = F.col("any" if private else "icann")
    joined = df
    for k in range(1, rules.depth + 1):
        side = rules.table.select(F.col("tail").alias(f"_tail{k}"), flags.alias(f"_flags{k}"))
        tail = F.when(count >= k, F.substring_index(F.lower(F.col(name)), ".", -k))
        joined = joined.withColumn(f"_key{k}", tail).join(side, F.col(f"_key{k}") == F.col(f"_tail{k}"), "left")

    def has(k: int, kind: int) -> Column:
        return F.col(f"_flags{k}").bitwiseAND(kind) > 0

    # The longest matching rule wins; an exception is one label shorter than it reads.
    candidates = []
    for n in range(rules.depth + 1, 0, -1):
        if n <= rules.depth:
            candidates.append(F.when(has(n, EXCEPTION), n - 1))
            candidates.append(F.when(has(n, RULE), n))
        if n >= 2:
            candidates.append(F.when((count >= n) & has(n - 1, WILDCARD), n))
    length = F.coalesce(*candidates) if candidates else F.lit(None).cast("int")
    helpers = [f"_{part}{k}" for k in range(1, rules.depth + 1) for part in ("key", "tail", "flags")]
    return joined.withColumn(out, length).drop(*helpers)


def with_chain_length(df: DataFrame, name: str, rules: SuffixRules) -> DataFrame:
    """Add ``_name``, the name with plain dots, and ``_length``, the number of names in its chain.

    Both are null for an invalid name. A bare suffix has length 0; an unknown last label acts as a
    suffix.
    """
    dotted = F.translate(F.col(name), "。．｡", "...")
    checked = df.withColumn("_name", F.when(is_domain_or_wildcard(F.col(name)), dotted))
    sized = with_suffix_length(checked, "_name", rules, True, "_suffix")
    length = _labels(F.col("_name")) - F.coalesce(F.col("_suffix"), F.lit(1))
    return sized.withColumn("_length", F.when(F.col("_name").isNotNull(), F.greatest(length, F.lit(0)))).drop("_suffix")


def _labels(name: Column) -> Column:
    return F.size(F.split(name, r"\."))


def ancestor(name: Column, steps: Column) -> Column:
    """The name without its first labels."""
    return F.call_function("substring_index", name, F.lit("."), steps - _labels(name))


def with_domain_chain(df: DataFrame, name: str, rules: SuffixRules, out: str = "chain") -> DataFrame:
    """Add the name and all its parents down to the registrable domain, as an array."""
    sized = with_chain_length(df, name, rules)
    steps = F.sequence(F.lit(0), F.col("_length") - 1)
    chain = F.transform(steps, lambda i: ancestor(F.col("_name"), i))
    empty = F.array().cast("array<string>")
    return sized.withColumn(out, F.when(F.col("_length") == 0, empty).otherwise(chain)).drop("_name", "_length")


def parent_domain(chain: Column) -> Column:
    """Immediate parent: the second element of a domain chain, or null."""
    return F.try_element_at(chain, F.lit(2))


def with_location_host(df: DataFrame, url: str, rules: SuffixRules, out: str) -> DataFrame:
    """Add the host of a redirect target, null unless it is a domain below a known suffix."""
    hosted = df.withColumn("_host", F.when(F.col(url).isNotNull(), url_host(F.col(url))))
    sized = with_suffix_length(hosted, "_host", rules, False, "_suffix")
    below = F.size(F.split("_host", r"\.")) > F.col("_suffix")
    return sized.withColumn(out, F.when(below & is_domain(F.col("_host")), F.col("_host"))).drop("_host", "_suffix")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by position, keeping duplicates."""
    return reduce(DataFrame.union, frames)
