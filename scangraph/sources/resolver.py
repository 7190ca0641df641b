"""Resolver output: JSON lines of DNS answers, flattened to address and name pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the part of a resolver line that is used.
ANSWER_SCHEMA = "name string, data struct<answers: array<struct<name: string, type: string, data: string>>>"


def read_resolver_lines(spark: SparkSession, path: str) -> DataFrame:
    """One resolver line per row, as column ``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def _trim(text: Column) -> Column:
    return F.rtrim(text, F.lit(". "))


def flatten_answers(lines: DataFrame) -> DataFrame:
    """``ip, domain, type`` for every address, and for every alias that leads to one.

    An alias is followed inside the answers of its own line, so all steps stay within the row and
    nothing is shuffled. A path does not enter a name twice. A line that is no JSON gives no row.

    The state of the walk is the list of open paths, each with the alias it started from, the name it
    has reached and the names it has seen. There can be no more steps than alias answers.
    """
    parsed = F.from_json("line", ANSWER_SCHEMA)
    clean = F.transform(
        parsed["data"]["answers"],
        lambda a: F.struct(_trim(a["name"]).alias("name"), a["type"].alias("type"), _trim(a["data"]).alias("data")),
    )
    rows = lines.select(clean.alias("answers")).select(
        F.filter("answers", lambda a: a["type"].isin("A", "AAAA") & a["data"].isNotNull()).alias("addresses"),
        F.filter("answers", lambda a: a["type"] == "CNAME").alias("aliases"),
    )

    def pair(address: Column, name: Column) -> Column:
        return F.struct(address["data"].alias("ip"), name.alias("domain"), address["type"].alias("type"))

    def arrivals(path: Column) -> Column:
        here = F.filter("addresses", lambda a: a["name"] == path["at"])
        return F.transform(here, lambda a: pair(a, path["alias"]))

    def onward(path: Column) -> Column:
        seen = F.array_append(path["seen"], path["at"])
        here = F.filter("aliases", lambda c: (c["name"] == path["at"]) & ~F.array_contains(seen, c["data"]))
        return F.transform(
            here, lambda c: F.struct(path["alias"].alias("alias"), c["data"].alias("at"), seen.alias("seen"))
        )

    def step(state: Column, _: Column) -> Column:
        return F.struct(
            F.flatten(F.transform(state["open"], onward)).alias("open"),
            F.concat(state["found"], F.flatten(F.transform(state["open"], arrivals))).alias("found"),
        )

    direct = F.transform("addresses", lambda a: pair(a, a["name"]))
    begun = F.transform(
        F.filter("aliases", lambda c: c["name"] != c["data"]),
        lambda c: F.struct(c["name"].alias("alias"), c["data"].alias("at"), F.array(c["name"]).alias("seen")),
    )
    walked = F.aggregate("aliases", F.struct(begun.alias("open"), direct.alias("found")), step)
    return rows.select(F.inline(walked["found"]))
