"""Registrable domains by a public suffix list of any size, held as a table of rules.

A rule has the list's notation: ``a.b`` for a suffix, ``*.b`` for any one label in front of b, ``!a.b`` for an exception to such a rule. The
distinct hosts' tails meet the rules by equality, so thousands of rules cost no more than a few. An exception counts before any
other rule, a rule of more labels before one of fewer, and where none matches the last label is the suffix.

The joins carry no hint: a list of usual size is broadcast by Spark's own threshold, a larger one is merged. Hosts are reduced to distinct ones
first, and rules to distinct keys, so a tail as common as ``com`` has one row on the side of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS = r"^(\[.*\]|[\d.]+)$"


def suffix_rules(lines: DataFrame, column: str = "rule") -> DataFrame:
    """``kind`` (exact, wild, spared) and ``key`` of the list's lines; blank lines and comments are no rules, a rule ends at white space."""
    line = F.lower(F.regexp_extract(F.col(column), r"^\s*(\S*)", 1))
    rules = lines.select(line.alias("line")).filter("line <> '' AND NOT startswith(line, '//')")
    rest = F.regexp_replace("line", r"^(!|\*\.)", "")
    foreign = rest.rlike(r"[^\x00-\x7f]")
    key = F.when(foreign, F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), rest))).otherwise(rest)
    kind = F.when(F.col("line").startswith("!"), F.lit("spared")).when(F.col("line").startswith("*."), F.lit("wild")).otherwise(F.lit("exact"))
    # a lone star is the rule that holds anyway
    return rules.select(kind.alias("kind"), key.alias("key")).filter("key <> '' AND key <> '*'").distinct()


def _tail(labels: Column, n: Column) -> Column:
    """The last ``n`` labels; all, if there are fewer."""
    n = F.least(n, F.size(labels))
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def registrable_domains(hosts: DataFrame, rules: DataFrame, host_column: str = "host") -> DataFrame:
    """``host`` and ``domain`` of the distinct hosts: the public suffix and one label more. A host that is a suffix itself and an IP address stay
    whole; null hosts give no row."""
    distinct = hosts.select(F.col(host_column).alias("host")).filter(F.col("host").isNotNull()).distinct()
    labels = F.split("host", r"\.")
    tails = distinct.filter(~F.col("host").rlike(ADDRESS)).select("host", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("n"))
    tails = tails.select("host", "n", _tail(labels, F.col("n")).alias("tail"))
    # labels of the suffix that each kind of rule makes of a tail of n labels
    kinds = [("exact", F.col("n")), ("wild", F.col("n") + 1), ("spared", F.col("n") - 1)]
    asked = tails.select("host", "tail", F.inline(F.array(*[F.struct(F.lit(k).alias("kind_"), size.alias("size")) for k, size in kinds])))
    # a star stands for a label that must be there
    asked = asked.filter(F.col("size") <= F.size(labels))
    met = asked.join(rules, (F.col("tail") == F.col("key")) & (F.col("kind_") == F.col("kind")))
    longest = met.groupBy("host").agg(F.max(F.struct((F.col("kind") == "spared").alias("spared"), F.col("size"))).alias("best"))
    longest = longest.select(F.col("host").alias("known"), F.col("best.size").alias("size"))
    found = distinct.join(longest, F.col("host") == F.col("known"), "left")
    domain = F.when(F.col("host").rlike(ADDRESS), F.col("host")).otherwise(_tail(labels, F.coalesce("size", F.lit(1)) + 1))
    return found.select("host", domain.alias("domain"))


def with_domain_base(df: DataFrame, rules: DataFrame, host_column: str, out_column: str) -> DataFrame:
    """The rows with the registrable domain of their host, null for a null host."""
    domains = registrable_domains(df, rules, host_column).select(F.col("host").alias("host_of_domain"), F.col("domain").alias(out_column))
    return df.join(domains, F.col(host_column) == F.col("host_of_domain"), "left").drop("host_of_domain")
