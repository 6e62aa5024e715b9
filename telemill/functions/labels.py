"""Label matchers and the projections out of label maps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A pattern made only of these characters stands for itself.
PLAIN = re.compile(r"[A-Za-z0-9_\-/: ]*")


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def matches(col: str | Column, pattern: str) -> Column:
    """``label =~ pattern``, anchored at both ends.

    Alternatives of plain texts and ``text.*`` become ``=``, ``IN`` and ``startswith``, which the
    parquet scan can use; any other expression can only be checked after the scan. A missing label
    counts as the empty text, so it matches whenever the pattern accepts that.
    """
    col = _col(col)
    parts = pattern.split("|")
    # inside a group, a class or behind an escape the bar and the dot mean something else
    if ".*" in parts and not re.search(r"[()\[\]\\]", pattern):
        return F.lit(True)
    prefixes = [p[:-2] for p in parts if p.endswith(".*") and PLAIN.fullmatch(p[:-2])]
    texts = [p for p in parts if p and PLAIN.fullmatch(p)]
    if len(prefixes) + len(texts) < len(parts):
        return F.coalesce(col, F.lit("")).rlike(rf"\A(?s:{pattern})\z")
    found = [col.startswith(p) for p in prefixes]
    if texts:
        found.append(col.isin(texts) if len(texts) > 1 else col == F.lit(texts[0]))
    out = found[0]
    for condition in found[1:]:
        out = out | condition
    return out


def equals(col: str | Column, value: str) -> Column:
    """``label = value``; the empty value also matches a missing label."""
    return _col(col) == F.lit(value) if value else F.coalesce(_col(col), F.lit("")) == F.lit("")


def all_match(**patterns: str) -> Column:
    """Conjunction of anchored matchers, one per label column."""
    out = F.lit(True)
    for label, pattern in patterns.items():
        out = out & matches(label, pattern)
    return out


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    """Series without the label are skipped, not an error."""
    return df.where(F.col(label).isNotNull())


def to_number(col: str | Column) -> Column:
    """Sample values arrive as text; text that is no number becomes NULL."""
    return _col(col).try_cast("double")


def instance_type(labels: str | Column) -> Column:
    """Instance type of a node. The label was renamed once, so both names are looked up."""
    labels = _col(labels)
    # fixed values: label names
    current, former = "label_node_kubernetes_io_instance_type", "label_beta_kubernetes_io_instance_type"
    return F.coalesce(labels[current], labels[former])


def nodegroup(labels: str | Column) -> Column:
    return _col(labels)["label_eks_amazonaws_com_nodegroup"]
