"""Location of a configuration file, taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_config_url(url: str | Column, dir_name: str | Column) -> Column:
    """``scheme://host/<repo>/blob/<branch>/<dir>/<file>`` as struct(repo, branch, dir, file).

    The branch may hold slashes, so it ends at the first ``dir_name`` after ``blob``. NULL when
    either of the two is absent.
    """
    url = F.col(url) if isinstance(url, str) else url
    dir_name = F.col(dir_name) if isinstance(dir_name, str) else dir_name
    parts = F.split(url, "/")
    n = F.size(parts)
    blob = F.array_position(parts, F.lit("blob")).cast("int")
    tail = F.slice(parts, F.greatest(blob, F.lit(1)), n)
    top = F.array_position(tail, dir_name).cast("int") + blob - 1

    def joined(first: Column, after: Column) -> Column:
        return F.array_join(F.slice(parts, first, F.greatest(after - first, F.lit(0))), "/")

    located = F.struct(
        joined(F.lit(4), blob).alias("repo"),
        joined(blob + 1, top).alias("branch"),
        joined(top, n).alias("dir"),
        F.element_at(parts, -1).alias("file"),
    )
    return F.when((blob > 0) & (F.array_position(tail, dir_name) > 0), located)
