"""Resource quantities as the cluster writes them (``87Mi``, ``250m``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: quantity units, smallest CPU request and the headroom of a limit
BYTES_PER_MI = 1_000_000  # decimal megabytes, although the suffix reads Mi
MILLI = 1000
CPU_FLOOR_MILLI = 100
LIMIT_HEADROOM = 1.05


def memory_quantity(n_bytes: Column, headroom: float = 1.0) -> Column:
    """Bytes as whole ``Mi``, truncated after the headroom is added."""
    size = n_bytes / F.lit(BYTES_PER_MI) * F.lit(headroom)
    return F.concat(size.cast("bigint").cast("string"), F.lit("Mi"))


def cpu_quantity(cores: Column, floor: int = CPU_FLOOR_MILLI, headroom: float = 1.0) -> Column:
    """Cores as whole millicores. At or below the floor the floor itself is used, without headroom."""
    milli = (cores * F.lit(MILLI)).cast("bigint")
    raised = (milli * F.lit(headroom)).cast("bigint")
    size = F.when(milli > floor, raised).when(milli.isNotNull(), F.lit(floor).cast("bigint"))
    return F.concat(size.cast("string"), F.lit("m"))
