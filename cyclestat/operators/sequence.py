"""Next row of the same key, without putting a hot key on one task.

``lead(c) OVER (PARTITION BY key ORDER BY o)`` sends every row of a key to one
task.  ``with_next`` gives the same answer with one plan for all data:

1. rows are cut into chunks of the key by a column that rises with the order
   (here: the calendar day of a time stamp), a fixed unit whatever the data, and
   dealt by (key, chunk): one exchange of the rows;
2. one window within (key, chunk) finds every next row but that of a chunk's last;
3. the first and last row of each chunk, two rows however many it holds, meet
   by key, where a last row's next is the first of the key's next chunk.

Steps 2 and 3 read the same exchange, so the input is scanned once and its rows
shuffled once; the ends of the chunks are the second, small shuffle.  A key's rows
spread over as many tasks as it has chunks, nothing is measured or written when
the plan is made, and there is no join.  NULL keys form one key, as in SQL
window partitions; a NULL chunk comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK, _FIRST, _MORE = "_seq_chunk", "_seq_first", "_seq_more"


def with_next(df: DataFrame, key: str, order: Sequence[str], carry: Sequence[str],
              chunk: Column, prefix: str = "next_") -> DataFrame:
    """Add ``prefix + c`` for each ``c`` in ``carry``: the value of ``c`` on the
    next row of the same ``key`` in ``order`` (NULL on a key's last row).

    ``order`` must be a total order within a key (add a unique column last),
    as with a deterministic ``lead``; ``chunk`` must never fall along it.
    Output keeps all input columns; row order and partitioning of the output
    are unspecified.
    """
    cols, names = df.columns, [prefix + c for c in carry]
    by_order = [F.col(o).asc_nulls_first() for o in order]
    of_chunk = Window.partitionBy(key, _CHUNK).orderBy(*by_order)
    within = df.withColumn(_CHUNK, chunk).select(
        *cols, _CHUNK, F.row_number().over(of_chunk).alias(_FIRST), F.lead(F.lit(1)).over(of_chunk).alias(_MORE),
        *[F.lead(c).over(of_chunk).alias(n) for c, n in zip(carry, names)])
    inner = within.where(F.col(_MORE) == 1).select(*cols, *names)
    ends = within.where(F.col(_MORE).isNull() | (F.col(_FIRST) == 1))
    of_key = Window.partitionBy(key).orderBy(F.col(_CHUNK).asc_nulls_first(), *by_order)
    last = ends.select(*cols, _MORE, *[F.lead(c).over(of_key).alias(n) for c, n in zip(carry, names)])
    return inner.union(last.where(F.col(_MORE).isNull()).select(*cols, *names))
