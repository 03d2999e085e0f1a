"""Quality rules with risk-controlled cutoffs.

Measures of a text are taken on its bytes (``measure``).  A rule rejects a document whose
ratio is above the rule's cutoff.  Cutoffs are chosen per stratum, from grids fixed in
advance, on labelled good documents.  A hash deals a quarter of
them to a first part and the rest to a second.  The first part proposes a short path of settings of all rules, from lenient to strict (``proposals``).
The second part, independent of it, tests the settings in that order: an exact binomial test
must show that a setting rejects good documents of the stratum, all rules together, at a rate
of less than ``risk``; the last setting before the first failure holds.  As the order is fixed
before the test, a path needs no division by its length, and rules need none as they are tested
together; the level is ``level`` divided by the number of strata.  So with probability
``1 - level`` at least no stratum loses more than ``risk`` of its good documents.  With too few
labels (under 144 in the second part, for 4 strata at the given risk and level) no setting
passes, and nothing is rejected by rules in that stratum.

Null or empty texts have no words: all measures 0.  Rows that repeat an id are measured
each.  A null stratum is a stratum; one without labels has no cutoffs.  A ratio equal to a cutoff
is not above it, so the document stays.  Texts are measured whole, whatever their length: one text's
words are what a task holds beside its batch.  An empty table has no cutoffs and no rows.  Columns that are
kept may not bear the names of the measures; others are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclestat.llm.common import in_task, stored
from cyclestat.llm.textbytes import Words, batches, mix, span_hashes, window_hashes

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_same_words")

#: Rule: ratio of two measures, and its grid of cutoffs, strict to lenient.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words", "n_words", (0.01, 0.02, 0.05, 0.1, 0.15)),
    "bangs": ("n_bangs", "word_chars", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)),
    "same_words": ("n_same_words", "n_words", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "long_words": ("word_chars", "n_words", (8.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
}


def _in_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(key + row.astype(np.uint64) * _SPREAD)


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of a column."""
    words = Words(column, lower=False)
    data, rows = words.data, words.rows
    first = np.concatenate([words.starts, [len(data)]])
    char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = {"n_words": words.counts, "word_chars": words.per_row(char[words.ends] - char[words.starts])}

    at = _offsets(column)
    for name, marks in (("n_symbols", _SYMBOLS[data]), ("n_bangs", data == ord("!"))):
        total = np.concatenate([[0], np.cumsum(marks)])
        out[name] = total[at[1:]] - total[at[:-1]]
    same = np.zeros(len(words.hash), bool)  # the word before is equal
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    out["n_same_words"] = words.per_row(same)

    # Lines: they begin where a text does and after each \n.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    end = np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin
    end = np.where((end > begin) & (data[np.maximum(end, 1) - 1] == 10), end - 1, end) if len(begin) else end
    worded = np.searchsorted(first, begin) < np.searchsorted(first, end)
    begin, end = begin[worded], end[worded]
    row = np.searchsorted(at, begin, "right") - 1
    _, one = np.unique(_in_row(row, span_hashes(data, begin, end)), return_index=True)
    out["n_lines"] = np.bincount(row, minlength=rows)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[one], minlength=rows)

    keys, start = window_hashes(words, WINDOW)
    _, same, times = np.unique(_in_row(words.row[start], keys), return_inverse=True, return_counts=True)
    again = start[times[same] > 1]
    cover = np.zeros(len(words.hash) + 1, np.int64)
    cover[again] += 1
    cover[again + WINDOW] -= 1
    out["n_repeat_words"] = words.per_row(np.cumsum(cover)[:-1] > 0)
    return out


def _offsets(column: pa.Array) -> np.ndarray:
    from cyclestat.llm.textbytes import flat

    return flat(column)[1]


def measure_texts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, "_text"):
        found = measures(batch.column("_text"))
        kept = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(found[m], pa.int64()) for m in MEASURES)], [*kept, *MEASURES])


def measure(docs: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the columns ``keep`` and ``MEASURES``."""
    if clash := set(MEASURES) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(in_task("quality", "measure_texts"), kinds + "".join(f", {m} long" for m in MEASURES))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of at most ``k`` events in ``n`` trials, exactly summed."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1)))]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


#: The path of settings: places more lenient than the strictest cutoff without a rejection, and
#: the share of the risk that the rules may spend on the first part.
PATH = ((3, 0.0), (2, 0.0), (1, 0.0), (0, 0.0), (0, 0.25), (0, 0.5), (0, 0.75))


def proposals(tallies: Iterator[pd.DataFrame], rules: Mapping, risk: float) -> Iterator[pd.DataFrame]:
    """Rows ``stratum, good, over_<rule>_<i>`` to ``stratum, set_<step>_<rule>``, a cutoff per step of ``PATH``."""
    for table in tallies:
        out = {"stratum": table["stratum"]}
        for step, (margin, share) in enumerate(PATH):
            for name, (_, _, grid) in rules.items():
                over = table[[f"over_{name}_{i}" for i in range(len(grid))]].to_numpy(float)
                may = np.floor(share * risk / len(rules) * table["good"].to_numpy(float))
                at = (over > may[:, None]).sum(axis=1)  # counts fall along the grid
                cuts = np.array(grid)[np.minimum(at + margin, len(grid) - 1)]
                out[f"set_{step}_{name}"] = np.where(at < len(grid), cuts, np.inf)
        yield pd.DataFrame(out)


def choose(tallies: Iterator[pd.DataFrame], rules: Mapping, risk: float, level: float, tests: int) -> Iterator[pd.DataFrame]:
    """Rows ``stratum, good, over_<rule>_<i>`` to ``stratum, cut_<rule>``.

    Per rule the last value, from the lenient end, before the first that is not shown to be safe; else infinity.
    """
    for table in tallies:
        out = table[["stratum"]].copy()
        for name, (_, _, grid) in rules.items():
            cuts, safe = np.full(len(table), np.inf), np.full(len(table), True)
            for i in reversed(range(len(grid))):
                tail = [binomial_tail(int(k), int(n), risk / len(rules)) if n else 1.0 for k, n in zip(table[f"over_{name}_{i}"], table["good"])]
                safe &= np.array(tail) <= level / tests
                cuts = np.where(safe, grid[i], cuts)
            out[f"cut_{name}"] = cuts
        yield out


def ratio(rule: tuple[str, str, tuple[float, ...]]) -> Column:
    top, bottom, _ = rule
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def cutoffs(measured: DataFrame, good: Column, stratum: str = "stratum", rules: Mapping = RULES, risk: float = 0.03, level: float = 0.05) -> DataFrame:
    """One row per stratum ``stratum, cut_<rule>...`` from labelled rows; ``good`` marks the holdout."""
    labelled = measured.where(good).withColumn("_deal", F.pmod(F.xxhash64(*[c for c in measured.columns if c not in MEASURES]), F.lit(4)))
    first, second = labelled.where("_deal = 0"), labelled.where("_deal > 0")
    over = [F.sum((ratio(r) > cut).cast("long")).alias(f"over_{name}_{i}") for name, r in rules.items() for i, cut in enumerate(r[2])]
    tallies = first.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("good"), *over)
    kind = tallies.schema["stratum"].dataType.simpleString()
    sets = "".join(f", set_{k}_{name} double" for k in range(len(PATH)) for name in rules)
    proposed = tallies.mapInPandas(in_task("quality", "proposals", dict(rules), risk), f"stratum {kind}{sets}").withColumnRenamed("stratum", "_stratum")

    # The path as one rule: its grid is the steps, strict to lenient.
    steps = tuple(float(k) for k in reversed(range(len(PATH))))
    path = {"all": ("", "", steps)}
    hit = [F.sum(reduce(or_, (ratio(r) > F.col(f"set_{int(k)}_{name}") for name, r in rules.items())).cast("long")).alias(f"over_all_{i}") for i, k in enumerate(steps)]
    tried = second.join(proposed, second[stratum].eqNullSafe(proposed["_stratum"]))
    tried = tried.groupBy(F.col("_stratum").alias("stratum")).agg(F.count(F.lit(1)).alias("good"), *hit)
    tests = max(1, labelled.select(stratum).distinct().count())
    held = tried.mapInPandas(in_task("quality", "choose", path, risk, level, tests), f"stratum {kind}, cut_all double")
    strata = labelled.select(F.col(stratum).alias("stratum")).distinct()
    both = strata.join(held.withColumnRenamed("stratum", "_held"), F.col("stratum").eqNullSafe(F.col("_held")), "left")
    both = both.join(proposed, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    never = F.lit(math.inf)
    cuts = [reduce(lambda rest, k: F.when(F.col("cut_all") == k, F.col(f"set_{int(k)}_{name}")).otherwise(rest), steps, never).alias(f"cut_{name}") for name in rules]
    return stored(both.select("stratum", *cuts), "quality-cuts")  # its size is known, so joins can broadcast it


def judged(measured: DataFrame, cuts: DataFrame, stratum: str = "stratum", rules: Mapping = RULES) -> DataFrame:
    """``measured`` with ``rejected_by``: the rules whose cutoff a row exceeds."""
    held = cuts.withColumnRenamed("stratum", "_stratum")
    both = measured.join(held, measured[stratum].eqNullSafe(held["_stratum"]), "left")
    hit = [F.when(ratio(r) > F.col(f"cut_{name}"), F.lit(name)) for name, r in rules.items()]
    return both.select(*[measured[c] for c in measured.columns], F.array_compact(F.array(*hit)).alias("rejected_by"))
