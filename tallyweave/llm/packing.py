"""Problem 8: fill containers of fixed capacity with as little unused space as possible.

Minimum bin slack over lengths: the items enter only as a histogram of their
lengths, which has at most ``capacity`` rows whatever the corpus. The largest
length left opens a container, a bitset subset-sum over the available lengths
finds the fullest way to complete it, and the combination is used as often as
the counts allow. The plan is then applied to the items by their rank among
items of equal length.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import TOKENIZERS, VOCABULARY, count_tokens

CAPACITY = 4096
#: Groups that the items of one length are spread over to be ranked.
SALTS = 64


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> Counter:
    """The lengths, as a multiset, whose sum is largest without passing ``room``.

    ``lengths`` is in descending order. Bits of an integer mark the reachable
    sums; each power-of-two share of a length's copies is one shift.
    """
    mask = (1 << (room + 1)) - 1
    reach, full, steps = 1, 1 << room, []
    for length in lengths:
        if length > room:
            continue
        copies, share = min(counts[length], room // length), 1
        while copies > 0 and not reach & full:
            take = min(share, copies)
            steps.append((reach, length, take))
            reach = (reach | reach << length * take) & mask
            copies -= take
            share *= 2
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first container, copies in each).

    Each combination uses up some length, so the plan is bounded by the
    capacity, not by the number of items.
    """
    counts = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    if lengths and lengths[0] > capacity:
        raise ValueError("an item is longer than the capacity")
    used: Counter = Counter()
    rows, first = [], 0
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        chosen = fullest(lengths, counts, capacity - seed)
        counts[seed] += 1
        chosen[seed] += 1
        times = min(counts[length] // n for length, n in chosen.items())
        for length, n in chosen.items():
            rows.append((length, used[length], used[length] + n * times, first, n))
            used[length] += n * times
            counts[length] -= n * times
        lengths = [k for k in lengths if counts[k]]
        first += times
    return rows


def pack_items(items: DataFrame, length_col: str, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Add ``container`` to every item; lengths must lie in 0..capacity.

    Items of length 0 take no space and lie in container 0. Items of equal
    length are interchangeable, so they are ranked over salted groups: a length
    that holds a third of all items is ranked by ``salts`` tasks.
    """
    marked = cut_lineage(items.withColumn("_row", F.monotonically_increasing_id())).withColumn("_salt", F.pmod(F.col("_row"), F.lit(salts)).cast("int"))
    sized = marked.where(F.col(length_col) > 0)
    groups = sized.groupBy(length_col, "_salt").agg(F.count("*").alias("_n"))
    histogram = groups.groupBy(length_col).agg(F.sum("_n").alias("n"))  # at most `capacity` rows
    rows = plan({r[0]: r[1] for r in histogram.collect()}, capacity)
    spark = items.sparkSession
    plan_df = spark.createDataFrame(pd.DataFrame(rows, columns=["_length", "_from", "_to", "_first", "_copies"]).astype("int64") if rows else [], "_length bigint, _from bigint, _to bigint, _first bigint, _copies bigint")
    starts = groups.select(
        F.col(length_col).alias("_length"), F.col("_salt").alias("_s"),
        (F.sum("_n").over(Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"),
    )
    ranked = sized.withColumn("_i", F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy("_row")) - 1)
    # one row a length with its ranges in order: the item's range is found inside the array, so no item is multiplied
    ranges = plan_df.groupBy("_length").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_first", "_copies"))).alias("_ranges"))
    placed = (
        ranked.join(starts, (F.col(length_col) == F.col("_length")) & (F.col("_salt") == F.col("_s"))).drop("_length", "_s")
        .withColumn("_rank", F.col("_start") + F.col("_i"))
        .join(F.broadcast(ranges), F.col(length_col) == F.col("_length"))  # at most `capacity` rows
        .withColumn("_r", F.element_at(F.filter("_ranges", lambda r: (r["_from"] <= F.col("_rank")) & (F.col("_rank") < r["_to"])), 1))
        .withColumn("container", (F.col("_r._first") + F.floor((F.col("_rank") - F.col("_r._from")) / F.col("_r._copies"))).cast("bigint"))
    )
    empty = marked.where(F.col(length_col) <= 0).withColumn("container", F.lit(0).cast("bigint"))
    columns = [*items.columns, "container"]
    return placed.select(*columns).unionByName(empty.select(*columns))


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, directory: str = TOKENIZERS, name: str = VOCABULARY, salts: int = SALTS) -> DataFrame:
    """Rows (id, piece_no, token_start, n_tokens, container) of all texts.

    A text of more tokens than the capacity is cut into full pieces and a rest,
    any other text is one piece. Null and empty texts are a piece of 0 tokens in
    container 0. Every input row, repeated ones too, is placed once; an empty
    table gives an empty table.
    """
    counted = count_tokens(df, id_col, text_col, directory, name)
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int") - 1, F.lit(0))
    pieces = counted.select(F.col(id_col), F.col("n_tokens").alias("_all"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    pieces = pieces.select(
        id_col, "piece_no", (F.col("piece_no") * F.lit(capacity).cast("bigint")).alias("token_start"),
        F.least(F.lit(capacity).cast("bigint"), F.col("_all") - F.col("piece_no") * F.lit(capacity).cast("bigint")).alias("n_tokens"),
    )
    return pack_items(pieces, "n_tokens", capacity, salts)
