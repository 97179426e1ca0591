"""Problem 3: filling windows of fixed capacity with records of varying length.

Best-fit decreasing, exactly as if records were placed one after another from the longest to the shortest into the
tightest open window, but planned on the histogram of lengths: lengths are integers up to the capacity, so the
plan of any number of records has at most capacity entries as input. A segment tree over remaining capacities finds
the tightest open windows in logarithmic time; records of one length that go to windows of one remaining capacity are
placed together. Records then look up their window by their rank within their length, which is counted block-wise:
no task holds all records of a length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordinal import scan
from ..session import checkpoint, small


#: Records of one length that are ranked in one task.
BLOCK_ROWS = 100_000


class Remaining:
    """A segment tree over remaining capacities 0..size with the number of open windows of each."""

    def __init__(self, size: int):
        self.half = 1 << size.bit_length()
        self.tree = [0] * (2 * self.half)

    def add(self, at: int, n: int) -> None:
        at += self.half
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least `least` with an open window, or -1."""
        at = least + self.half
        if self.tree[at]:
            return least
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.half:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.half
            at >>= 1
        return -1


def plan(lengths: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of (length, number) pairs.

    Gives runs (length, first rank, last rank, records per window, first window, place in the window): the record of
    rank r of a length goes to window `first + (r - first rank) // per`, at `place + (r - first rank) % per * length`.
    """
    tree = Remaining(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    out, windows = [], 0

    def give(left: int, first: int, n: int) -> None:
        if n and left:
            open_.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length, number in sorted(lengths, reverse=True):
        rank = 0
        while rank < number:
            left = tree.tightest(length)
            if left < 0:
                left = capacity
                first, n = windows, -(-(number - rank) // (capacity // length))
                windows += n
            else:
                first, n = open_[left].pop()
                tree.add(left, -n)
            per = left // length
            used = min(n, -(-(number - rank) // per))
            placed = min(number - rank, used * per)
            out.append((length, rank + 1, rank + placed, per, first, capacity - left))
            full, rest = divmod(placed, per)
            give(left - per * length, first, full)
            if rest:
                give(left - rest * length, first + full, 1)
            give(left, first + used, n - used)
            rank += placed
    return out


_RUNS = "experiment string, run_length int, rank_from bigint, rank_to bigint, per bigint, window_from bigint, place_from int"


def _plans(pdf: pd.DataFrame) -> pd.DataFrame:
    runs = plan(list(zip(pdf["length"].astype(int), pdf["n"].astype(int))), int(pdf["capacity"].iloc[0]))
    out = pd.DataFrame(runs, columns=["run_length", "rank_from", "rank_to", "per", "window_from", "place_from"])
    out.insert(0, "experiment", pdf["experiment"].iloc[0])
    return out


def train_lengths(records: DataFrame, split: str = "train") -> DataFrame:
    """`record_id`, `n_tokens` of the records of a split, each once: its latest delivery with a known length."""
    newest = F.max(F.struct(F.col("n_tokens").isNotNull().alias("known"), F.col("prepared_at").alias("at"), F.col("n_tokens").alias("n_tokens")))
    return records.where(F.col("split") == split).where("record_id is not null").groupBy("record_id").agg(newest.alias("r")).select("record_id", "r.n_tokens")


def capacities(experiments: DataFrame, most: int = 1000) -> list[tuple[str, int, int]]:
    """(experiment, capacity, max_length) of the experiments with a positive capacity: max_length, at most max_seq_length."""
    rows = experiments.select("experiment", "max_length", F.least("max_length", "max_seq_length").alias("c")).where("experiment is not null and max_length > 0 and c > 0").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} experiments")
    return [(r[0], r[2], r[1]) for r in sorted(rows)]


def _order(bits: int) -> tuple[Column, list]:
    """A block expression and an order of records: by a hash of the id, so that blocks are even whatever the ids are."""
    key = F.xxhash64("record_id")
    return F.shiftright(key, 64 - bits) if bits else F.lit(0), [key, "record_id"]


def pack(records: DataFrame, experiments: DataFrame, split: str = "train") -> DataFrame:
    """The place of each train record for each experiment.

    Rows: `experiment`, `record_id`, `piece`, `n_pieces`, `length`, `window`, `place`. A record longer than a window is
    divided: pieces of a whole window each and the rest; no other record is. A record of length 0 takes no space and,
    like one of unknown or negative length, has one row without a window. Of equal lengths whole records come before
    pieces, and either in the order of a hash of the id. Records delivered again count once. Empty tables give no rows.

    The plan of all experiments follows from the histogram of lengths, and whole records are ranked within their length
    once for all of them; only pieces of divided records are made and ranked per experiment.
    """
    spark = records.sparkSession
    settings = capacities(experiments)
    if not settings:
        return spark.createDataFrame([], "experiment string, record_id bigint, piece int, n_pieces int, length int, window bigint, place int")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("experiment"), F.lit(c).cast("bigint").alias("capacity")) for n, c, _ in settings])).alias("e")
    least, most = min(c for _, c, _ in settings), max(c for _, c, _ in settings)
    rows = checkpoint(train_lengths(records, split).withColumn("n_tokens", F.col("n_tokens").cast("bigint")))
    counted = checkpoint(rows.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")))
    wide = counted.select("n_tokens", "n", each).select("n_tokens", "n", "e.*")
    full = wide.where("n_tokens > capacity")
    lengths = (
        wide.where("n_tokens <= capacity")
        .select("experiment", "capacity", F.col("n_tokens").alias("length"), "n")
        .unionByName(full.select("experiment", "capacity", F.col("capacity").alias("length"), (F.col("n") * F.floor(F.col("n_tokens") / F.col("capacity"))).alias("n")))
        .unionByName(full.select("experiment", "capacity", (F.col("n_tokens") % F.col("capacity")).alias("length"), "n").where("length > 0"))
    )
    histogram = checkpoint(lengths.groupBy("experiment", "capacity", "length").agg(F.sum("n").alias("n")))
    runs = checkpoint(histogram.groupBy("experiment").applyInPandas(_plans, _RUNS))
    # Blocks of some `BLOCK_ROWS` rows of the commonest length, so that most lengths are one block each.
    block, order = _order(max(0, ((histogram.agg(F.max("n")).first()[0] or 0) // BLOCK_ROWS).bit_length()))
    whole = scan(rows.where(F.col("n_tokens").between(1, most)), ["n_tokens"], block, order)
    whole = whole.select("record_id", "n_tokens", "rank", each).select("e.*", "record_id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.col("n_tokens").alias("length"), "rank").where("length <= capacity")
    cut = rows.where(F.col("n_tokens") > least).select("record_id", "n_tokens", each).select("record_id", "n_tokens", "e.*").where("n_tokens > capacity")
    cut = cut.withColumn("n_pieces", F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int"))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    cut = cut.withColumn("length", F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")))
    before = small(counted.select(F.col("n_tokens").alias("_n"), F.col("n").alias("_before")))
    cut = scan(cut, ["experiment", "length"], block, [*order, "piece"]).join(before, F.col("length") == F.col("_n"), "left")
    cut = cut.select("experiment", "capacity", "record_id", "piece", "n_pieces", "length", (F.col("rank") + F.coalesce("_before", F.lit(0))).alias("rank"))
    g = small(runs.withColumnRenamed("experiment", "_e"))
    step = F.col("rank") - F.col("rank_from")
    fits = (F.col("experiment") == F.col("_e")) & (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("rank_from"), F.col("rank_to"))
    found = whole.unionByName(cut).join(g, fits).select(
        "experiment", "record_id", "piece", "n_pieces", F.col("length").cast("int").alias("length"),
        (F.col("window_from") + F.floor(step / F.col("per"))).cast("bigint").alias("window"),
        (F.col("place_from") + F.pmod(step, F.col("per")) * F.col("length")).cast("int").alias("place"),
    )
    length = F.when(F.col("n_tokens") == 0, F.lit(0)).alias("length")
    rest = rows.where("n_tokens is null or n_tokens <= 0").select("record_id", length, each)
    rest = rest.select("e.experiment", "record_id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), "length", F.lit(None).cast("bigint").alias("window"), F.lit(None).cast("int").alias("place"))
    return found.unionByName(rest)


def unused(packed: DataFrame, experiments: DataFrame) -> DataFrame:
    """Per experiment: `capacity`, `n_windows`, `n_records`, `n_tokens`, `unused` (tokens of space) and `fill` (share used)."""
    settings = packed.sparkSession.createDataFrame([(n, c) for n, c, _ in capacities(experiments)], "_e string, capacity int")
    windows = packed.where("window is not null").groupBy("experiment", "window").agg(F.sum("length").alias("used"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("n"))
    totals = windows.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_records"), F.sum("used").alias("n_tokens"))
    space = F.col("n_windows") * F.col("capacity")
    return totals.join(F.broadcast(settings), F.col("experiment") == F.col("_e")).select(
        "experiment", "capacity", "n_windows", "n_records", "n_tokens", (space - F.col("n_tokens")).alias("unused"), (F.col("n_tokens") / space).alias("fill")
    )


def divided(packed: DataFrame, experiments: DataFrame) -> DataFrame:
    """`experiment`, `record_id` of the records that stand in more than one window and are longer than max_length."""
    settings = packed.sparkSession.createDataFrame([(n, m) for n, _, m in capacities(experiments)], "_e string, max_length int")
    records = packed.where("window is not null and n_pieces > 1").groupBy("experiment", "record_id").agg(F.min("window").alias("a"), F.max("window").alias("b"), F.sum("length").alias("n"))
    return records.join(F.broadcast(settings), (F.col("experiment") == F.col("_e")) & (F.col("n") > F.col("max_length"))).where("a != b").select("experiment", "record_id")


def placed(packed: DataFrame, experiments: DataFrame) -> DataFrame:
    """Per experiment, whether its windows hold what they should: `n_records`, `n_tokens`, `n_over` (windows above the capacity), `n_gaps` (places that aren't the end of the piece before)."""
    settings = packed.sparkSession.createDataFrame([(n, c) for n, c, _ in capacities(experiments)], "_e string, capacity int")
    rows = packed.where("window is not null")
    before = F.lag(F.col("place") + F.col("length"), 1, 0).over(Window.partitionBy("experiment", "window").orderBy("place"))
    each = rows.withColumn("gap", (F.col("place") != before).cast("int")).groupBy("experiment", "window")
    each = each.agg(F.sum("length").alias("n"), F.sum("gap").alias("gaps"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("records"))
    return each.join(F.broadcast(settings), F.col("experiment") == F.col("_e")).groupBy("experiment").agg(
        F.sum("records").alias("n_records"), F.sum("n").alias("n_tokens"), F.sum((F.col("n") > F.col("capacity")).cast("int")).cast("bigint").alias("n_over"), F.sum("gaps").alias("n_gaps")
    )
