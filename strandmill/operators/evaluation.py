"""Evaluation arithmetic: multiple-choice items, scores, accuracy, losses, early stopping, throughput, averaging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import paths

# The prompt of question tasks, and the letters that numbered answer keys stand for.
QUESTION_PROMPT = "Question: {}\nAnswer:"
ANSWER_LETTERS = ["A", "B", "C", "D", "E"]


def _prompt(question):
    before, after = QUESTION_PROMPT.split("{}")
    return F.concat(F.lit(before), question, F.lit(after))


def first_examples(examples: DataFrame, most: int | None, order: str) -> DataFrame:
    """The first `most` valid examples in read order; None: all."""
    return examples if most is None else examples.orderBy(order).limit(most)


def hellaswag_items(rows: DataFrame, order: str, most: int | None = None) -> DataFrame:
    """`example_id`, `prompt`, `choices`, `answer_index` of rows (ctx_a, ctx_b, endings, label, ind) that are valid."""
    prompt = tx.strip(F.concat_ws(" ", F.coalesce("ctx_a", F.lit("")), F.coalesce("ctx_b", F.lit(""))))
    label = F.coalesce(F.col("label").cast("string"), F.lit("0")).try_cast("int")
    items = rows.select(F.col(order), F.col("ind").cast("string").alias("example_id"), prompt.alias("prompt"), F.col("endings").alias("choices"), label.alias("answer_index"))
    good = (F.size("choices") >= 2) & (F.col("prompt") != "") & (F.col("answer_index") >= 0) & (F.col("answer_index") < F.size("choices"))
    return first_examples(items.where(good), most, order)


def piqa_items(rows: DataFrame, order: str, split: str = "validation", most: int | None = None) -> DataFrame:
    """Items of rows (goal, sol1, sol2, label, id); only the validation split has labels."""
    if split != "validation":
        raise ValueError(f"only the validation split can be used, not {split!r}")
    goal, one, two = (tx.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("goal", "sol1", "sol2"))
    label = F.coalesce(F.col("label").cast("string"), F.lit("0")).try_cast("int")
    items = rows.select(F.col(order), F.col("id").cast("string").alias("example_id"), goal.alias("goal"), F.array(one, two).alias("choices"), label.alias("answer_index"))
    good = (F.col("goal") != "") & (F.col("choices")[0] != "") & (F.col("choices")[1] != "") & F.col("answer_index").isin(0, 1)
    return first_examples(items.where(good).withColumn("prompt", _prompt(F.col("goal"))).drop("goal"), most, order)


def answer_index(labels, key):
    """Where the key stands among the labels, else the letter that a numbered key stands for; null if neither does."""
    key = tx.strip(F.coalesce(key.cast("string"), F.lit("")))
    letter = F.element_at(F.create_map(*[F.lit(x) for i, a in enumerate(ANSWER_LETTERS) for x in (str(i + 1), a)]), key)
    direct, mapped = F.array_position(labels, key), F.array_position(labels, letter)
    return F.when(direct > 0, direct - 1).when(mapped > 0, mapped - 1).cast("int")


def arc_items(rows: DataFrame, order: str, most: int | None = None) -> DataFrame:
    """Items of rows (question, choices{text, label}, answerKey, id)."""
    question = tx.strip(F.coalesce(F.col("question").cast("string"), F.lit("")))
    items = rows.select(
        F.col(order), F.col("id").cast("string").alias("example_id"), question.alias("question"), F.col("choices.text").alias("choices"),
        answer_index(F.col("choices.label"), F.col("answerKey")).alias("answer_index"),
    )
    good = (F.col("question") != "") & (F.size("choices") >= 2) & F.col("answer_index").isNotNull()
    return first_examples(items.where(good).withColumn("prompt", _prompt(F.col("question"))).drop("question"), most, order)


def choice_scores(tokens: DataFrame, logprobs: DataFrame, keys: list[str], normalize: bool = False) -> DataFrame:
    """`score` of each choice: the sum of its tokens' log-probabilities, or their mean.

    `tokens` has a row per token (`keys`, `token`), `logprobs` a row per token id (`token`, `logprob`). An unknown token
    makes the score minus infinity.
    """
    joined = tokens.join(logprobs, "token", "left")
    value = F.sum(F.coalesce("logprob", F.lit(float("-inf"))))
    return joined.groupBy(*keys).agg((value / F.greatest(F.count(F.lit(1)), F.lit(1)) if normalize else value).alias("score"))


def predictions(scores: DataFrame, item: str = "item_id", choice: str = "choice") -> DataFrame:
    """The best choice of each item; of equal ones the first."""
    return scores.groupBy(item).agg(F.max_by(choice, F.struct("score", -F.col(choice))).alias("predicted"))


def accuracy(results: DataFrame, keys: tuple[str, ...] = ("task",)) -> DataFrame:
    """Items, right ones and their share per key and, with null keys, over all: the total counts items, not tasks."""
    right = F.sum(F.col("correct").cast("int"))
    out = results.rollup(*keys).agg(F.count(F.lit(1)).alias("num_examples"), right.alias("num_correct"))
    return out.withColumn("accuracy", F.when(F.col("num_examples") > 0, F.col("num_correct") / F.col("num_examples")).otherwise(float("nan")))


# ---------------------------------------------------------------- training logs


def weighted_loss(batches: DataFrame, keys: list[str], loss: str = "loss", weight: str = "tokens", order: str | None = None, most: int | None = None) -> DataFrame:
    """Token-weighted mean loss and its perplexity per run; infinity if there are no tokens. `most`: the first batches only."""
    if most is not None:
        by = Window.partitionBy(*keys).orderBy(order)
        batches = batches.withColumn("_i", F.row_number().over(by)).where(F.col("_i") <= most)
    total = F.sum(weight)
    mean = F.when(total > 0, F.sum(F.col(loss) * F.col(weight)) / total).otherwise(float("inf"))
    return batches.groupBy(*keys).agg(mean.alias("mean_loss")).withColumn("perplexity", F.exp("mean_loss"))


def early_stopping(evals: DataFrame, run: str, step: str, value: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """Per run: `best` value, `stop_step` (null if it never stops) and the number of improvements.

    A value improves if it is below the best before it by more than `min_delta`; a run stops after `patience` values
    without improvement. The fold goes over the sorted evaluations of one run.
    """
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("wait"), F.lit(None).cast("bigint").alias("stop"), F.lit(0).alias("n"))

    def fold(a, x):
        better = x["v"] < a["best"] - min_delta
        wait = F.when(better, 0).otherwise(a["wait"] + 1)
        new = F.struct(
            F.when(better, x["v"]).otherwise(a["best"]).alias("best"), wait.alias("wait"),
            F.when(wait >= patience, x["s"]).alias("stop"), (a["n"] + F.when(better, 1).otherwise(0)).alias("n"),
        )
        return F.when(a["stop"].isNotNull(), a).otherwise(new)

    series = F.array_sort(F.collect_list(F.struct(F.col(step).cast("bigint").alias("s"), F.col(value).cast("double").alias("v"))))
    folded = evals.where(F.col(value).isNotNull()).groupBy(run).agg(F.aggregate(series, zero, fold).alias("f"))
    return folded.select(run, F.col("f.best").alias("best"), F.col("f.stop").alias("stop_step"), F.col("f.n").cast("bigint").alias("improvements"))


def bad_step_runs(steps: DataFrame, run: str, step: str, bad, limit: int = 3) -> DataFrame:
    """Stretches of consecutive bad steps: `first_step`, `last_step`, `length`, and whether they abort the run."""
    order = Window.partitionBy(run).orderBy(step)
    within = Window.partitionBy(run, F.col("_bad")).orderBy(step)
    marked = steps.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    islands = marked.withColumn("_island", F.row_number().over(order) - F.row_number().over(within)).where("_bad")
    out = islands.groupBy(run, "_island").agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count(F.lit(1)).alias("length"))
    return out.drop("_island").withColumn("aborts", F.col("length") >= limit)


def throughput(steps: DataFrame, run: str, ts: str, amount: str, total_steps: int) -> DataFrame:
    """Per run: steps, seconds, `per_second` and the seconds left (`eta_s`) at the mean pace."""
    seconds = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    out = steps.groupBy(run).agg(F.count(F.lit(1)).alias("n_steps"), seconds.alias("seconds"), F.sum(amount).alias("amount"))
    left = F.greatest(F.lit(0), F.lit(total_steps) - F.col("n_steps"))
    return out.select(
        run, "n_steps", "seconds",
        F.when(F.col("seconds") > 0, F.col("amount") / F.col("seconds")).alias("per_second"),
        (F.col("seconds") / F.col("n_steps") * left).alias("eta_s"),
    )


def mean_over_ranks(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    return values.groupBy(*keys).agg(F.avg(value).alias("mean_value"))


# ---------------------------------------------------------------- checkpoints


def checkpoint_weights(losses: DataFrame, loss: str = "loss", temperature: float = 1.0) -> DataFrame:
    """Adds `weight`: the softmax of -loss / temperature over all checkpoints (a handful of rows)."""
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    every = Window.partitionBy(F.lit(0))
    score = -F.col(loss) / temperature
    top = F.max(score).over(every)
    return losses.withColumn("_e", F.exp(score - top)).withColumn("weight", F.col("_e") / F.sum("_e").over(every)).drop("_e")


def average_checkpoints(parameters: DataFrame, weights: DataFrame, key: str = "checkpoint") -> DataFrame:
    """Weighted mean of parameter arrays: `param`, `pos`, `value`; `parameters` has `key`, `param`, `values`.

    Where a column `integral` is true, the values are whole numbers (ids, counters), which have no mean: those of the
    checkpoint with most weight are taken, of equal ones the least key.
    """
    whole = F.coalesce(F.col("integral"), F.lit(False)) if "integral" in parameters.columns else F.lit(False)
    each = parameters.join(F.broadcast(weights.select(key, "weight")), key).select("param", "weight", key, whole.alias("_whole"), F.posexplode("values").alias("pos", "v"))
    mean = F.sum(F.col("weight") * F.col("v")) / F.sum("weight")
    heaviest = F.min_by(F.col("v"), F.struct(-F.col("weight"), F.col(key))).cast("double")
    return each.groupBy("param", "pos").agg(F.when(F.bool_or("_whole"), heaviest).otherwise(mean).alias("value"))


# ---------------------------------------------------------------- parallel pairs


def parallel_pairs(examples: DataFrame, left: str, right: str, fields: tuple[str, ...] = ("premise", "hypothesis")) -> DataFrame:
    """Up to a row per field of each example: texts in two languages, where neither is empty. Fields are maps by language."""
    each = F.explode(F.array(*[F.struct(F.col(f)[left].alias(left), F.col(f)[right].alias(right), F.lit(f).alias("kind")) for f in fields]))
    rest = [c for c in examples.columns if c not in fields]
    rows = examples.select(*rest, each.alias("p")).select(*rest, "p.*")
    return rows.where((tx.strip(F.coalesce(left, F.lit(""))) != "") & (tx.strip(F.coalesce(right, F.lit(""))) != ""))


def write_pairs(pairs: DataFrame, path: str, columns: list[str]) -> None:
    """The pairs as text with tabs between columns and a head line, without quotes: tabs and line ends in texts become spaces."""
    flat = [F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " ").alias(c) for c in columns]
    pairs.select(*flat).write.option("sep", "\t").option("header", "true").option("quote", "").option("emptyValue", "").mode("overwrite").csv(path)


# ---------------------------------------------------------------- kept examples


def kept_examples(spark: SparkSession, make: Callable[[], DataFrame], folder: str | None, task: str, split: str, most: int | None) -> DataFrame:
    """The examples of a task, split and number as written before; made and written first if there are none. No folder: made each time."""
    if folder is None:
        return make()
    path = f"{folder}/{task}__{split}__{'all' if most is None else most}"
    if not paths.exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
