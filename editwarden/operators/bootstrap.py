"""Bootstrap of the test metrics, its summary and the shape of its distribution."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwarden.functions.hashing import hex_to_long
from editwarden.operators.metrics import areas, binary_metrics, score_counts
from editwarden.operators.running import HOT_ROWS
from editwarden.operators.sampling import SEED, bucket_sizes, hash_place, numbered
from editwarden.session import settle

METRIC_NAMES = ("Accuracy", "Precision", "Recall", "F1-score", "AUC-ROC", "AUC-PR")
# Most rows that are broadcast to the draws.
BROADCAST_ROWS = 1_000_000
# Most rows that a task hashes to look up its draws.
HASHED_ROWS = 1_000_000
# Most draws that are dealt to the rows one by one; more of them travel as packed lists.
SINGLE_DRAWS = 50_000_000
# Draws that a task packs at a time, and rows whose draws are counted at a time.
PACK_DRAWS = 4_000_000
PART_ROWS = 500_000
DIGITS = 15


def _pairs(spark, n: int, iterations: int, seed, tasks: int | None = None) -> DataFrame:
    """(iteration, pair, two rows): one md5 of seed, iteration and pair number gives two draws."""
    pairs = (n + 1) // 2
    numbers = spark.range(0, iterations * pairs, 1, tasks).select(
        F.floor(F.col("id") / pairs).alias("iteration"), (F.col("id") % pairs).alias("pair"))
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), "iteration", "pair"))
    return numbers.select("iteration", "pair", *[(hex_to_long(text, 1 + 16 * i, DIGITS) % n).alias(f"row_{i}") for i in (0, 1)])


def draws(spark, n: int, iterations: int, seed=SEED) -> DataFrame:
    """(iteration, row), one for each draw: ``n`` draws of ``n`` rows with replacement in each iteration."""
    both = F.array(*[F.struct((F.col("pair") * 2 + i).alias("slot"), F.col(f"row_{i}").alias("row")) for i in (0, 1)])
    slots = _pairs(spark, n, iterations, seed).select("iteration", F.explode(both).alias("_s")).select("iteration", "_s.*").where(F.col("slot") < n)
    return slots.select("iteration", "row")


def packed_draws(spark, n: int, iterations: int, starts: list[int], seed=SEED, most: int = PACK_DRAWS) -> DataFrame:
    """(part, iteration, draws): the draws of a task that fall to rows of a part, as one list of bytes.

    The rows drawn are sorted; each byte is the step from the row before (at first from the start of the part). 255 stands for a step of 255 that
    goes on in the next byte. A draw so takes about a byte, where a row of a shuffle takes some ten."""
    def pack(batches):
        import numpy as np
        import pyarrow as pa

        edges = np.array(starts, dtype=np.int64)
        seen = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()) for b in batches if b.num_rows]
        iteration, pair, one, two = (np.concatenate([s[i] for s in seen]) if seen else np.empty(0, np.int64) for i in range(4))
        for number in np.unique(iteration):
            mine = iteration == number
            rows = np.sort(np.concatenate([one[mine], two[mine & (pair * 2 + 1 < n)]]))
            rows = rows[rows >= edges[0]]
            if not len(rows):
                continue
            part = np.searchsorted(edges, rows, side="right") - 1
            first = np.flatnonzero(np.diff(part, prepend=-1))
            before = np.empty_like(rows)
            before[1:] = rows[:-1]
            before[first] = edges[part[first]]
            step = rows - before
            width = step // 255 + 1
            end = np.cumsum(width)
            packed = np.full(end[-1], 255, dtype=np.uint8)
            packed[end - 1] = step % 255
            cuts = [*(end[first] - width[first]).tolist(), len(packed)]
            lists = [packed[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[first].astype(np.int32)), pa.array(np.full(len(lists), number, dtype=np.int64)), pa.array(lists, pa.binary())],
                ["part", "iteration", "draws"])

    tasks = max(1, -(-n * iterations // most))
    return _pairs(spark, n, iterations, seed, tasks).mapInArrow(pack, "part int, iteration bigint, draws binary")


def packed_counts(
    df: DataFrame, key: str, sizes: list[int], iterations: int, seed=SEED, skipped: int = 0, rows: int = PART_ROWS, most: int = PACK_DRAWS,
) -> DataFrame:
    """As ``resampled_counts``: rows and packed draws meet part by part, a part being the rows of some neighbouring hash buckets.

    ``sizes`` are the rows of each bucket. The number of a row is its place in the order of the hashes, so its place in the part is its
    number less those of the parts before; the hash in 16 bytes is all of the key that is shuffled. ``skipped`` rows without a key come first
    in the numbers and are not drawn, as by ``numbered``."""
    what = ("y_true", "y_pred", "y_prob")
    n, buckets = sum(sizes), len(sizes)
    parts = min(-(-n // rows), buckets)
    of_part = [0] * parts
    for i, size in enumerate(sizes):
        of_part[i * parts // buckets] += size
    starts = [skipped, *(skipped + total for total in accumulate(of_part[:-1]))]
    bucket, place = hash_place(F.col(key), seed)
    left = df.select(F.floor(bucket.cast("bigint") * parts / buckets).cast("int").alias("part"), place.alias("_h"), *what).where("part IS NOT NULL")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    right = packed_draws(df.sparkSession, n, iterations, starts, seed, most)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(["iteration bigint", *[f"{c} {kinds[c]}" for c in what], "weight bigint"])

    def count(own, lists):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        own = own.take(pc.sort_indices(own, [("_h", "ascending")])).select(list(what))
        code = np.zeros(own.num_rows, dtype=np.int64)
        for c in what:
            coded = own.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
        different, kind = np.unique(code, return_index=True)[1], code
        found = {}
        for number, packed in zip(lists.column("iteration").to_pylist(), lists.column("draws")):
            steps = np.frombuffer(packed.as_buffer(), dtype=np.uint8)
            drawn = np.cumsum(steps, dtype=np.int64)[steps < 255]
            counted = np.bincount(kind[drawn], minlength=len(different))
            found[number] = found[number] + counted if number in found else counted
        tables = []
        for number, counted in found.items():
            at = np.flatnonzero(counted)
            one = own.take(pa.array(different[at]))
            tables.append(pa.table([pa.array(np.full(len(at), number, dtype=np.int64)), *one.columns, pa.array(counted[at].astype(np.int64))],
                                   names=["iteration", *what, "weight"]))
        return pa.concat_tables(tables) if tables else pa.table(
            [pa.array([], pa.int64()), *[own.column(c).slice(0, 0) for c in what], pa.array([], pa.int64())], names=["iteration", *what, "weight"])

    both = left.repartition(tasks, "part").groupBy("part").cogroup(right.repartition(tasks, "part").groupBy("part"))
    return both.applyInArrow(count, schema).groupBy("iteration", *what).agg(F.sum("weight").alias("weight"))


def resampled_counts(
    df: DataFrame, key: str, iterations: int, seed=SEED, poisson: bool = False, broadcast: int = BROADCAST_ROWS, single: int = SINGLE_DRAWS,
) -> DataFrame:
    """(iteration, y_true, y_pred, y_prob, weight) with weights added up per distinct combination.

    More draws than ``single`` are packed (``packed_counts``)."""
    what = ("y_true", "y_pred", "y_prob")
    if poisson:
        rounds = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(iterations - 1).cast("bigint")))
        rows = df.select(key, *what).withColumn("iteration", rounds)
        u = hex_to_long(F.md5(F.concat_ws("|", F.lit(str(seed)), "iteration", F.col(key).cast("string"))), 1, DIGITS) / F.lit(16.0 ** DIGITS)
        # rows drawn 0 times add nothing to the sums, so they need no filter
        rows = rows.withColumn("weight", _poisson_one(u))
        return rows.groupBy("iteration", *what).agg(F.sum("weight").alias("weight"))
    skipped, sizes = bucket_sizes(df, key, seed)
    if sum(sizes) * iterations > single:
        return packed_counts(df, key, sizes, iterations, seed, skipped)
    rows = settle(numbered(df.select(key, *what), key, seed).select("row", *what))
    n = rows.count()
    drawn = draws(df.sparkSession, n, iterations, seed)
    if n <= broadcast:
        rows = F.broadcast(rows)
    else:
        # there are ``iterations`` draws to a row: rows are hashed part by part, and no draw is sorted
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // HASHED_ROWS))
        drawn, rows = drawn.repartition(parts, "row"), rows.repartition(parts, "row").hint("shuffle_hash")
    drawn = drawn.join(rows, "row")
    return drawn.groupBy("iteration", *what).agg(F.count(F.lit(1)).alias("weight"))


def _poisson_one(u: Column) -> Column:
    """Poisson(1) from a uniform number: the count of cumulative probabilities it passes."""
    steps, chance, upto = [], 2.718281828459045 ** -1, 0.0
    for k in range(18):
        upto += chance
        steps.append((u >= F.lit(upto)).cast("int"))
        chance /= k + 1
    total = steps[0]
    for s in steps[1:]:
        total = total + s
    return total


def bootstrap(
    df: DataFrame, key: str, iterations: int = 1000, seed=SEED, poisson: bool = False, limit: int | None = HOT_ROWS,
) -> DataFrame:
    """Six metrics for each resample.

    All iterations are one job. Each resample draws as many rows as the table has; ``poisson``
    gives every row an independent Poisson(1) weight instead, so that very large tables need no
    join and the resample size varies a little."""
    counts = settle(resampled_counts(df, key, iterations, seed, poisson))
    weight = F.col("weight")
    by = ["iteration"]
    points = binary_metrics(counts, by, weight)
    curves = areas(counts, by, weight, limit)
    both = points.join(curves.withColumnRenamed("iteration", "_i"), F.col("iteration") == F.col("_i"))
    names = dict(zip(("accuracy", "precision", "recall", "f1_score", "auc_roc", "auc_pr"), METRIC_NAMES))
    return both.select("iteration", *[F.col(a).alias(b) for a, b in names.items()])


def long_form(df: DataFrame, metrics=METRIC_NAMES) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics])
    return df.select(F.explode(entries).alias("_e")).select("_e.*")


def bootstrap_summary(df: DataFrame, metrics=METRIC_NAMES) -> DataFrame:
    """Mean, standard deviation and 95 % interval; one value per iteration and metric."""
    quantiles = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return long_form(df, metrics).groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std_dev"), quantiles.alias("_q"),
    ).select("metric", "mean", "std_dev", F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"))


def bootstrap_shape(df: DataFrame, metrics=METRIC_NAMES) -> DataFrame:
    """Skewness, excess kurtosis and the D'Agostino-Pearson normality test; null below 8 values."""
    moments = long_form(df, metrics).groupBy("metric").agg(
        F.count("value").cast("double").alias("n"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"))
    p = F.when(F.col("n") >= 8, normality_p(F.col("n"), F.col("skewness"), F.col("kurtosis")))
    rows = moments.withColumn("p_value", p)
    return rows.select("metric", "skewness", "kurtosis", F.when(F.col("p_value") > 0.05, "Yes").otherwise("No").alias("normal"), "p_value")


def normality_p(n: Column, skew: Column, kurt: Column) -> Column:
    """p-value of the omnibus test from the population skewness and excess kurtosis of n values."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    spread = F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    x = (kurt + 3 - 3 * (n - 1) / (n + 1)) / spread
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1 / 3))
    z2 = (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))
    return F.exp(-(z1 * z1 + z2 * z2) / 2)
