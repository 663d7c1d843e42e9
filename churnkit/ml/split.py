"""Keyed, deterministic train/test split and CV folds (M1, M2).

Randomness is a hash of (seed, customer key), so an assignment never depends on partitioning or row order and is reproducible
on any cluster.  The split is exact per class without ranking any rows: the test rows of a class are those whose hash is at most a cut,
and a fold is the range of a second hash between two cuts.  Cuts are found digit by digit: a round counts the rows of each
possible next digit within the prefixes still open (a few thousand counts, whatever the data) until a prefix ends exactly where the
rank does.  The assignment itself is then a comparison with literals: no join, no window and no shuffle.

Rows of one key have one hash and go together; sizes are exact up to that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit import constants as K

HASH_BITS, DIGIT_BITS = 63, 9


def key_uniform(seed: int, salt: str, key: str = K.ID_COLUMN) -> Column:
    """A 63-bit non-negative hash of (seed, salt, key)."""
    return F.xxhash64(F.lit(seed), F.lit(salt), F.col(key)).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def hash_cuts(df: DataFrame, label: str, h: str, ranks: dict[int, list[int]]) -> dict[int, list[int]]:
    """For each class, the values of ``h`` up to which as many of its rows lie as each of ``ranks`` says; -1 for none."""
    cuts: dict[tuple[int, int], int] = {}
    open_: dict[tuple[int, int], tuple[int, int]] = {}  # (class, rank) -> (prefix, rows still to take within it)
    for c, own in ranks.items():
        for rank in own:
            if rank <= 0:
                cuts[c, rank] = -1
            else:
                open_[c, rank] = (0, rank)
    shift = HASH_BITS
    while open_ and shift > 0:
        above, shift = shift, max(shift - DIGIT_BITS, 0)
        prefixes = sorted({(c, p) for (c, _), (p, _) in open_.items()})
        inside = F.lit(False)
        for c, p in prefixes:
            inside = inside | ((F.col(label) == c) & (F.col(h) >= F.lit(p << above)) & (F.col(h) <= F.lit(((p + 1) << above) - 1)))
        counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in df.where(inside).groupBy(label, F.shiftright(h, shift).alias("d")).count().collect():
            counts.setdefault((r[label], r["d"] >> (above - shift)), []).append((r["d"], r["count"]))
        for key, (p, left) in list(open_.items()):
            for d, n in sorted(counts.get((key[0], p), [])):
                if left <= n:
                    break
                left -= n
            else:  # fewer rows than the rank
                cuts[key] = ((p + 1) << above) - 1
                del open_[key]
                continue
            if left == n or shift == 0:
                cuts[key] = ((d + 1) << shift) - 1
                del open_[key]
            else:
                open_[key] = (d, left)
    return {c: [cuts[c, rank] for rank in own] for c, own in ranks.items()}


def split_assign(df: DataFrame, test_size: float = K.TEST_SIZE, seed: int = K.RANDOM_STATE,
                 n_folds: int = K.CV_FOLDS, label: str = K.TARGET_COLUMN) -> DataFrame:
    """Add ``is_test`` (exact stratified share per class) and ``fold`` (0..n_folds-1, equal shares of each class's training
    rows).  The passes that count read ``label`` and the key only."""
    d = df.withColumn("_h", key_uniform(seed, "split")).withColumn("_f", key_uniform(seed, "fold"))
    counted = d.select(label, "_h", "_f")
    sizes = {r[label]: r["count"] for r in counted.groupBy(label).count().collect()}
    tests = hash_cuts(counted, label, "_h", {c: [round(n * test_size)] for c, n in sizes.items()})
    test = F.lit(False)
    for c, (cut,) in tests.items():
        test = test | ((F.col(label) == c) & (F.col("_h") <= F.lit(cut)))
    left = {r[label]: r["count"] for r in counted.where(~test).groupBy(label).count().collect()}
    folds = hash_cuts(counted.where(~test), label, "_f", {c: [n * k // n_folds for k in range(1, n_folds)] for c, n in left.items()})
    fold = F.lit(None).cast("int")
    for c, own in folds.items():
        fold = F.when(F.col(label) == c, sum(((F.col("_f") > F.lit(cut)).cast("int") for cut in own), F.lit(0))).otherwise(fold)
    return d.withColumn("is_test", test).withColumn("fold", F.when(~F.col("is_test"), fold)).drop("_h", "_f")
