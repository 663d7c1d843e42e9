"""Feature preprocessing (M3), bin codes of trees, and the slot -> source-column map.

Numerics are standardised with the means and population deviations of the rows a model is fit on;
every other column becomes one slot per level seen in training, all zeros for an unseen level.
Trees see each slot as a small code: numerics by quantile bins, the others by six bins of [0, 1]
(only rows made by over-sampling lie between the ends).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.operators.clean import categorical_columns, feature_projection

NUMERIC = list(K.NUMERIC_COLUMNS)
#: Bins of a numeric slot, and of the slot of a level: none, four parts of (0, 1), all.
NUMERIC_BINS, LEVEL_BINS = 64, 6
#: Relative error of the bin edges' ranks.
EDGE_ACCURACY = 10_000


@dataclass(frozen=True)
class Encoder:
    """How raw columns become numbers: levels of each categorical column, bin edges and scaling of the numeric ones."""

    numeric: tuple[str, ...]
    levels: dict[str, tuple[str, ...]]
    edges: tuple[tuple[float, ...], ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.levels]

    @property
    def groups(self) -> list[str]:
        """Source column of every slot."""
        return [*self.numeric, *(c for c, own in self.levels.items() for _ in own)]

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(map(len, self.levels.values()))

    @property
    def first_slots(self) -> np.ndarray:
        """Slot of the first level of each categorical column."""
        return len(self.numeric) + np.cumsum([0, *map(len, self.levels.values())])[:-1].astype(np.int64)

    def scaled_by(self, means: np.ndarray, scales: np.ndarray) -> Encoder:
        return replace(self, means=tuple(map(float, means)), scales=tuple(map(float, scales)))

    def to_json(self) -> str:
        return json.dumps({"numeric": self.numeric, "levels": self.levels, "edges": self.edges, "means": self.means, "scales": self.scales})

    @classmethod
    def from_json(cls, text: str) -> Encoder:
        d = json.loads(text)
        return cls(tuple(d["numeric"]), {c: tuple(v) for c, v in d["levels"].items()}, tuple(map(tuple, d["edges"])), tuple(d["means"]), tuple(d["scales"]))

    def read(self, columns: dict[str, pa.Array]) -> Rows:
        """Rows from Arrow arrays by column name; a missing numeric value is an error."""
        num = []
        for c in self.numeric:
            x = pc.cast(columns[c], pa.float64())
            if x.null_count:
                raise ValueError(f"{c} holds nulls; clean the rows before scoring")
            num.append(x.to_numpy(zero_copy_only=False))
        levels = [pc.fill_null(pc.index_in(pc.cast(columns[c], pa.string()), value_set=pa.array(own, pa.string()), skip_nulls=True), -1)
                  .to_numpy(zero_copy_only=False) for c, own in self.levels.items()]
        n = len(columns[self.numeric[0]])
        return Rows(self, np.stack(num, axis=1) if num else np.zeros((n, 0)), np.stack(levels, axis=1).astype(np.int16) if levels else np.zeros((n, 0), np.int16))


@dataclass
class Rows:
    """Feature rows: numeric values and level numbers (-1 for a level unseen in training).  Rows made by over-sampling also have the
    levels of their second parent and the share ``gap`` of it."""

    encoder: Encoder
    num: np.ndarray
    level: np.ndarray
    other: np.ndarray | None = None
    gap: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.num)

    def take(self, k) -> Rows:
        return Rows(self.encoder, self.num[k], self.level[k], None if self.other is None else self.other[k], None if self.gap is None else self.gap[k])

    def _levels(self, out: np.ndarray, one, part) -> np.ndarray:
        first = self.encoder.first_slots
        row, col = np.nonzero(self.level >= 0)
        out[row, first[col] + self.level[row, col]] = one
        if self.other is not None:
            row, col = np.nonzero(self.level != self.other)
            gap = self.gap[row]
            seen = self.level[row, col] >= 0
            out[row[seen], first[col[seen]] + self.level[row, col][seen]] = part(1 - gap[seen])
            seen = self.other[row, col] >= 0
            out[row[seen], first[col[seen]] + self.other[row, col][seen]] = part(gap[seen])
        return out

    def values(self, scaled: bool = True) -> np.ndarray:
        """The slots as numbers, numerics standardised."""
        e = self.encoder
        out = np.zeros((len(self), e.width))
        out[:, :len(e.numeric)] = (self.num - np.array(e.means)) / np.array(e.scales) if scaled else self.num
        return self._levels(out, 1.0, lambda share: share)

    def codes(self) -> np.ndarray:
        """The slots as bin codes."""
        e = self.encoder
        out = np.zeros((len(self), e.width), np.uint8)
        for k, edges in enumerate(e.edges):
            out[:, k] = np.searchsorted(np.array(edges), self.num[:, k], side="left")
        last = LEVEL_BINS - 1
        inner = lambda share: np.where(share <= 0, 0, np.where(share >= 1, last, 1 + np.minimum(share * (LEVEL_BINS - 2), LEVEL_BINS - 3).astype(int)))
        return self._levels(out, last, inner)


def fit_encoder(train: DataFrame) -> Encoder:
    """Levels, bin edges and scaling of training rows, each from one small aggregation.  Features are found from the rows: without label and id
    (C13), and categorical where they are not one of the numeric columns (C14)."""
    categorical = categorical_columns(feature_projection(train, [c for c in train.columns if c in K.FEATURE_COLUMNS]))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical])).alias("x")
    levels: dict[str, list[str]] = {c: [] for c in categorical}
    for r in train.select(pairs).select("x.c", "x.v").where("v IS NOT NULL").distinct().collect():
        levels[r["c"]].append(r["v"])
    share = [k / NUMERIC_BINS for k in range(1, NUMERIC_BINS)]
    num = train.agg(*[F.percentile_approx(F.col(c).cast("double"), share, EDGE_ACCURACY).alias(f"q{k}") for k, c in enumerate(NUMERIC)],
                    *[F.avg(c).alias(f"m{k}") for k, c in enumerate(NUMERIC)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(NUMERIC)]).first()
    edges = tuple(tuple(sorted(set(num[f"q{k}"] or []))) for k in range(len(NUMERIC)))
    return Encoder(tuple(NUMERIC), {c: tuple(sorted(v)) for c, v in levels.items()}, edges,
                   tuple(num[f"m{k}"] or 0.0 for k in range(len(NUMERIC))), tuple(num[f"s{k}"] or 1.0 for k in range(len(NUMERIC))))
