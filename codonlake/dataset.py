"""A thin façade: labelled sequences with a declared identifier, split and kind of label.

Every method returns a new dataset; nothing is computed before an action on ``df``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions import sequence as sq
from codonlake.operators import augment, sampling, stats
from codonlake.sources import files

KINDS = ("classification", "regression", "multi_label", "multi_regression", "unknown")


@dataclass(frozen=True)
class SequenceDataset:
    df: DataFrame
    id_col: str = "row_id"
    seq: str = "sequence"
    label: str = "labels"
    split: str | None = None
    kind: str = "unknown"

    def __post_init__(self) -> None:
        if self.df is None:
            raise TypeError("a dataset needs a table")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")

    @classmethod
    def load(cls, spark: SparkSession, paths: str | list[str] | Mapping[str, str | list[str]], kind: str = "unknown", label_sep: str = ";", **options: str) -> SequenceDataset:
        """Files as a dataset, with labels typed by its kind. Rows get their identifiers in file order within each part of a
        file."""
        df = files.standard_columns(files.read(spark, paths, **options))
        df = files.typed_labels(df, kind, "labels", label_sep).withColumn("row_id", F.monotonically_increasing_id())
        return cls(df, split="split" if isinstance(paths, Mapping) else None, kind=kind)

    @property
    def by(self) -> list[str]:
        return [self.split] if self.split else []

    def _with(self, df: DataFrame) -> SequenceDataset:
        return replace(self, df=df)

    def validate(self, least: int = 20, most: int = 6000, gc: tuple[float, float] = (0.0, 1.0), letters: str = "ACGTN") -> SequenceDataset:
        return self._with(self.df.where(sq.is_valid(F.col(self.seq), least, most, gc, letters)))

    def drop_missing(self) -> SequenceDataset:
        return self._with(stats.drop_missing(self.df, self.seq, self.label))

    def with_reverse_complement(self) -> SequenceDataset:
        return self._with(augment.with_reverse_complement(self.df, self.seq))

    def concat_reverse_complement(self, sep: str = "") -> SequenceDataset:
        return self._with(augment.concat_reverse_complement(self.df, self.seq, sep))

    def reverse_complement_some(self, ratio: float, seed: int = 0) -> SequenceDataset:
        return self._with(augment.reverse_complement_some(self.df, self.id_col, ratio, self.by, self.seq, seed))

    def append(self, other: DataFrame) -> SequenceDataset:
        return self._with(augment.append_rows(self.df, other))

    def sample(self, ratio: float, seed: int = 0) -> SequenceDataset:
        return self._with(sampling.sample(self.df, self.id_col, ratio, self.by, seed))

    def shuffle(self, seed: int = 0) -> SequenceDataset:
        return self._with(sampling.shuffle(self.df, self.id_col, self.by, seed))

    def split_data(self, test: float = 0.2, val: float = 0.1, seed: int = 0) -> SequenceDataset:
        if self.split:
            raise ValueError("the dataset is split already")
        return replace(self, df=sampling.split(self.df, self.id_col, test, val, seed).withColumnRenamed("part", "split"), split="split")

    def head(self, n: int = 5) -> DataFrame:
        return sampling.head(self.df, self.id_col, n, self.by)

    def row(self, id_: int) -> DataFrame:
        if self.split:
            raise ValueError("rows of a split dataset are found by filter")
        return self.df.where(F.col(self.id_col) == id_)

    def batches(self, size: int) -> Iterator[list]:
        """Batches in order of the identifier, fetched part by part."""
        if size < 1:
            raise ValueError("size must be at least 1")
        batch: list = []
        for r in self.df.orderBy(self.id_col).toLocalIterator():
            batch.append(r)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    def statistics(self) -> DataFrame:
        return stats.length_stats(self.df, self.by, self.seq)

    def encode(self, length: int, side: str = "right") -> DataFrame:
        """Base numbers cut or padded to ``length``, and the mask."""
        ids = self.df.select("*", sq.padded_ids(F.col(self.seq), length, side).alias("input_ids"))
        return ids.withColumn("attention_mask", sq.attention_mask(F.col("input_ids")))


def kind_of(label_type: str, values: int | None = None) -> str:
    """The kind of a declared label type: a list of numbers is multi_label, or multi_regression if it isn't of 0 and 1."""
    if label_type.startswith("array"):
        return "multi_label" if values in (None, 2) else "multi_regression"
    return {"int": "classification", "bigint": "classification", "string": "classification", "double": "regression", "float": "regression"}.get(label_type, "unknown")


def evaluation_split(names: list[str]) -> str | None:
    """The split to evaluate on: the first that is neither train nor test, else test, else none."""
    return next((n for n in names if n not in ("train", "test")), "test" if "test" in names else None)
