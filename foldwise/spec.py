"""FeatureSpec: column roles resolved once, from name conventions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FeatureSpec:
    id_col: str = "id"
    label: str = "target"
    split_col: str = "split"
    fold_col: str = "fold"
    drop_prefix: str = "calc_"      # droppable noise group (reference: ``ps_calc_``)
    cat_suffix: str = "cat"         # one-hot candidates: name ends with it
    te_marker: str = "_cat"         # target-encoding candidates: name contains it
    bin_marker: str = "_bin"        # excluded from mean/median flags
    sentinel: int = -1
    reserved: tuple = field(default=("id", "target", "split", "fold"))

    def features(self, df: DataFrame) -> list[str]:
        skip = {self.id_col, self.label, self.split_col, self.fold_col, *self.reserved}
        return [c for c in df.columns if c not in skip]

    def droppable(self, df: DataFrame) -> list[str]:
        return [c for c in self.features(df) if c.startswith(self.drop_prefix)]

    def one_hot_cols(self, df: DataFrame) -> list[str]:
        return [c for c in self.features(df) if c.endswith(self.cat_suffix)]

    def te_cols(self, df: DataFrame) -> list[str]:
        return [c for c in self.features(df) if self.te_marker in c]

    def non_bin(self, df: DataFrame) -> list[str]:
        return [c for c in self.features(df) if self.bin_marker not in c]

    def numeric(self, df: DataFrame) -> list[str]:
        types = dict(df.dtypes)
        return [c for c in self.features(df)
                if types[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
