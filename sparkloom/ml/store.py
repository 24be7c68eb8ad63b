"""Stored vectors in fewer bits: linear codes, half precision, and differences from a base at a given tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources.files import folder


def half(v: Column) -> Column:
    """Each number as the nearest one of 11 significant bits, which half precision holds between 2^-14 and 65504."""
    def one(x: Column) -> Column:
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
        return F.when(x == 0, x).otherwise(F.rint(x / step) * step)

    return F.transform(v.cast("array<double>"), one)


def delta(v: Column, base: Column, tolerance: float) -> Column:
    """struct(lo, step, bits, codes): differences from base in as few bits as the tolerance allows."""
    gap = F.zip_with(v.cast("array<double>"), base.cast("array<double>"), lambda a, b: a - b)
    lo, hi = F.array_min(gap), F.array_max(gap)
    bits = F.greatest(F.ceil(F.log2((hi - lo) / F.lit(tolerance) + 1)), F.lit(1)).cast("int")
    step = F.greatest((hi - lo) / (F.pow(F.lit(2.0), bits) - 1), F.lit(1e-300))
    return F.struct(lo.alias("lo"), step.alias("step"), bits.alias("bits"), F.transform(gap, lambda x: F.rint((x - lo) / step).cast("int")).alias("codes"))


def undelta(z: Column, base: Column) -> Column:
    return F.zip_with(z["codes"], base.cast("array<double>"), lambda c, b: b + z["lo"] + c * z["step"])


class VectorStore:
    """Named tables of vectors (id, v) in the shared folder, each in a form of its own."""

    FORMS = ("float", "half", "uint8", "delta")

    def __init__(self, spark: SparkSession):
        self.spark, self.saved = spark, {}

    def save(self, name: str, vectors: DataFrame, form: str = "float", base: Column | None = None, tolerance: float = 1e-3) -> None:
        if form not in self.FORMS:
            raise ValueError(f"no form {form}; there are {', '.join(self.FORMS)}")
        v = F.col("v")
        shown = {"float": lambda: v, "half": lambda: half(v), "uint8": lambda: numbers.quantize(v), "delta": lambda: delta(v, base, tolerance)}[form]()
        path = folder(self.spark, f"vectors-{name}")
        out = vectors.select("id", shown.alias("z"))
        out.write.parquet(path)
        self.saved[name] = (form, path, out.schema, base)

    def load(self, name: str) -> DataFrame:
        """(id, v) as numbers again."""
        form, path, schema, base = self.saved[name]
        z = F.col("z")
        back = {"float": lambda: z, "half": lambda: z, "uint8": lambda: numbers.dequantize(z), "delta": lambda: undelta(z, base)}[form]()
        return self.spark.read.schema(schema).parquet(path).select("id", back.cast("array<double>").alias("v"))
