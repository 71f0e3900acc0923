"""Spectra and sequences from files, as DataFrames. Files are split by record, so a large one is read by many tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.scalars import loss_name


def _species() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """(species, title, pepmass, charge, mz array, intensity array); path may be a glob, species is the file's stem."""
    blocks = spark.read.option("lineSep", "END IONS").text(path).select(_species().alias("species"), F.regexp_extract("value", r"(?s)BEGIN IONS\s*\n(.*)", 1).alias("block")).filter("block <> ''")
    field = lambda name: F.regexp_extract("block", rf"(?m)^{name}=(.*?)\s*$", 1)
    rows = F.regexp_extract_all("block", F.lit(r"(?m)^\s*(\d[\d.eE+-]*)(?:[ \t]+[\d.eE+-]+)?"), 0)
    pairs = F.transform(rows, lambda r: F.split(F.trim(r), r"\s+"))
    return blocks.select(
        "species", field("TITLE").alias("title"), F.split(field("PEPMASS"), " ")[0].try_cast("double").alias("pepmass"), field("CHARGE").alias("charge"),
        F.transform(pairs, lambda p: p[0].cast("double")).alias("mz"), F.transform(pairs, lambda p: F.coalesce(F.get(p, F.lit(1)).cast("double"), F.lit(1.0))).alias("intensity"),
    )


def peaks_of(spectra: DataFrame, key: str) -> DataFrame:
    """(spectrum, peak_id, mz, intensity) from arrays."""
    return spectra.select(F.col(key).alias("spectrum"), F.posexplode(F.arrays_zip("mz", "intensity")).alias("peak_id", "p")).select("spectrum", "peak_id", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def from_data(spark: SparkSession, spectrum: object, mz: list[float], intensity: list[float] | None = None) -> DataFrame:
    rows = [(spectrum, k, float(m), float(intensity[k]) if intensity else 1.0) for k, m in enumerate(mz)]
    return spark.createDataFrame(rows, f"spectrum {'string' if isinstance(spectrum, str) else 'long'}, peak_id int, mz double, intensity double")


def read_mzlib(spark: SparkSession, path: str) -> DataFrame:
    """Labelled peaks of a text spectral library: (spectrum, peptide, pivot, peak_id, mz, intensity, series, position, charges, losses).

    A peak's annotations are y3-H2O^2/ppm, several apart by commas. Series and position are the first one's; without one, '', 0, [0], [''].
    """
    blocks = spark.read.option("lineSep", "<Spectrum=").text(path).filter("value rlike '^\\\\d+>'")
    head = blocks.select(
        F.regexp_extract("value", r"^(\d+)>", 1).cast("long").alias("spectrum"), F.regexp_extract("value", r"(?m)stripped peptide sequence=(\S+)", 1).alias("peptide"),
        (F.regexp_extract("value", r"(?m)theoretical mass=([\d.]+)", 1).try_cast("double") / 2).alias("pivot"),
        F.regexp_extract_all("value", F.lit(r"(?m)^(\d[\d.]*\t[\d.eE+-]+(?:\t[^\r\n]*)?)"), 1).alias("rows"),
    )
    rows = head.select("spectrum", "peptide", "pivot", F.posexplode("rows").alias("peak_id", "row")).withColumn("f", F.split("row", "\t"))
    notes = F.filter(F.split(F.coalesce(F.get("f", F.lit(2)), F.lit("")), ","), lambda a: a.rlike(r"^[abcxyz]\d+"))
    part = lambda a, k: F.regexp_extract(a, r"^([abcxyz])(\d+)((?:-[A-Za-z0-9]+)*)(?:\^(\d+))?", k)
    charge = lambda a: F.when(part(a, 4) == "", 1).otherwise(part(a, 4).cast("int"))
    loss = lambda a: F.array_join(F.transform(F.filter(F.split(part(a, 3), "-"), lambda x: x != ""), loss_name), "-")
    any_note = F.size(notes) > 0
    first = F.get(notes, F.lit(0))
    return rows.select(
        "spectrum", "peptide", "pivot", "peak_id", F.get("f", F.lit(0)).cast("double").alias("mz"), F.get("f", F.lit(1)).cast("double").alias("intensity"),
        F.when(any_note, part(first, 1)).otherwise("").alias("series"), F.when(any_note, part(first, 2).cast("int")).otherwise(0).alias("position"),
        F.when(any_note, F.transform(notes, charge)).otherwise(F.array(F.lit(0))).alias("charges"), F.when(any_note, F.transform(notes, loss)).otherwise(F.array(F.lit(""))).alias("losses"),
    )


@F.pandas_udf(ArrayType(DoubleType()))
def _floats(values: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, packed, wide in values:
        yield pd.Series([np.frombuffer(zlib.decompress(d) if z else d, "<f8" if w else "<f4").astype(float).tolist() for d, z, w in zip(data, packed, wide, strict=True)])


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """(spectrum, mz array, intensity array) from mzML: base64 blocks, compressed or not, of 32 or 64 bits."""
    param = "array<struct<_accession:string,_name:string>>"
    schema = f"_index long, _id string, binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{param},binary:string>>>"
    table = spark.read.format("xml").option("rowTag", "spectrum").schema(schema).load(path)
    each = table.select(F.col("_index").alias("spectrum"), F.explode("binaryDataArrayList.binaryDataArray").alias("b"))
    names = F.transform("b.cvParam", lambda p: p["_accession"])
    has = lambda x: F.array_contains(names, x)
    values = _floats(F.unbase64("b.binary"), has("MS:1000574"), has("MS:1000523"))
    kind = F.when(has("MS:1000514"), "mz").when(has("MS:1000515"), "intensity")
    return each.select("spectrum", kind.alias("kind"), values.alias("v")).filter("kind is not null").groupBy("spectrum").agg(F.first(F.when(F.col("kind") == "mz", F.col("v")), True).alias("mz"), F.first(F.when(F.col("kind") == "intensity", F.col("v")), True).alias("intensity"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence). A record begins with > at the start of a line."""
    records = spark.read.option("lineSep", "\n>").text(path).filter("trim(value) <> ''")
    head = F.regexp_replace(F.regexp_extract("value", r"^>?([^\r\n]*)", 1), r"\s.*", "")
    return records.select(head.alias("id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*(\n|$)", ""), r"[\s>]", "").alias("sequence"))


def write_fasta(sequences: DataFrame, path: str, id_col: str = "id", text_col: str = "sequence") -> None:
    sequences.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(text_col)).alias("value")).write.text(path)


def reversed_fasta(spark: SparkSession, path: str, out: str) -> None:
    write_fasta(read_fasta(spark, path).withColumn("sequence", F.reverse("sequence")), out)


def read_amino_table(spark: SparkSession, path: str, separator: str = " \t") -> DataFrame:
    """Delimited rows as strings. Rows end with a line feed; what follows the last one isn't a row."""
    return spark.read.option("sep", separator).csv(path)


def input_kind(value: Column) -> Column:
    """What an input string names: a file by its ending, else a peptide if its part before :: is one."""
    from ..functions.scalars import in_alphabet

    ends = lambda *x: F.lower(value).rlike(rf"\.({'|'.join(x)})$")
    return F.when(ends("mgf"), "mgf").when(ends("mzlib", "txt"), "mzlib").when(ends("mzml"), "mzml").when(ends("fa", "fasta"), "fasta").when(in_alphabet(F.split(value, "::")[0]), "peptide")


def peptide_literals(spark: SparkSession, literals: list[str]) -> DataFrame:
    """(peptide, mode) from SEQ::mode; the mode is simple where none is given."""
    return spark.createDataFrame([(*x.split("::"), "simple")[:2] for x in literals], "peptide string, mode string")


def save_stage(table: DataFrame, path: str, stage: str) -> None:
    """A stage's table, beside those of other stages."""
    table.write.mode("overwrite").parquet(f"{path}/stage={stage}")


def load_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{path}/stage={stage}")


def encode_floats(x: Column) -> Column:
    """An array as base64 of its JSON; ``decode_floats`` gives it back to the last bit."""
    return F.base64(F.to_json(x).cast("binary"))


def decode_floats(x: Column) -> Column:
    return F.from_json(F.unbase64(x).cast("string"), "array<double>")
