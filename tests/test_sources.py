import base64
import struct
import zlib

from pyspark.sql import functions as F

from denovospark.sources import readers
from denovospark.streaming import annotate

MGF = """BEGIN IONS
TITLE=first
PEPMASS=500.25 1000
CHARGE=2+
100.5 10
200.25 3.5e2
END IONS

BEGIN IONS
TITLE=second
PEPMASS=300
150.0
END IONS
"""
LIBRARY = """<mzSpecLib>
MS:1003186|library format version=1.0
<Spectrum=1>
MS:1003061|library spectrum name=PEPTIDE/2
<Analyte=1>
MS:1000888|stripped peptide sequence=PEPTIDE
MS:1000224|theoretical mass=799.36
<Peaks>
98.06\t10.0\tb1/0.1
147.2\t5.5\ty1-H2O^2/1.0,b3-NH3/0.5
300.0\t1.0\t?
400.0\t2.0
<Spectrum=2>
MS:1000888|stripped peptide sequence=TEST
<Peaks>
102.05\t1\tb1
"""


def write(path, text):
    path.write_text(text)
    return str(path)


def test_mgf(spark, tmp_path):
    write(tmp_path / "mouse.mgf", MGF)
    write(tmp_path / "yeast.mgf", MGF.replace("first", "third"))
    rows = readers.read_mgf(spark, f"{tmp_path}/*.mgf").orderBy("species", "title").collect()
    assert [(r.species, r.title, r.pepmass, r.charge) for r in rows[:2]] == [("mouse", "first", 500.25, "2+"), ("mouse", "second", 300.0, "")]
    assert (rows[0].mz, rows[0].intensity, rows[1].intensity) == ([100.5, 200.25], [10.0, 350.0], [1.0])
    assert len(rows) == 4
    peaks = readers.peaks_of(readers.read_mgf(spark, f"{tmp_path}/mouse.mgf"), "title")
    assert peaks.count() == 3 and readers.from_data(spark, 1, [1.0, 2.0]).agg(F.sum("intensity")).first()[0] == 2.0


def test_library(spark, tmp_path):
    rows = {(r.spectrum, r.peak_id): r for r in readers.read_mzlib(spark, write(tmp_path / "lib.txt", LIBRARY)).collect()}
    assert len(rows) == 5 and rows[1, 0].pivot == 399.68 and rows[1, 0].peptide == "PEPTIDE"
    assert (rows[1, 0].series, rows[1, 0].position, rows[1, 0].charges, rows[1, 0].losses) == ("b", 1, [1], [""])
    assert (rows[1, 1].series, rows[1, 1].position, rows[1, 1].charges, rows[1, 1].losses) == ("y", 1, [2, 1], ["H2O1", "H3N1"])
    assert (rows[1, 2].series, rows[1, 2].position, rows[1, 2].charges, rows[1, 2].losses) == ("", 0, [0], [""])


def test_mzml(spark, tmp_path):
    def block(values, kind, wide, packed):
        data = struct.pack(f"<{len(values)}{'d' if wide else 'f'}", *values)
        data = base64.b64encode(zlib.compress(data) if packed else data).decode()
        return f'<binaryDataArray><cvParam accession="{"MS:1000523" if wide else "MS:1000521"}" name="w"/><cvParam accession="{"MS:1000574" if packed else "MS:1000576"}" name="c"/><cvParam accession="{kind}" name="k"/><binary>{data}</binary></binaryDataArray>'

    text = '<mzML><run><spectrumList count="1"><spectrum index="0" id="scan=1"><binaryDataArrayList count="2">' + block([100.5, 200.25], "MS:1000514", True, True) + block([1.5, 2.0], "MS:1000515", False, False) + "</binaryDataArrayList></spectrum></spectrumList></run></mzML>"
    row = readers.read_mzml(spark, write(tmp_path / "a.mzml", text)).first()
    assert (row.spectrum, row.mz, row.intensity) == (0, [100.5, 200.25], [1.5, 2.0])


def test_fasta_round_trip(spark, tmp_path):
    table = readers.read_fasta(spark, write(tmp_path / "a.fa", ">one first protein\nPEP\nTIDE\n>two\nTEST\n"))
    assert {tuple(r) for r in table.collect()} == {("one", "PEPTIDE"), ("two", "TEST")}
    readers.reversed_fasta(spark, str(tmp_path / "a.fa"), str(tmp_path / "back"))
    assert {tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "back")).collect()} == {("one", "EDITPEP"), ("two", "TSET")}


def test_small_sources(spark, tmp_path):
    assert readers.read_amino_table(spark, write(tmp_path / "t.txt", "G \t57.02\nA \t71.03\n")).count() == 2
    kinds = spark.createDataFrame([("a.mgf",), ("b.MZML",), ("c.fasta",), ("PEPTIDE::simple",), ("what",)], "x string").select(readers.input_kind(F.col("x"))).collect()
    assert [r[0] for r in kinds] == ["mgf", "mzml", "fasta", "peptide", None]
    assert [tuple(r) for r in readers.peptide_literals(spark, ["TEST::complex", "PEP"]).collect()] == [("TEST", "complex"), ("PEP", "simple")]
    readers.save_stage(spark.range(3), str(tmp_path / "run"), "anno")
    assert readers.load_stage(spark, str(tmp_path / "run"), "anno").count() == 3


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, k, 10.0 * k, f"2024-01-01 00:{k:02d}:00") for k in range(1, 9)], "user_id long, event_id long, value double, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = annotate.annotate_stream(stream, annotate.decharge_stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 24 and out.filter("charge = 2 and event_id = 1").first().mass == 2 * 10.0 - 1.007
    batch = annotate.windowed_spectra(events, "5 minutes").orderBy("start").collect()
    assert [(r.n, r.low, r.high) for r in batch] == [(4, 10.0, 40.0), (4, 50.0, 80.0)]
