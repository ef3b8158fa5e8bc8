"""The data source of signal records: batches, broken files and the stream."""

import datetime as dt

import pytest

from horizonspark.sources import files, signals

OK = "1\tT\tYagi\t8\tN\t0000\t5\t9\t2024\t+\t0100\t6\t9\t2024\t+\t1200"
BAD = [OK.replace("\t8\t", "\tx\t"), "\t".join(OK.split("\t")[:15]), OK.replace("\t5\t9\t", "\t31\t2\t")]


@pytest.fixture(scope="module")
def reader(spark):
    signals.register(spark)
    return lambda path, **o: spark.read.format("signal_records").options(**o).load(str(path))


def test_records_and_corrupt_ones(spark, tmp_path, reader):
    (tmp_path / "a.tsv").write_bytes(("﻿" + OK + "\r\n\n" + "\n".join(BAD)).encode())
    (tmp_path / "b.tsv").write_text(OK.replace("Yagi", "Öst") + "\n")
    (tmp_path / "_temporary").write_text("no data")
    (tmp_path / "empty.tsv").write_text("")
    df = reader(tmp_path)
    assert df.rdd.getNumPartitions() == 3
    good = [tuple(r)[:4] for r in df.where("corrupt is null").orderBy("name").collect()]
    assert good == [(dt.date(2024, 9, 5), dt.date(2024, 9, 6), 8, n) for n in ("Yagi", "Öst")]
    assert sorted(r["corrupt"] for r in df.where("corrupt is not null").collect()) == sorted(BAD)
    lines = spark.read.text(str(tmp_path / "*.tsv"))
    assert sorted(map(tuple, files.parse_signals(lines).collect())) == sorted(good)


def test_broken_files_are_named(tmp_path, reader):
    (tmp_path / "latin.tsv").write_bytes(OK.replace("Yagi", "\xd6").encode("latin-1"))
    with pytest.raises(Exception, match="latin.tsv: not UTF-8"):
        reader(tmp_path).collect()
    with pytest.raises(Exception, match="nothing"):
        reader(tmp_path / "nothing").collect()
    (tmp_path / "slow").mkdir()
    (tmp_path / "slow" / "s.tsv").write_text(OK + "\n")
    with pytest.raises(Exception, match="s.tsv: longer than"):
        reader(tmp_path / "slow", timeout="-1").collect()


def test_stream_reads_each_file_once(spark, tmp_path, reader):
    (tmp_path / "in").mkdir()

    def run():
        q = spark.readStream.format("signal_records").load(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "1.tsv").write_text(OK.replace("Yagi", "one") + "\n")
    assert run() == ["one"]
    (tmp_path / "in" / "2.tsv").write_text(OK.replace("Yagi", "two") + "\n" + OK.replace("Yagi", "three") + "\n")
    assert run() == ["one", "three", "two"]
