"""The raw stand-in files are written by methods the JVM compiles."""

from flowsieve.plans import queries


class Rows:
    """Stands for a table; ``write.csv`` tells the limit under which it runs."""

    columns = ["a", " Source IP"]

    def __init__(self, spark, told):
        self.spark, self.told = spark, told
        self.filter = self.select = lambda *_: self
        self.write = self

    def csv(self, path, **options):
        self.told.append(self.spark.conf.get("spark.sql.codegen.hugeMethodLimit"))


def test_raw_files_are_written_in_small_methods(spark, sf_dir, monkeypatch):
    told = []
    for name in ("unsw_raw", "cic_raw"):
        monkeypatch.setattr(queries.standins, name, lambda *_: Rows(spark, told))
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    queries._write_unsw(spark, sf_dir)
    queries._write_cic(spark, sf_dir)
    assert told == ["8000"] * 3 and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before
