from tarnholm.catalog import Database
from tarnholm.streaming.ingest import ingest


def test_files_are_loaded_once_and_restarts_go_on(spark, tmp_path):
    db = Database.create(spark, str(tmp_path / "db"))
    db.create_table("create table t (k int, s string)")
    files = tmp_path / "in"
    files.mkdir()
    (files / "1.csv").write_text("1,a\n2,NULL\n")
    ingest(db, "t", str(files)).awaitTermination()
    (files / "2.csv").write_text("3,\n")
    ingest(db, "t", str(files)).awaitTermination()
    ingest(db, "t", str(files)).awaitTermination()
    assert sorted(map(tuple, db.df("t").collect())) == [(1, "a"), (2, None), (3, None)]
