"""Files are listed by tasks, folder by folder, with the results of Spark's own listing and hidden names."""
import os

from pyspark.sql import functions as F

from corpusflow.sources import corpus as C
from corpusflow.sources import listing as L


def test_many_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "FOLDERS_PER_TASK", 8)
    root = str(tmp_path / "小 说")
    for i in range(60):
        for j in range(i % 4):
            folder = f"{root}/a{i}/b {j}/c+d"
            os.makedirs(folder, exist_ok=True)
            for name in ("x.txt", f"y{j}.MD", "_draft.txt", ".dot", "_SUCCESS", ".x.txt.crc"):
                with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
                    f.write("文" * (j + 1))
    os.makedirs(f"{root}/_hidden/inner")
    os.makedirs(f"{root}/empty")
    open(f"{root}/_hidden/inner/never.txt", "w").close()
    with open(f"{root}/top.txt", "w") as f:
        f.write("top")
    got, plain = L.list_files(spark, root), C._listed_by_readers(spark, root)
    rows = lambda df: sorted(map(repr, df.select("path", "size", F.col("modified").cast("long"), "hidden").collect()))
    assert rows(got) == rows(plain) and got.count() == 4 * 90 + 1
    one = L.list_files(spark, f"{root}/top.txt").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.size, r.hidden) for r in one] == [("top.txt", 3, False)]
    assert L.list_files(spark, f"{root}/a*") is None and L.list_files(spark, f"{root}/empty").count() == 0
    assert C.list_corpus(spark, f"{root}/a1", "x*").filter("matched").count() == 1
    open(f"{root}/a1/zero.txt", "w").close()           # Spark's readers don't list a file without a byte
    told = {r.file_path.rsplit("/", 1)[-1]: (r.status, r.rows) for r in C.corpus_files(spark, f"{root}/a1").collect()}
    assert told == {"zero.txt": ("empty", 0), "x.txt": ("read", 1), "y0.MD": ("read", 1), "_draft.txt": ("hidden name", None), ".dot": ("hidden name", None)}
