from collections import Counter
from pathlib import Path

from dagwright.llm import common, components, near_dedup

SMALL = {"bands", "buckets", "pairs", "sets", "edges", "texts", "classes"}


def test_small_tables_are_few_files_whatever_the_shuffle_partitions(spark, monkeypatch):
    """Each file starts a process of an executor's size, which is how check_h came to twice the memory."""
    for m in (components, near_dedup):
        monkeypatch.setattr(m, "drop", lambda *tables: None)
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(60)) + f" end{i}") for i in range(80)], "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    top = Path(common.tables_dir(spark).removeprefix("file:"))
    old = set(top.glob("*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 24)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i // 2 * 2 for i in range(80)}
    files = Counter()
    for t in set(top.glob("*")) - old:
        name = t.name.rsplit("-", 1)[0]
        files[name] = max(files[name], len(list(t.glob("part-*"))))
    assert files.keys() >= SMALL
    assert {k: n for k, n in files.items() if k in SMALL and n > 1} == {}
