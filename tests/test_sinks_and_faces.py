import numpy as np
import pytest

from netfusion.operators import evaluation, faces
from netfusion.sources import sinks


def test_vectors_and_search(spark, tmp_path):
    rng = np.random.default_rng(0)
    contents = [bytes(rng.integers(0, 40 + 20 * i, 500 + i, dtype=np.uint8)) for i in range(6)]
    for i, c in enumerate(contents):
        (tmp_path / f"{i}.jpg").write_bytes(c)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.jpg"))
    index = faces.index_files(files)
    one = index.where("id LIKE '%/3.jpg'")
    best = faces.search(index, one, 3).collect()
    assert best[0].id.endswith("/3.jpg") and best[0].similarity_score >= 95 and len(best) == 3
    assert abs(np.linalg.norm(faces.content_vector(contents[0])) - 1) < 1e-3 and not faces.content_vector(b"").any()


def test_graph_and_logs(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, x int"), spark.createDataFrame([("a", "b")] * 2, "src string, dst string")
    for case in ("c1", "c2", "c1"):
        sinks.write_graph(nodes, edges, str(tmp_path / "g"), case)
    n, e = sinks.read_graph(spark, str(tmp_path / "g"), "c1")
    assert n.count() == 2 and e.count() == 2 and n.columns == ["id", "x"]
    q = spark.createDataFrame([(3, "f.csv", "Missing day", 0.3)], "row_no int, source_file string, reason string, confidence double")
    sinks.write_quarantine(q, str(tmp_path / "q"))
    assert spark.read.csv(str(tmp_path / "q"), header=True).columns == q.columns
    assert sinks.template("firs").strip() == "fir_id,date,day,station,location,ipc_sections,narrative" and set(sinks.catalogue()) >= {"cdrs"}
    with sinks.exclusive(str(tmp_path / "lock")), pytest.raises(FileExistsError), sinks.exclusive(str(tmp_path / "lock")):
        pass
    with sinks.exclusive(str(tmp_path / "lock")):
        pass


def test_evaluation(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    status = lambda df: tuple(df.first())[1:]
    assert status(evaluation.recovered("b", ids("a", "b"), ids("a", "x"))) == (1, 2, "PARTIAL")
    assert status(evaluation.recovered("b", ids("a"), ids("a")))[2] == "PASS" and status(evaluation.recovered("b", ids("a"), ids("x")))[2] == "FAIL"
    days = spark.createDataFrame([(57,), (70,)], "day int")
    assert status(evaluation.event_coverage("e", days, (58, 61))) == (1, 2, "PARTIAL")
    assert evaluation.flag_hygiene("flag", a=ids("a"), b=ids("a").withColumnRenamed("id", "flag")).first().status == "FAIL"
    assert tuple(evaluation.precision_recall(ids("a", "b", "c"), ids("a", "d")).first()) == (0.333333, 0.5)


def test_tasks_do_not_grow_with_small_files(spark, tmp_path):
    for k in range(600):
        (tmp_path / f"{k}.bin").write_bytes(bytes([k % 256]) * 10)
    files = faces.scan_files(spark, str(tmp_path), "*.bin")
    assert files.count() == 600 and files.rdd.getNumPartitions() <= 8
