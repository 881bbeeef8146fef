from pagebundle.sources.sinks import write_children


def test_all_parts_of_a_document_are_written_once(spark, tmp_path):
    path = str(tmp_path / "children")
    schema = "bundle_id long, document_index int, part int, comment string"
    rows = [(1, 1, p, f"pages of part {p}") for p in range(3)] + [(1, 2, 0, "short")]
    batch = spark.createDataFrame(rows, schema)
    write_children(batch, 0, path)
    write_children(batch, 0, path)  # replayed
    later = spark.createDataFrame([(1, 1, 3, "pages of part 3")], schema)
    write_children(batch.union(later), 1, path)  # one new part only
    got = sorted((r["bundle_id"], r["document_index"], r["part"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 2, 0)]


def test_batches_without_parts_stay_known(spark, tmp_path):
    path = str(tmp_path / "children")
    write_children(spark.createDataFrame([(1, 1)], "bundle_id long, document_index int"), 0, path)
    write_children(spark.createDataFrame([(1, 1, 0)], "bundle_id long, document_index int, part int"), 1, path)
    assert spark.read.schema("bundle_id long, document_index int").parquet(path).count() == 1
