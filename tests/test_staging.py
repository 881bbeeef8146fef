import glob
import os

import pytest

from pagebundle import SplitConfig
from pagebundle.plans.split import split_bundles
from pagebundle.sources import adapters as ad
from pagebundle.staging import checkpoint_root, stage, staging_scope


def tables(spark):
    root = checkpoint_root(spark).removeprefix("file:")
    return set(glob.glob(os.path.join(root, spark.sparkContext.applicationId, "*")))


def test_scope_deletes_its_own_tables_only(spark, tmp_path):
    outside = stage(spark.range(3), "outside")
    before = tables(spark)
    with staging_scope(spark):
        kept = stage(spark.range(5), "outer")
        with staging_scope(spark):
            stage(kept, "inner").write.parquet(str(tmp_path / "result"))
        assert kept.count() == 5 and len(tables(spark)) == len(before) + 1
    assert tables(spark) == before and outside.count() == 3
    assert spark.read.parquet(str(tmp_path / "result")).count() == 5
    with pytest.raises(ValueError), staging_scope(spark):
        stage(spark.range(1), "failing")
        raise ValueError
    assert tables(spark) == before


def test_a_split_leaves_nothing_behind(spark, tmp_path):
    before = tables(spark)
    with staging_scope(spark):
        pages = ad.document_pages(spark, "/root/testdata/sf0.001")
        split = split_bundles(pages, ad.trial_dictionary(spark), SplitConfig()).staged()
        split.documents.write.parquet(str(tmp_path / "documents"))
        assert len(tables(spark)) > len(before)
    assert tables(spark) == before
    assert spark.read.parquet(str(tmp_path / "documents")).count() > 0
