from __future__ import annotations

import pytest

from kbspark.sources import schemas


@pytest.mark.parametrize("table", sorted(schemas.TABLES))
def test_empty_frame_conforms(spark, table):
    df = schemas.conform(spark.range(1).select(), table)
    assert df.schema.names == schemas.schema(table).names
    assert [f.dataType for f in df.schema.fields] == [f.dataType for f in schemas.schema(table).fields]
    row = df.first()
    assert all(row[k] == v for k, v in schemas.DEFAULTS.get(table, {}).items())


def test_chunk_leftovers_go_to_metadata(spark):
    df = spark.createDataFrame([("c", "x", 3, None)], "chunk_id string, uploader string, pages int, note string")
    assert schemas.conform(df, "chunks").first()["metadata"] == {"uploader": "x", "pages": "3"}
