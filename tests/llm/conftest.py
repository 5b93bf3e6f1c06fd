import pytest


@pytest.fixture()
def documents(spark, tmp_path):
    """Writes tables to a folder, as the queries read them."""

    def write(rows, name="documents", schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
