import pytest

#: Columns whose names the operators use themselves; they have to be left alone.
EXTRA = ["lang", "size", "key", "label", "score", "shard", "n_tokens", "copies", "rank"]


@pytest.fixture
def documents(spark):
    """documents(rows): a table of (doc_id, text[, source]) with clashing extra columns, some of them null."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", *[None if k % 2 else "x" for k in range(len(EXTRA))]) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA))
    return make


@pytest.fixture
def folder(tmp_path):
    """folder(documents=df, ...): tables written as a data folder."""
    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write
