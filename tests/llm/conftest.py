import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _th string, _salt string, shard string, _own string, _sha string"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with working columns."""

    def make(pairs, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", "y", "z", "o", "s") for i, t in pairs], DOCS)

    return make
