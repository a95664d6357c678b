import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sylvan.llm import langid, packing, quality
from test_ngram_join import brute as brute_components

SF = "/root/testdata/sf0.001"
LONG = "a long text of many words " * 40_000


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, over real documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = [tuple(r) for r in docs.collect()]
    rows += [
        (None, rows[0][1], "en", "s", 3), (900_001, None, "en", "s", None), (900_002, "", None, None, 0), (900_003, " \n\t ", "xx", "s", 4),
        (900_004, rows[1][1], None, None, None), (900_004, rows[1][1], None, None, None), (900_005, rows[1][1].replace(" ", "  "), "en", "s", 1),
        (900_006, LONG, "en", "src0", len(LONG)), (900_007, LONG + "end", "en", "src0", len(LONG) + 3), rows[2], rows[2],
    ]
    extra = ", ".join(f"{c} {t}" for c, t in docs.dtypes) + ", _own string, Text_sha256 string, rk bigint"
    return spark.createDataFrame([(*r, "o", "s", 1) for r in rows], extra)


def exact(rows):
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
    least = {}
    for r in rows:
        own = least.setdefault(norm(r), r[0])
        least[norm(r)] = min((x for x in (own, r[0]) if x is not None), default=None)
    return collections.Counter(r for r in rows if least[norm(r)] == r[0])


STAGES = dict(corpus_pipeline.STAGES)


def test_quality_rules_and_language_id_take_effect(spark):
    docs = odd_rows(spark)
    out = STAGES["quality_rules"](spark, docs, SF)
    assert out.columns == docs.columns
    verdicts = collections.Counter((r.doc_id, r.lang, r.source) for r in quality.quality_verdicts(docs).where("kept").collect())
    kept = rows_of(out)
    assert collections.Counter((r[0], r[2], r[3]) for r in kept.elements()) == verdicts and not kept - rows_of(docs)
    out = STAGES["language_id"](spark, docs, SF)
    model = langid.train(docs.where(langid._fold() != 1))
    rows = [tuple(r) for r in docs.collect()]
    names, scores = model.predict([r[1] for r in rows])
    want = collections.Counter(r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= langid.LEAST)
    assert out.columns == docs.columns and rows_of(out) == want and 100 < sum(want.values()) < len(rows)


def test_exact_dedup_takes_effect(spark):
    docs = odd_rows(spark)
    out = STAGES["exact_dedup"](spark, docs, SF)
    assert out.columns == docs.columns and rows_of(out) == exact([tuple(r) for r in docs.collect()])


def test_near_duplicates_take_effect(spark):
    docs = odd_rows(spark)
    out = STAGES["near_duplicates"](spark, docs, SF)
    rows, kept = [tuple(r) for r in docs.collect()], rows_of(out)
    components = [c for _, n, c in brute_components([r[:2] for r in rows]) if n]
    assert out.columns == docs.columns and not kept - rows_of(docs)
    empty = [r for r in rows if not (r[1] or "").split()]
    assert {r[0] for r in kept} == {c for c in components} | {r[0] for r in empty}
    assert all(kept[r] == 1 for r in empty)
    assert all(m == collections.Counter(rows)[r] for r, m in kept.items())


def test_packing_of_odd_rows(spark):
    docs = odd_rows(spark)
    out = STAGES["best_fit_packing"](spark, docs, SF).toPandas()
    own, want = packing.WordIds(packing.vocabulary_path()), []
    for r in docs.collect():
        ids = own.encode(r.text or "") + (1).to_bytes(4, "little")
        for k in range(0, len(ids), 16384):
            want.append((-1 if r.doc_id is None else r.doc_id, k // 16384, len(ids[k : k + 16384]) // 4, zlib.crc32(ids[k : k + 16384])))
    got = out[["doc_id", "piece", "length", "ids_crc32"]].fillna(-1).astype(int)
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)
    assert out.groupby("sequence_id").length.sum().max() <= 4096
    for _, rows in out.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1].tolist()]


@pytest.mark.parametrize("name", list(STAGES))
def test_an_empty_table_gives_no_rows(spark, name):
    assert STAGES[name](spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).collect() == []


def test_run_is_the_stages_in_turn(spark):
    """The rows of run() against each stage's brute force where it has one, on whole tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in STAGES["language_id"](spark, corpus_pipeline.materialize(STAGES["quality_rules"](spark, docs, SF)), SF).collect()]
    left = list(exact(rows).elements())
    ids = {c for _, n, c in brute_components([r[:2] for r in left])}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == ids and 100 < len(ids) < docs.count()
    pieces = packing.pieces(docs, packing.vocabulary_path()).toPandas()
    pieces = pieces[pieces.doc_id.isin(ids)]
    digest = lambda df: hashlib.sha256(df[["doc_id", "piece", "ids_crc32"]].sort_values(["doc_id", "piece"]).to_numpy().tobytes()).hexdigest()
    assert digest(out) == digest(pieces)
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 2
    assert corpus_pipeline.ORACLE_SQL is None and list(STAGES) == ["quality_rules", "language_id", "exact_dedup", "near_duplicates", "best_fit_packing"]
