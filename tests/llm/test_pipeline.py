import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from test_decontaminate import brute as brute_hits
from test_simhash import brute_components, brute_fingerprint
from test_text_models import BAD, toxic_corpus
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import mixing, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Toxic rows, copies, near copies, benchmark passages, odd rows."""
    rng = random.Random(9)
    rows, labels = toxic_corpus(400, 4)
    items = [(i, " ".join(rng.choice("pqrstuv") * rng.randrange(1, 4) for _ in range(30))) for i in range(5)]
    base = [" ".join("".join(rng.choice("ijklmno") for _ in range(4)) for _ in range(200)) for _ in range(20)]
    rows += [(1000 + i, t) for i, t in enumerate(base)]
    rows += [(1100 + i, t.upper() if i % 2 else t) for i, t in enumerate(base)]
    rows += [(1200 + i, base[0]) for i in range(30)]
    rows += [(1300 + i, f"{rng.choice(rows[1:90])[1]} {items[i % 5][1][:60 + i]} the end") for i in range(10)]
    rows += [(1400, None), (1401, ""), (1402, " ".join(f"long{i % 977} tail{i % 13}" for i in range(8000))), (None, "a text without an id " * 3), (1000, base[0])]
    docs = [(i, t, "en", "hot" if n % 3 else f"s{n % 7}", len(t or ""), "x") for n, (i, t) in enumerate(rows)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_against_brute_force(spark, tables, tmp_path):
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = docs.columns
    before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == names
        after = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        if name == "toxicity":
            assert Counter(after) == Counter(x for x in before if not set((x[1] or "").split()) & set(BAD))
        elif name == "simhash_near_dedup":
            root = brute_components({(i is None, i or 0, t or ""): brute_fingerprint(t) for i, t, _ in before})
            groups = Counter(root[i is None, i or 0, t or ""] for i, t, _ in before)
            kept = [root[i is None, i or 0, t or ""] for i, t, _ in after]
            assert sorted(kept) == sorted(groups)
            assert all((i is None, i or 0, t or "") == root[i is None, i or 0, t or ""] for i, t, _ in after)
        elif name == "decontamination":
            assert Counter(after) == Counter(x for x in before if not brute_hits(x[1], items)[4])
        else:
            mixed = mixing.mix(spark.createDataFrame(before, "doc_id long, text string, source string")).collect()
            expected = Counter({r.doc_id: round(r.taken / r.size) for r in mixed if r.size and round(r.taken / r.size)})
            assert Counter(i for i, _, _ in after) == expected
        before = after
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect(), key=lambda r: r.start)
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t, _ in before]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _, _), x in zip(before, ids, strict=True))
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]


def test_run_equals_its_stages(spark, tables):
    found = corpus_pipeline.run(spark, tables)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() > 0


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, name):
    found = registry.queries()[name](spark, SF).toPandas()
    with duckdb.connect() as c:
        for t in ("documents", "benchmark", "conversations"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        expected = c.execute(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    rows = lambda d: sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert rows(found) == rows(expected)
