"""The pipeline's stages take effect, and the queries of the subpackage are registered."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")


def test_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {0: docs.count()}
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixture", "token_output"]
    for k, (name, stage) in enumerate(P.STAGES):
        before, docs = docs, P.materialize(stage(spark, docs, SF), f"test-{name}")
        if name != "token_output":
            assert docs.columns == columns
        kept[k + 1] = docs.count()
        if name in ("quality_rules", "near_duplicates", "decontamination"):
            assert docs.exceptAll(before).count() == 0 and kept[k + 1] < kept[k]
    assert kept[5] == kept[4] == P.run(spark, SF).count()


def test_stages_of_nothing(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op1_mixing", "op3_decontamination", "op9_secrets", "op10_substrings", "op11_collocations", "op12_merkle"])
def test_agrees_with_sql(spark, name):
    import duckdb

    from chronoloom.llm import registry

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert got[columns].sort_values(columns, ignore_index=True).equals(want[columns].sort_values(columns, ignore_index=True))


def test_rollup_query_counts_like_the_tokenizers(spark):
    """op8 against the tokenizers on whole texts, and against op4's files."""
    import base64
    from collections import Counter

    import public_tokenizers as T
    import tiktoken
    from tokenizers import Tokenizer

    from chronoloom.llm import registry

    one = Tokenizer.from_file(T.path("byte_bpe_50k.json"))
    with open(T.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    two = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    counts = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r["text"] or ""
        a, b = len(one.encode(text, add_special_tokens=False).ids), len(two.encode_ordinary(text))
        counts[r["doc_id"]] = a
        if r["lang"] != "de":
            want[r["source"], r["lang"], "byte-bpe", "docs"] += 1
            want[r["source"], r["lang"], "byte-bpe", "tokens"] += b if r["source"] == "src0" else a
        want[r["source"], r["lang"], "byte-bpe-multi", "docs"] += 1
        want[r["source"], r["lang"], "byte-bpe-multi", "tokens"] += b
    got = {}
    for r in registry.op8_token_rollup(spark, SF).collect():
        key = r["source"], r["lang"], r["tokenizer_version"]
        got |= {(*key, "docs"): r["n_docs"], (*key, "tokens"): r["n_tokens"]}
    assert got == {k: v for k, v in want.items() if v}
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in registry.op4_token_files(spark, SF).collect()} == counts
