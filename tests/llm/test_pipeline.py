from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import secrets


def test_stages_match_brute_force(spark, docs, doc_rows):
    from test_dedup import brute_copies, brute_links

    df, texts = docs, {d: t for d, t, *_ in doc_rows}
    left = [r for r in doc_rows if r[1] and any(map(str.isalpha, r[1]))]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        if name == "packing":
            break
        assert df.columns == docs.columns
        df = df.cache()
        got = df.collect()
        if name == "exact_dedup":
            left = [r for r in {r[0]: r for r in left}.values() if r[0] in {k for _, k, *_ in brute_copies(left)}]
        elif name == "near_duplicates":
            keep = {c for c, _ in brute_links(left).values()}
            left = [r for r in left if r[0] in keep]
        assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in left)
        if name == "language":
            assert all(r["lang"] for r in got)
        if name == "secrets":
            changed = {r["doc_id"]: r for r in got if r["text"] != texts[r["doc_id"]]}
            assert set(changed) == {177} and secrets.MASK in changed[177]["text"] and changed[177]["n_chars"] == len(changed[177]["text"])
            masked = {r["doc_id"]: r["text"] for r in got}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in df.collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in masked.items()}


def test_documents_without_any_label_stay(spark, docs, doc_rows):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.identify_language(spark, unlabelled, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r[0] for r in doc_rows if r[1] and any(map(str.isalpha, r[1])))


def test_run_gives_what_the_stages_give_and_leaves_little(spark, tmp_path, docs):
    import os

    from emberlog.llm import common

    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    df = docs
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "").cache()
    count = common.tables_made()
    got = corpus_pipeline.run(spark, str(tmp_path))
    names = "doc_id", "piece", "start", "length", "ids_crc32"
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, df.select(*names).collect()))
    left = [p for p in common._MADE[count:] if os.path.isdir(p.removeprefix("file://").removeprefix("file:"))]
    assert len(left) == 2  # the packing stage's pieces, and the table that it reads


def test_an_empty_table_passes(spark, none):
    df = none
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.count() == 0


def test_columns_of_any_names_pass_all_stages(spark, docs, clashing):
    plain, other = docs, clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, other = stage(spark, plain, "").cache(), stage(spark, other, "").cache()
        assert other.columns == clashing.columns
        assert sorted(map(tuple, other.select(*docs.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str), name
        assert other.where(" or ".join(f"`{c}` <> 'x'" for c in clashing.columns if c not in docs.columns)).count() == 0
    pieces = [corpus_pipeline.pack(spark, df, "").select("doc_id", "piece", "length", "ids_crc32") for df in (plain, other)]
    assert sorted(map(tuple, pieces[0].collect())) == sorted(map(tuple, pieces[1].collect()))
