"""The corpus pipeline against a plain version of each of its stages, on its own input."""

import re

import corpus_pipeline
import public_tokenizers
import sentencepiece

from barloom.llm import toxicity
from tests.llm.test_operators import low, near_brute, windows


def test_pipeline(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "pieces"]

    reader = toxicity.Reader(model)
    rows = {i: t for i, t in rows.items() if model.score(reader.read(t or "")) < 0.7}
    last = {}
    for i, t in sorted(rows.items()):
        last[low(t)] = i
    rows = {i: t for i, t in rows.items() if last[low(t)] == i}
    keep = {i for i, _, _, kept in near_brute(rows.items(), 5, 80) if kept}
    rows = {i: t for i, t in rows.items() if i in keep}
    bad = set().union(*[windows(r.text)[1] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()])
    sizes = {len(w) for w in bad}

    def clean(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        return not any(tuple(w[p : p + n]) in bad for n in sizes for p in range(len(w) - n + 1))

    rows = {i: t for i, t in rows.items() if clean(t)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {i: library.encode(t) for i, t in rows.items()}
