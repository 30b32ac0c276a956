import hashlib
import random
import tempfile

import public_tokenizers
import tiktoken

import corpus_pipeline
from deckloom.llm.bpe import read_ranks

from .test_decontaminate import brute as contaminated
from .test_line_dedup import brute as without_lines
from .test_quality import sample
from .test_simhash import plain_components, plain_fingerprint


def test_like_brute_force(spark):
    rng = random.Random(9)
    docs = [(i, t + ("\nMenu and more" if k % 3 == 0 else ""), "en", f"site{k % 14}", 0) for k, (i, t, *_) in enumerate(sample(rng, 300))]
    docs += [(5000 + i, t, lang, "copy", n) for i, t, lang, _, n in docs[1:60:6]]
    docs += [(9000, None, "en", None, 0), (9001, "", "fr", "site1", 0), (9002, "x", None, "site2", 1)]
    items = [(k, " ".join(docs[7 + 10 * k][1].split()[3:33])) for k in range(4)]
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")

    table = spark.read.parquet(f"{where}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, table, where).collect()}
    assert {9000, 9001, 9002} <= kept and 200 < len(kept) < len(docs)
    rows = [r for r in docs if r[0] in kept]
    texts = {i: t for i, t, *_ in without_lines([(r[0], r[1], r[3]) for r in rows], 10)}
    assert any("Menu and more" in (r[1] or "") for r in rows) and not any("Menu and more" in (t or "") for t in texts.values())
    stay = {c for _, _, c in plain_components([(i, plain_fingerprint(t or "")) for i, t in texts.items()])}
    clean = [i for i, *_, bad in contaminated([(i, texts[i]) for i in stay], items) if not bad]
    assert len(clean) < len(stay) < len(texts)
    with open(corpus_pipeline.RANKS, "rb") as f:
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    want = {(i, tuple(plain.encode_ordinary(texts[i] or "")), hashlib.sha256((texts[i] or "").encode()).hexdigest()) for i in clean}
    got = corpus_pipeline.run(spark, where).collect()
    assert {(r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got} == want and len(got) == len(want)
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).schema == docs.schema
    assert corpus_pipeline.STAGES[-1][1](spark, docs, where).count() == 0
