import hashlib
import math
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from tekstra.llm import bpe, mixing, pii, quality_rules

from .test_mixing import plain
from .test_near_dedup import brute


def test_rows_equal_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [r for r in docs if quality_rules.measure(r["text"].encode(), r["lang"])[6]]
    component = {d: c for d, _, c in brute([(r["doc_id"], r["text"]) for r in docs], 5)}
    docs = [r for r in docs if component[r["doc_id"]] == r["doc_id"]]
    for r in docs:
        r["text"] = pii.redacted_text(r["text"], pii.scanned(pii.trained(), [r["text"]])[0][1])
    chars = defaultdict(int)
    for r in docs:
        chars[r["source"]] += len(r["text"])
    total, masses = sum(chars.values()), sum(c**mixing.TEMPERATURE for c in chars.values())
    rate = {s: total * c**mixing.TEMPERATURE / masses / c for s, c in chars.items()}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r in docs:
        want[r["doc_id"], tuple(encoding.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()] += plain(r["doc_id"], rate[r["source"]])
    want = +want
    found = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in found) == want and len(found) > 300
    assert math.isclose(len(found) / len(docs), 1, abs_tol=0.3) and all(r.n_tokens == len(r.ids) for r in found)


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert out.count() <= docs.count() * 20
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
