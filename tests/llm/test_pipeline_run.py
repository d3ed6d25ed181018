import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_run_decodes_as_the_library_does(spark):
    sf = "/root/testdata/sf0.001"
    known = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    assert got and len({r.doc_id for r in got}) == len(got) and {r.doc_id for r in got} <= known
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        text = library.decode(ids, skip_special_tokens=False)
        assert len(ids) == r.n_tokens and hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256
