from cairn.llm import simhash


def test_id_of_two_texts(spark):
    a = " ".join(f"a{i}" for i in range(400))
    near, other = a + " a", " ".join(f"c{i}" for i in range(300))
    fp = {r.doc_id: r.fp for r in simhash.fingerprints(spark.createDataFrame([(0, a), (1, near), (2, other)], "doc_id long, text string")).collect()}
    assert bin((fp[0] ^ fp[1]) % (1 << 64)).count("1") <= 4 < bin((fp[0] ^ fp[2]) % (1 << 64)).count("1")
    docs = spark.createDataFrame([(3, a), (5, near), (5, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()) == [(3, a), (5, other)]
