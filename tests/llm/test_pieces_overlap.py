from revsift.llm.pieces import oversized_sources


def test_overlap_over_short_steps(spark):
    text = "v = 1\n" * 299 + "\n" + "x=1;" + "a" * 5000
    df = spark.createDataFrame([("c", "e", 1, text)], "commit_hash string, entity_id string, ingested_at int, source_code string")
    pieces = [r["piece"] for r in oversized_sources(df).orderBy("piece_no").collect()]
    whole = pieces[0]
    for p in pieces[1:]:
        assert len(p) <= 2000 and p[:200] == whole[-200:]
        whole += p[200:]
    assert whole == text
