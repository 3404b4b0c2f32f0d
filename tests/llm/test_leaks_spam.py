import random

from revsift.llm import leaks, spam
from revsift.llm.leaks import leaked_cases, words
from revsift.llm.spam import spam_pages

Q = "Which small routine keeps the ledger of 12 open orders and drops every stale session after 30 minutes?"
CASES = "query_id string, query_text string, target_entity_id string, target_entity_name string, file_path string, hash long"


def test_words():
    assert words("Ｆull_ｗidth so\u00adft ﬁne A1-b2") == ["full", "width", "soft", "fine", "a1", "b2"] and words("Straße") == words("STRASSE")


def test_leaks(spark, monkeypatch):
    cases = [("a", Q, "src/core.py::Ledger::drop_session", "drop", "src/core.py", 1), ("b", Q, "x", None, None, 1), ("s", "short but exact words", "y", None, None, 1), ("n", None, "z", None, None, 1), ("e", " ", "z", None, None, 1), ("a", Q, "src/core.py::Ledger::drop_session", "drop", "src/core.py", 1)]
    other = Q.replace("12", "77").replace("30", "45").replace("ledger", "core").replace("session", "ledger").replace("minutes", "hours")
    twelve = " ".join(Q.split()[3:15])
    docs = [
        (1, "Before. " + Q.upper() + " After.", 1), (2, twelve, 1), (3, " ".join(Q.split()[3:14]), 1), (4, "so short, but: EXACT-words!", 1), (5, other, 1), (6, None, 1), (7, "", 1), (8, Q.replace(" ", "\u200b "), 1),
        (9, "x " * 200_000 + twelve, 1), (None, Q, 1), (1, "Before. " + Q.upper() + " After.", 1), (10, twelve.replace("orders", "or\u00adders"), 1),
    ]

    def run():
        got = leaked_cases(spark.createDataFrame(docs, "doc_id long, text string, n int"), spark.createDataFrame(cases, CASES)).collect()
        return {(r["doc_id"], r["query_id"]): r["verbatim"] for r in got}

    got = run()
    assert {k for k, v in got.items() if v} == {(d, q) for d in (1, 2, 8, 9, 10) for q in "ab"} | {(4, "s")}
    assert {k for k, v in got.items() if not v} == {(5, "a"), (5, "b")}
    monkeypatch.setattr(leaks, "MOST_HASHES", 2)  # all windows are joined
    assert {k for k, v in run().items() if v} == {k for k, v in got.items() if v}
    assert leaked_cases(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], CASES)).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(6)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(150)]
    cases = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randrange(3, 20))), None, None, None, 0) for i in range(40)]
    windows = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {(d, q) for d, t in enumerate(texts) for q, c, *_ in cases if windows(t.split(), m := min(5, len(c.split()))) & windows(c.split(), m)}
    got = leaked_cases(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(cases, CASES), window=5).where("verbatim")
    assert {(r["doc_id"], r["query_id"]) for r in got.collect()} == want


def corpus():
    rng = random.Random(6)
    nouns = [f"{a}{b}" for a in ("led", "tok", "sha", "que", "bat", "mer") for b in ("ger", "en", "rd", "ry", "ch", "ge", "lot", "mix")]
    n = lambda: rng.choice(nouns)
    frames = [
        lambda: f"Please check whether your {n()} is ready before the {n()} starts.", lambda: f"The {n()} was left open because nobody looked at the {n()} again.",
        lambda: f"It took us a while to see that the {n()} depends on the {n()}.", lambda: f"In short, a {n()} keeps what the {n()} forgets.",
    ]
    article = lambda k: " ".join(rng.choice(frames)() for _ in range(k))
    good = [article(rng.randrange(4, 25)) for _ in range(300)]
    good += [article(12) + "\n\nSee also:\n" + "\n".join(f"- https://{n()}.example/{n()}/{i}" for i in range(3)) for _ in range(20)]
    good += ["\n".join(f"* [{n()} {n()}](https://{n()}.example/{i}) - {article(1)}" for i in range(12)) for _ in range(20)]
    good += ["\n".join(f"2023-01-{i + 1:02} 10:00:{i:02} WARN worker {n()} failed, retry {i}" for i in range(20)) for _ in range(10)]
    good += ["\n".join(f"def {n()}({n()}):\n    {n()} = {n()}({n()}, {n()})\n    return {n()}" for _ in range(8)) for _ in range(10)]
    bad = []
    for _ in range(15):
        keys = [f"{n()} {n()}" for _ in range(4)]

        def pick(k, sep):
            own = [f"{n()} {n()}" for _ in range(4)]
            return sep.join(rng.choice(own) for _ in range(k))

        bad += [pick(40, " "), pick(40, " | "), pick(40, "\n"), pick(60, ", "), "\n".join(f"https://{n()}.example/{n()}/{i}" for i in range(20))]
        bad += [article(1) + "\n\n" + "\n".join(f'<a href="https://{n()}.example/{i}">{n()} {n()}</a>' for i in range(20))]
        bad += ["\n".join(f"{keys[0].title()} SKU-{rng.randrange(99999):05} {n()}, {n()}, {n()} {rng.randrange(99)}.99" for _ in range(15)), " ".join(f"#{n()}{n()}" for _ in range(30))]
        bad += ["\n".join("Tags: " + ", ".join(n() for _ in range(9)) for _ in range(6))]
    return good, bad


def test_spam(spark):
    good, bad = corpus()
    texts = [*good, *bad, None, "", " ", "one two", "x\r\n\r\ny", "\x01\x02 odd", "word " * 100_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, good[0], 1)], "doc_id long, text string, words int")
    pages = {r["doc_id"]: r for r in spam_pages(df).collect()}
    hit = {i for i, r in pages.items() if r["is_spam"]}
    g, b = range(len(good)), range(len(good), len(good) + len(bad))
    assert len(hit & set(g)) <= 3 and len(hit & set(b)) >= 0.97 * len(bad)
    assert len(texts) - 1 in hit and not hit & {len(texts) - 4, len(texts) - 3, len(texts) - 2}
    # the same in many chunks
    assert {r["doc_id"]: tuple(r) for r in spam_pages(df, chunk_bytes=1500).collect()} == {i: tuple(r) for i, r in pages.items()}
    assert spam_pages(df.limit(0)).count() == 0


def test_spam_score_ignores_the_page_itself():
    c = spam._Codes()
    t = "red fox red fox red fox red fox red fox red fox red fox"
    words_, bad, *_ = spam.score([t], spam._Table(*[spam.np.zeros(0, int)] * 3), 1000, c)
    assert bad[0] == words_[0] == 14
