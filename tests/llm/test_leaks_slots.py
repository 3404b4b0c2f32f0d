import pytest

from revsift.llm import leaks
from revsift.llm.queries import p8_leaks

LONG = "How does the function load_config in our service retry after 7 seconds when the remote answer is missing"
SHORT = "Where does Parser check that the input ends"


@pytest.mark.parametrize("most", [leaks.MOST_NAMES, 2])
def test_slots_of_other_words_and_numbers(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(leaks, "MOST_NAMES", most)  # each text with its own names beyond
    docs = [
        (1, "x " + LONG.replace("load_config", "parse_settings_file").replace("7", "3.14")),
        (2, "so: " + SHORT.replace("Parser", "Lexer") + " or not"),
        (3, "so: " + SHORT.replace("Parser", "Lexer").replace("check", "forget") + " or not"),
        (4, LONG.lower()),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cases = [("long", LONG, "a.py::load_config", "load_config", "a.py"), ("short", SHORT, None, None, None)]
    spark.createDataFrame(cases, "query_id string, query_text string, target_entity_id string, target_entity_name string, file_path string").write.parquet(f"{tmp_path}/query_cases.parquet")
    got = {(r["doc_id"], r["query_id"]): r["verbatim"] for r in p8_leaks(spark, str(tmp_path)).collect()}
    assert got == {(1, "long"): False, (2, "short"): False, (4, "long"): True}
