from veridant.plans import registry


def test_names_of_any_number_of_words_are_found(spark, tmp_path):
    names = [("Barbex Networks Inc.", "BXN"), ("Orvane", "ORV"), ("Talin-Moor Freight & Rail Co", "TMF"), ("Plain Name", "PLN"), ("...", "NIL"), (None, "NUL")]
    spark.createDataFrame(names, "company_name string, ticker string").write.parquet(f"{tmp_path}/global_object_locator.parquet")
    docs = [(1, "At BARBEX Networks, Inc. and Orvane"), (2, "Orvane said Talin-Moor Freight & Rail Co. won"), (3, "Barbex Networks"), (4, "a plain name"), (5, None), (6, "")]
    spark.createDataFrame(docs, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.ticker: r.documents for r in registry.queries()["company_mentions"](spark, str(tmp_path)).collect()}
    assert got == {"BXN": 1, "ORV": 2, "TMF": 1, "PLN": 1}
