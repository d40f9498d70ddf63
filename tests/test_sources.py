from pyspark.sql import functions as F

from sitetide.schemas import LANDED, TABLES, conform, empty_table
from sitetide.sources.tables import body_limit, read_responses, read_state


def test_state_round_trip(spark, tmp_path):
    for name in TABLES:
        empty_table(spark, name).write.parquet(f"{tmp_path}/{name}")
    state = read_state(spark, str(tmp_path))
    assert set(state) == set(TABLES)
    for name, df in state.items():
        assert [f.name for f in df.schema] == [f.name for f in TABLES[name].fields] and df.count() == 0


def test_responses_from_json_and_text(spark, tmp_path):
    rows = spark.createDataFrame([("https://e.com/", 200, "abc")], "url string, status int, body string")
    rows.write.json(f"{tmp_path}/json")
    landed = read_responses(spark, f"{tmp_path}/json", "json")
    assert landed.columns == LANDED["responses"].fieldNames() and landed.first()["body"] == "abc"
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "sitemap.xml").write_text("<urlset>\n</urlset>")
    text = read_responses(spark, f"{tmp_path}/text", "text").first()
    assert text["body"] == "<urlset>\n</urlset>" and text["url"].endswith("sitemap.xml")


def test_body_limit(spark):
    rows = spark.createDataFrame(
        [("12345", "99", None), ("1234é", "x", None), ("12", None, None), ("12345678", None, "boom")],
        "body string, content_length string, error string")
    out = body_limit(rows, 5).collect()
    over = "Response exceeds 5 bytes"
    assert [(r["error"], r["body"]) for r in out] == [(over, None), (over, None), (None, "12"), ("boom", None)]


def test_conform_fills_and_orders(spark):
    df = conform(spark.range(1).select(F.lit("p").alias("page_id"), F.lit("x").alias("extra")), "page_review")
    assert df.columns == TABLES["page_review"].fieldNames() and df.first()["notes"] is None
