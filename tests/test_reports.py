"""Report documents."""

import json

from quorumlens.operators import reports


def test_json_keeps_nulls(spark):
    text = spark.createDataFrame([("a", None)], "k string, v string").select(reports.as_json("k", "v").alias("j")).first()["j"]
    assert json.loads(text) == {"k": "a", "v": None} and "\n  " in text


def test_html_is_escaped_and_ordered(spark, tmp_path):
    df = spark.createDataFrame([("x", "b", 1.5), ("x", "<a> & \"b\"", None)], "platform string, account string, rate double")
    tables = reports.html_tables(df)
    html = tables.first()["html"]
    assert html == '<table><tr><th>account</th><th>rate</th></tr><tr><td>&lt;a&gt; &amp; &quot;b&quot;</td><td></td></tr><tr><td>b</td><td>1.5</td></tr></table>'
    for _ in range(2):
        reports.write_reports(tables, "html", str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == [html]
