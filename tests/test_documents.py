"""Entities and visible text of HTML pages."""

import html

from pyspark.sql import functions as F

from emberkeep.operators import documents as D

TEXTS = [
    "plain", "a &amp; b &lt;c&gt;", "caf&eacute; &#8217;tis &#x2019; &apos;x&apos;", "&amp;lt; once", "&unknown; &; & alone &amp", "&#128512;&#x1F600;", "&#0; &#xD800; &#99999999;",
    "&#150; &#8364; &euro;", "&NotEqualTilde; &hearts;", "", None, "&copy;&middot;&quot;&#39;",
]


def test_entities_match_the_standard_library(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r.x for r in df.select(D.decode_entities(F.col("t")).alias("x")).collect()]
    for text, found in zip(TEXTS, got):
        if text is None:
            assert found is None
        elif text != "&unknown; &; & alone &amp":
            assert found == html.unescape(text).replace("\xa0", " ")
        else:
            assert found == text


def test_blanks_and_tags(spark):
    page = "<title>x</title><p>A&nbsp;B &eacute;</p><script>1 &amp; 2</script><p>C<br>D</p>"
    df = spark.createDataFrame([(1, 1, page)], "doc_id int, page_no int, html string")
    assert D.document_text(df).first().text == "A B é\nC\nD"
