"""Plain text and declared language against the regular expressions that define them, and pages that would take those hours."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow.llm import langid, markup

HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
MARK = r"(?s)<[^>]*>|&[a-zA-Z#0-9]{1,10};"
LANGUAGE = [rf"(?i)<{mark}\s*[\"']?\s*([a-z]{{2,3}})\b" for mark in (r"html[^>]*\slang\s*=", r"html[^>]*\sxml:lang\s*=", r"meta\s[^>]*http-equiv\s*=\s*[\"']?content-language\b[^>]*\scontent\s*=", r"meta\s[^>]*\bcontent\s*=(?=[^>]*http-equiv\s*=\s*[\"']?content-language\b)")]
PARTS = ["<", ">", "<!--", "-->", "<script", "<script x>", "</script>", "</SCRIPT >", "<style>", "</style\n>", "</style", "<html", "<HTML", "<meta ", "<meta\n", " lang=", " xml:lang=", "\tlang = ", '"', "'", "en", "fr-CA", "deutsch", "  ", " content=", 'content="it"', " http-equiv=content-language", ' http-equiv = "Content-Language"', "&amp;", "&nbsp", "&#12;", "a", "text ", "\n", "=", "<p>", "é"]


def by_expressions(spark, pages):
    html = F.col("html")
    found = [F.regexp_extract(html, x, 1) for x in LANGUAGE]
    declared = F.lower(F.coalesce(*[F.when(x != "", x) for x in found], F.lit("")))
    rows = spark.createDataFrame(list(enumerate(pages)), "i long, html string").select("i", declared.alias("d"), F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), MARK, " ").alias("p")).collect()
    return [(r["d"], r["p"]) for r in sorted(rows)]


def test_pages(spark):
    rng = random.Random(1)
    pages = [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' where html is not null").fetchall()]
    pages += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(6_000)]
    for page, want in zip(pages, by_expressions(spark, pages)):
        assert (markup.declared(page), markup.plain(page)) == want, page


@pytest.mark.parametrize("part", ["<!--", "<script>", "<style x", "<script", "<", "<html ", "<meta content=", "<html lang=" + " " * 50, "</script ", "<!--x--", "&amp", "<meta http-equiv=content-language content= "])
def test_a_page_of_ten_million_characters(part):
    page = part * (10_000_000 // len(part))
    start = time.time()
    for x in (page, page + ">", "<script>" + page + "</script", page + "<html lang=de>"):
        markup.plain(x)
        markup.declared(x)
    assert time.time() - start < 60


def test_long_pages_in_a_job(spark):
    pages = ["<html lang=fr>" + "<!--" * 500_000 + "le chat", "<script>" * 300_000, None, "<html lang=en><script>var a</script>" + "<" * 1_000_000]
    rows = spark.createDataFrame([(i, None, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.page_evidence(rows).collect()}
    assert [got[i]["declared"] for i in range(4)] == ["fr", "", "", "en"] and got[0]["plain"].endswith("le chat") and got[2]["plain"] == ""


def test_labels_that_are_no_languages(spark):
    docs = spark.range(1_100).select(F.concat(F.lit("l"), "id").alias("lang"), F.lit("some text").alias("text"))
    with pytest.raises(ValueError, match="1024 labels"):
        langid.fit(docs)
