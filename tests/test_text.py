import re
from collections import Counter
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from rankweave.functions import html, text, vectors
from rankweave.operators import lexical


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_words_keeps_letters_and_digits_of_any_script(spark):
    assert one(spark, text.words(F.lit("Don't Étre-là 42! 東京"))) == [
        "don", "t", "étre", "là", "42", "東京"]
    assert one(spark, text.ascii_words(F.lit("Étre BM25"))) == ["tre", "bm25"]
    assert one(spark, text.words(F.lit(None).cast("string"))) == []


def test_document_body_skips_empty_parts(spark):
    body = lambda *a: one(spark, text.document_body(*[F.lit(x).cast("string") for x in a]))
    assert body("T", "x") == "T\nx"
    assert body("", "x") == "x"
    assert body("T", "", "b") == "T\nb"
    assert body(None, None, None) == ""


def test_query_text_and_instruction(spark):
    assert one(spark, text.query_text(F.lit(""), F.lit("title"))) == "title"
    assert one(spark, text.query_text(F.lit(""))) is None
    wrapped = one(spark, text.query_instruction(F.lit("banana bread"), "do it"))
    assert wrapped == "Instruct: do it\nQuery: banana bread"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "aa", "z9", "b b"]), max_size=30),
                min_size=1, max_size=5))
def test_term_frequency_equals_counter(spark, docs):
    analyzed = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<string>")
    analyzed = analyzed.withColumn("len", F.size("tokens"))
    found = {(d, t): (n, size) for d, t, n, size in rows(lexical.term_frequency(analyzed))}
    expected = {(i, t): (n, len(doc)) for i, doc in enumerate(docs)
                for t, n in Counter(doc).items()}
    assert found == expected


def test_term_frequency_sorts_once(spark):
    docs = spark.createDataFrame([(1, "b a b")], "doc_id long, full_text string")
    plan = lexical.term_frequency(lexical.analyze(docs))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("sort_array") == 1
    assert physical.count("regexp_extract_all") <= 2  # tokens, and their number
    assert "Exchange" not in physical


class Visible(HTMLParser):
    """Visible text by Python's parser: blocks part words, other tags don't."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")
        self.handle_data(" " if tag in html.BLOCKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template")
        self.handle_data(" " if tag in html.BLOCKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@pytest.mark.parametrize("page", [
    "<p>ba<b>na</b>na &#8217; &eacute; &mdash; &#x27; &#X1F600; it&apos;s</p>",
    '<?xml version="1.0"?><!DOCTYPE html><!ELEMENT a><p>one</p><!-- <b>no</b> -->two',
    """<img alt="1>2">a<a title='x > y' href="?a=1&b=2">link</a> <i class=it's>c</i>""",
    "<div>a<template><p>hidden</p></template>b<script>if (a < b) '<p>'</script>c</div>d",
    "&amp;lt; &lt;b&gt; &copy; &copy2024 &notit; &unknown; &; & x &AMP &nbsp;| &#0; &#128; &#xD800;",
    "&#1114112; &#99999999999999; &#x; &NotEqualTilde; &frac12;&frac12 a&b &#65b",
    "<custom-tag a=1>x</custom-tag>y<p-x>z</p-x><br/>w<BR>v<td >u</td\n>t",
    "<ul><li>1<li>2</ul><h1 id = 'q'>h</h1>&lt;not a tag&gt;", "a < b and c > d", "",
])
def test_html_is_read_as_a_parser_reads_it(spark, page):
    parser = Visible()
    parser.feed(page)
    parser.close()
    want = re.sub(r"[\s\xa0]+", " ", "".join(parser.parts)).strip()
    assert one(spark, html.html_text(F.lit(page))) == want


def test_html(spark):
    page = ('<!DOCTYPE html><html><head><title> A &amp; B </title><style>p{}</style>'
            '<script>var t="</p>";</script></head><body><!-- no --><p>One<b>two</b></p>\n\n'
            '<a class="x" href="/to?a=1&amp;b=2#f">link &lt;1&gt;</a><a name="q">q</a></body>')
    assert one(spark, html.html_title(F.lit(page))) == "A & B"
    assert one(spark, html.html_title(F.lit("<title>  </title>"))) is None
    assert one(spark, html.html_title(F.lit("<p>x</p>"))) is None
    assert one(spark, html.html_text(F.lit(page))) == "A & B Onetwo link <1>q"
    assert one(spark, html.html_text(F.lit(page), compat=True)) == " A & B Onetwolink <1>q"
    assert one(spark, html.html_links(F.lit(page))) == ["/to?a=1&b=2"]
    assert one(spark, html.unescape(F.lit("&amp;lt;"))) == "&lt;"


def test_vectors(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vectors.l2_normalize(arr(3, 4))) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(arr(0, 0))) == [0.0, 0.0]
    assert one(spark, vectors.truncate_dims(arr(3, 4, 12), 2)) == [0.6, 0.8]
    assert one(spark, vectors.cosine(arr(1, 0), arr(0, 2))) == 0.0
    assert one(spark, vectors.cosine(arr(1, 0), arr(0, 0))) is None
    assert re.match("double", spark.range(1).select(vectors.norm(arr(1))).dtypes[0][1])


def test_plurals_by_rule_and_exception(spark):
    from rankweave.operators import lexical
    pairs = {"recipes": "recipe", "berries": "berry", "wolves": "wolf", "knives": "knife",
             "buses": "bus", "boxes": "box", "waltzes": "waltz", "churches": "church",
             "dishes": "dish", "women": "woman", "children": "child", "mice": "mouse"}
    alone = ["glass", "status", "basis", "was", "cities", "omen", "as", "s", "series"]
    # A singular of a rule must be a word too; one of the exceptions need not be.
    words = [*pairs, *pairs.values(), *alone, "statu", "basi", "glas", "a"]
    words.remove("mouse")
    vocabulary = spark.createDataFrame([(w,) for w in sorted(set(words))], "token string")
    assert dict(rows(lexical.noun_lexicon(vocabulary), "form", "lemma")) == pairs
    own = spark.createDataFrame([("women", "wife")], "form string, lemma string")
    assert dict(rows(lexical.noun_lexicon(vocabulary, own)))["women"] == "wife"
    docs = spark.createDataFrame([(1, "Banana recipes, one recipe")], "doc_id long, full_text string")
    positions = lexical.token_positions(lexical.analyze(docs))
    lexicon = lexical.noun_lexicon(positions.select("token").distinct())
    assert rows(lexical.lemmatize(positions, lexicon).groupBy("token").count().filter("count > 1")) \
        == [("recipe", 2)]
