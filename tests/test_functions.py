import html
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronry.functions import scores as S
from heronry.functions import text as T


def value(spark, column, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_uuid5_and_hash(spark):
    rows = [(f"käse-{i}",) for i in range(50)]
    got = spark.createDataFrame(rows, ["n"]).select("n", T.uuid5("n").alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["n"])) for r in got)


def test_wikitext(spark):
    clean = lambda x: value(spark, T.clean_wikitext("t"), t=x)
    assert clean("{{a|{{b}}}}'''Bold''' [[X|y]] [[Z]]<ref>r</ref>") == "Bold y Z"
    assert clean("a<ref name=x/> kept <ref>gone</ref> end") == "a end"  # a self-closed reference eats up to the next end
    assert clean("== Head ==\ntext") == "Head\n\ntext"
    assert clean("[http://a.b c d] http://e.f &amp;lt; &#65;&#x42;") == "c d  &lt; AB".replace("  ", " ")
    assert value(spark, T.clean_wikitext(F.lit(None).cast("string"))) == ""


def test_unescape(spark):
    for x in ("&copy;&nbsp;&quot;x&quot;", "&amp;amp;", "&bogus; &", "&#233;&#x1F600;", "no entity", "&copy 2024", "caf&eacute", "a &amp b", "&#65", "&#150;", "&#x80;", "&notit; &notin;", "&#0; &#xD800; &#99999999;", "&#13;x&#1;y", "&NotEqualTilde;&;&#;&#x;"):
        assert value(spark, T.unescape("t"), t=x) == html.unescape(x), x


def test_headings(spark):
    head = lambda x: (lambda h: h and (h["level"], h["text"]))(value(spark, T.heading(F.col("t")), t=x))
    assert head("## A b ") == (2, "A b")
    assert head("=== C ===") == (3, "C")
    assert head("====") == (2, "")
    assert head("\u3000## wide\u2003") == (2, "wide") and head("\x1c= x =") == (1, "x")
    assert head("#none") is None and head("") is None and head("# comment") == (1, "comment")


def test_titles_and_rows(spark):
    assert value(spark, T.pretty_title("t"), t="it's_a2b-x.y") == "It'S A2B X.Y"
    assert value(spark, T.time_span("a", "b"), a=65, b=3600) == "[01:05 – 60:00]"
    assert value(spark, T.embed_text("b", "t", "x"), b="", t="NOT FOUND", x="y") == "y"
    assert value(spark, T.embed_text("b", "t", "x"), b="c", t="t", x="y") == "c\n\ny"


def test_scores(spark):
    assert value(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == 1 / 2**0.5
    assert value(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert value(spark, S.reciprocal_rank_fusion(F.lit(1), F.lit(1), F.lit(9), F.lit(9))) <= 1 / 61 + 1e-12
    assert [value(spark, S.band(F.lit(x))) for x in (0.7, 0.5, 0.49)] == ["green", "yellow", "red"]
    assert value(spark, S.title_matches(F.lit(""), F.array(F.lit("x")))) is True


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=32), st.sampled_from([0.5, 0.95]))
def test_index_percentile(spark, values, q):
    want = sorted(values)[min(int(len(values) * q), len(values) - 1)]
    assert value(spark, S.index_percentile(F.col("v"), q), v=values) == want
