import pytest

from quillspark.llm.sentences import Splitter, corpus_abbreviations, document_abbreviations, split_sentences
from tests.conftest import rows

CASES = {
    "en": ["Mr. Lasi met A. K. Tebom at 10 a.m. on Nov. 8, 2020.", "It was settled for $570.334 bn.", "In 2022 No. 693 stood at 1.5%, vs. US$3 in Q2."],
    "quote": ['"Is it final?" asked one holder.', 'The memo ends with "price held... for now."', '"We signed late. We signed anyway," Gen. Dage told holders.'],
    "inner capital": ["It is a routine step at best.", "iVeta, the bidder, raised its price."],
    "de": ["Laut § 601 Abs. 5 S. 8 haftet die Susox AG bis 2011.", "Die Anleger erhielten Post, Zinsen usw.", "Im 4. Quartal, am 20. Mai, zahlte die Firma Lefer & Co. KG ca. 5 Mio. Euro.", "„Wir warten nicht. Wir handeln“, sagte sie."],
    "fr": ["M. Teramex cite p. ex. l'art. 48 av. le 6 juin 2010.", "Le rapport cite Kakeva et Cie.", "Le conseil a-t-il voté\xa0?", "« Nous avons signé. Nous tiendrons », dit-il."],
    "es": ["El Dr. Kusotam cita la pág. 625 en EE. UU. del informe.", "¿Cuándo pagarán?", "¡Nadie lo esperaba!"],
}
CJK = ["营业收入增长30.88%，达到317.2亿元。", "“价格合理。我们会尽快完成交割。”海丰公司的发言人说。", "市场有传言称雅诚集团将退出……但公司予以否认。", "股价收于72.74元，成交量很低……", "公司的代表问：“何时付款？”", "驚いた株主も多い！", "「反対だ。」と瑞博基金は答えた。"]


def cut(text):
    return [text[a:b] for a, b in Splitter().split(text)]


@pytest.mark.parametrize("key", CASES)
def test_spaced_scripts(key):
    assert cut(" ".join(CASES[key])) == CASES[key]


def test_scripts_without_spaces():
    assert cut("".join(CJK)) == CJK
    assert cut("ผู้สอบบัญชีไม่มีข้อสังเกต บริษัท Tebom ลงนามแล้ว แผนนี้มีสมาชิก 744 คน") == ["ผู้สอบบัญชีไม่มีข้อสังเกต", "บริษัท Tebom ลงนามแล้ว", "แผนนี้มีสมาชิก 744 คน"]
    assert cut("कं. सं. 391 का नाम बदला गया। बाज़ार में चर्चा थी... पर Sevaner ने इनकार किया।") == ["कं. सं. 391 का नाम बदला गया।", "बाज़ार में चर्चा थी... पर Sevaner ने इनकार किया।"]
    assert cut("تولى د. Lusuvan الرئاسة. متى يتم الدفع؟") == ["تولى د. Lusuvan الرئاسة.", "متى يتم الدفع؟"]


def test_lines_and_headings():
    assert cut("Background of the Merger\n\nIt closed\nlate. Next\n\n \n\nEnd") == ["Background of the Merger", "It closed\nlate.", "Next", "End"]
    assert cut("the asset sale.Gen. Dage holds 5 shares.") == ["the asset sale.", "Gen. Dage holds 5 shares."]


def test_document_evidence():
    assert document_abbreviations("the fgn. rate, one fgn. price") == {"fgn"}
    assert document_abbreviations("the term. rate, one term. price, a term here") == set()
    assert cut("Buy the fgn. rate or the fgn. price now. Done.") == ["Buy the fgn. rate or the fgn. price now.", "Done."]


def test_names_after_abbreviations():
    doc = ["The fgn. rate and the fgn. price rose.", "We told Smith today.", "It was fgn. Smith who left.", "It was fgn.", "Then we left, and then slept."]
    assert cut(" ".join(doc)) == doc
    doc = ["Bonds of the U.S. Treasury rose.", "We told Treasury staff.", "The U.S. Treasury sold.", "It is based in the U.S. Lebulal Corp. moved, said Lebulal."]
    assert cut(" ".join(doc)) == doc[:3] + ["It is based in the U.S.", "Lebulal Corp. moved, said Lebulal."]
    assert cut("We met J.R. Smith here. We told Smith today.") == ["We met J.R. Smith here.", "We told Smith today."]


def test_abbreviations_by_evidence():
    doc = ["The Cmdr. said no.", "Later the Cmdr. was seen.", "Then Cmdr. Smith came."]
    assert cut(" ".join(doc)) == doc
    doc = ["The Cmdr. said no.", "Later the Cmdr. was seen.", "We met the Cmdr.", "Seeing him was rare, and seeing her, too.", "We met the Cmdr.", "The end."]
    assert cut(" ".join(doc)) == doc


def test_thai_gaps_and_quotations():
    text = "บริษัท ลงนามแล้ว \"แผน นี้ มี\" สมาชิก"
    assert "\"แผน นี้ มี\"" in cut(text)[-2] + cut(text)[-1]


def test_corpus_names():
    text = "We told Smith of the qtl. Smith rate. It was the qtl. The end, the last."
    assert [text[a:b] for a, b in Splitter(frozenset({"qtl"})).split(text)] == ["We told Smith of the qtl. Smith rate.", "It was the qtl.", "The end, the last."]


def test_corpus_fallback(spark):
    docs = spark.createDataFrame([(i, f"See the qtl. rate of day {i}. Then we left the room. Later.") for i in range(9)], "doc_id bigint, text string")
    assert corpus_abbreviations(docs) == ["qtl"]


def test_tables(spark):
    long = "One two three. " * 20_000
    docs = spark.createDataFrame([(1, "A b. C d.", 5), (1, "A b. C d.", 5), (2, None, 5), (3, "  \n\n ", 5), (4, "", 5), (5, long, 5), (6, "no stop", 5)], "doc_id bigint, text string, sent_start int")
    got = split_sentences(docs)
    assert rows(got.where("doc_id in (1, 6)")) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (6, 0, 7)]
    assert got.where("doc_id = 5").count() == 20_000
    assert got.where("doc_id in (2, 3, 4)").count() == 0
    assert rows(split_sentences(docs.limit(0))) == []


def test_all_text_is_covered(spark, data):
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        at = 0
        for a, b in Splitter().split(r["text"]):
            assert not r["text"][at:a].strip() and a < b and not r["text"][a].isspace() and not r["text"][b - 1].isspace()
            at = b
        assert not (r["text"] or "")[at:].strip()
