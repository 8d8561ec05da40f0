"""Links and ideographs: expected rows written by hand."""

import math

from courierlens.operators import text

PAGE = """<html><head><link href="http://css.example/a.css"></head><body>
<A class="b" HREF='https://pay.example/verify'>  www.bank.example <b>log
in</b></A> <article><a name=x>no link</a>
<a href="http://10.0.0.1:8080/x"></a><a href="http://10.0.0.1:8080/x">again</a><a href="/relative">r</a><a href="https://google.com/login">Google.com</a>
<img SRC="https://img.example/p.png"><a href="http://256.1.1.1/x">open
"""


def test_links_of_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, '<a href="http://a.example"'), (5, "<a href='http://shop.example/my-Account'>x < y</a>")], "page_id long, html string")
    found = [tuple(r) for r in text.anchored_links(pages).orderBy("page_id", "n").collect()]
    assert found == [
        (1, 0, "https://pay.example/verify", "www.bank.example log in", True, True), (1, 1, "http://10.0.0.1:8080/x", "again", True, False), (1, 2, "https://google.com/login", "Google.com", False, False),
        (1, 3, "http://256.1.1.1/x", None, False, False), (1, 4, "http://css.example/a.css", None, False, False), (1, 5, "https://img.example/p.png", None, False, False),
        (4, 0, "http://a.example", None, False, False), (5, 0, "http://shop.example/my-Account", "x", True, False),
    ]


def test_ideographs(spark):
    normal = "尊敬的客户，您好！感谢您对我们公司的支持。本月账单已经生成，请查收。如有疑问请联系客服。"
    rare = "㐀㐁㐂㐃㐄㐅㐆㐇㐈㐉" * 2 + "𠀀" * 4
    rows = [(1, normal), (2, rare), (3, "的" * 60), (4, "的一" * 4), (5, "hello"), (6, None), (7, "".join(chr(0x4E00 + i) for i in range(300)))]
    found = {r.doc_id: r for r in text.script_mix(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].score == 0 and found[1].rare == 0 and found[1].n_ideographs == 38
    counts = [2] * 10 + [4]
    bits = -sum(c / 24 * math.log2(c / 24) for c in counts)
    assert found[2].n_ideographs == 24 and found[2].rare == 1 and abs(found[2].entropy - bits) < 1e-9 and abs(found[2].score - (0.4 + 0.3 * (4 - bits) / 4)) < 1e-9
    assert found[3].entropy == 0 and abs(found[3].unique_pairs - 1 / 59) < 1e-9 and abs(found[3].score - 0.3) < 1e-9  # one sign only: no entropy to judge, but the same pair throughout
    assert found[4].n_ideographs == 8 and found[4].entropy == 1 and found[4].score == 0
    assert found[5].n == 5 and found[5].entropy == 0 == found[5].score and found[6].n == 0
    assert found[7].unique_pairs == 1 and abs(found[7].score - 0.3 * (1 + (math.log2(300) - 7.5) / 3 * (math.log2(300) - 7.5 > 0.3))) < 1e-6
