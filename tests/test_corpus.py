import json
from datetime import datetime

import pytest

from mailframe.operators.report import run_report
from mailframe.plans.corpus_run import summarize_corpus
from mailframe.sources.corpus import parse_corpus, parse_mail, scan_corpus
from mailframe.sources.tables import write_records

BASIC = """From: Biblioteca São José <leitura@livros.example>
To: rita@casa.example
Subject: Horário de verão
Date: Thu, 8 Aug 2024 18:20:00 +0100
Message-Id: <horario.88@livros.example>
Content-Type: text/plain; charset=UTF-8

Caros leitores,

A sala fecha às 17 horas até ao fim de setembro.
"""
REPLY = """From: Oficina <bikes@oficina.example>
Subject: Re: Wheel
Date: Fri, 3 Oct 2025 07:05:00 +0200
Message-Id: <re.wheel.3@oficina.example>
Content-Type: text/plain; charset=UTF-8

The new rim is here.

Le 2 octobre 2025, Rita <rita@casa.example> a écrit :
> Hello,
>
> my front wheel has lost a spoke.

You can fetch it on Monday.

--
Oficina do Bairro
"""
ATTACHED = """From: =?utf-8?q?Jos=C3=A9_Ara=C3=BAjo?= <jose@musica.example>
Subject: =?utf-8?b?UGFydGl0dXJh?= =?utf-8?b?IG5vdmE=?=
Date: Sun, 9 Mar 2025 11:45:00 +0000
Message-Id: <score.41@musica.example>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="=-part-7Q"

--=-part-7Q
Content-Type: text/plain; charset=UTF-8

A partitura está anexa.

--=-part-7Q
Content-Type: application/pdf; name="score.pdf"
Content-Disposition: attachment; filename="score.pdf"
Content-Transfer-Encoding: base64

JVBERi0xLjQK

--=-part-7Q--
"""
HTML_ONLY = """From: undisclosed sender
Subject: folded
 subject
Date: not a date
Content-Type: text/html; charset=iso-8859-1
Content-Transfer-Encoding: quoted-printable

<style>p{}</style><p>caf=E9 &amp; th=E9</p><br>fin
"""


def parsed(spark, mails, limit=4000):
    rows = [(i, m if isinstance(m, bytes) else m.encode()) for i, m in enumerate(mails)]
    df = parse_mail(spark.createDataFrame(rows, "i long, raw binary"), "raw", limit)
    return sorted(df.collect(), key=lambda r: r.i)


def test_three_messages(spark):
    basic, reply, attached = parsed(spark, [BASIC, REPLY, ATTACHED])
    assert (basic.from_name, basic.from_addr) == ("Biblioteca São José", "leitura@livros.example")
    assert basic.subject == "Horário de verão"
    assert basic.message_id == "horario.88@livros.example"
    assert basic.sent_at == datetime(2024, 8, 8, 17, 20) and basic.sent_local == datetime(2024, 8, 8, 18, 20)
    assert "fecha às 17 horas" in basic.body_text
    assert not basic.has_attachment and not basic.truncated and basic.parse_error is None
    assert "new rim" in reply.body_text and "on Monday" in reply.body_text
    assert "spoke" not in reply.body_text and "Bairro" not in reply.body_text
    assert attached.has_attachment and attached.body_text == "A partitura está anexa."
    assert (attached.from_name, attached.subject) == ("José Araújo", "Partitura nova")


def test_limits(spark):
    for limit, cut in ((20, True), (10000, False), (0, False)):
        (got,) = parsed(spark, [BASIC], limit)
        assert got.truncated == cut and (not cut or len(got.body_text) == 20)


def test_fallbacks_and_failures(spark):
    html, crlf, broken, far = parsed(
        spark,
        [HTML_ONLY, BASIC.replace("\n", "\r\n"), b"", BASIC.replace("2024 18", "9990 18")],
    )
    assert html.body_text == "café & thé\n\nfin" or html.body_text == "café & thé\nfin"
    assert (html.from_addr, html.subject, html.message_id) == ("undisclosed sender", "folded subject", "")
    assert html.sent_at is None and html.sent_local is None
    assert crlf.body_text == parsed(spark, [BASIC])[0].body_text
    assert broken.parse_error and broken.message_id is None and broken.body_text == ""
    assert far.sent_local == datetime(9990, 8, 8, 18, 20)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "sub").mkdir()
    (root / "b.eml").write_text(BASIC)
    (root / "sub" / "A.EML").write_text(ATTACHED)
    (root / "note.TXT").write_text("\n  EXIGE > quoted stays\n> too\n\n")
    (root / "bad.eml").write_bytes(b"\n")
    (root / "skip.md").write_text("no")
    return root


def test_scan(spark, corpus):
    names = [r.path.rsplit("/", 1)[1] for r in scan_corpus(spark, str(corpus)).orderBy("path").collect()]
    assert sorted(names) == ["A.EML", "b.eml", "bad.eml", "note.TXT"]
    assert scan_corpus(spark, str(corpus / "b.eml")).count() == 1
    with pytest.raises(ValueError, match="must be .eml or .txt"):
        scan_corpus(spark, str(corpus / "skip.md"))


def test_text_files_are_taken_as_they_are(spark, corpus):
    (note,) = parse_corpus(scan_corpus(spark, str(corpus / "note.TXT"))).collect()
    assert note.body_text == "EXIGE > quoted stays\n> too"
    assert (note.from_display, note.subject) == ("(none)", "(none)")


def echo_client():
    def client(system, user, timeout):
        body = user.split("\n\n", 1)[1]
        return json.dumps({"summary": body[:190] + "!", "action_required": "fyi", "deadline": None,
                           "tone": "neutral"})
    return client


def test_records_and_report(spark, corpus, tmp_path):
    records = summarize_corpus(scan_corpus(spark, str(corpus)), echo_client, "fr")
    by_name = {r.path.rsplit("/", 1)[1]: r for r in records.collect()}
    assert by_name["note.TXT"].checks == ["affect-marker '!'", "ALL-CAPS run", "accusation verb"]
    assert by_name["b.eml"].checks == ["affect-marker '!'"] and by_name["b.eml"].status == "ok"
    assert by_name["bad.eml"].parse_error and by_name["bad.eml"].checks == []
    report = run_report(records).first()
    assert (report.total, report.ok, report.error, report.validation_warn) == (4, 3, 1, 3)
    assert report.mean_latency_ms == report.total_latency_ms // 4 and report.has_warnings
    none = run_report(records.limit(0)).first()
    assert (none.total, none.mean_latency_ms, none.has_warnings) == (0, 0, False)
    write_records(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
