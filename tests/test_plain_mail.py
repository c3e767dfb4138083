"""Native reading of single-part mail against the MIME reader, form by form and at random."""

import base64
import quopri
import random

from mailframe.functions.plain_mail import with_plain_parts
from mailframe.schemas import MAIL_PARTS
from mailframe.sources.corpus import parse_mail, read_mail


def mail(headers, body="Hello.\n", end="\n"):
    head = "".join(f"{name}: {value}{end}" for name, value in headers.items())
    return (head + end).encode() + (body if isinstance(body, bytes) else body.encode())


BASE = {
    "From": "Marta Vale <marta@garden.example>", "Subject": "Seeds", "Date": "Sat, 1 Mar 2025 06:07:08 +0100",
    "Message-Id": "<seeds.1@garden.example>", "Content-Type": "text/plain; charset=utf-8",
}
PLAIN = [
    mail(BASE), mail(BASE, "é\r\nü\r\n", "\r\n"), mail(BASE, ""), mail({"Subject": "only"}, "x"), mail({"X-A": "b"}, "\n\n"),
    mail(BASE | {"Content-Type": "TEXT/HTML; charset=\"UTF-8\""}, "<p>é</p>"),
    mail(BASE | {"Content-Transfer-Encoding": "base64"}, base64.encodebytes("Gruß\r\naus Köln".encode() * 9)),
    mail(BASE | {"Content-Transfer-Encoding": "Base64"}, b""),
    mail(BASE | {"Content-Transfer-Encoding": "quoted-printable"}, quopri.encodestring("süß = 5 \n lang ".encode() * 30)),
    mail(BASE | {"Content-Transfer-Encoding": "quoted-printable", "Content-Type": "text/plain; charset=iso-8859-1"}, "caf=E9=\r\n!\n"),
    mail(BASE | {"Content-Transfer-Encoding": "base64", "Content-Type": "text/plain; charset=ISO-8859-1"}, base64.b64encode("Ãé\x00".encode("latin-1"))),
    mail(BASE | {"Content-Type": "text/plain; charset=us-ascii; format=flowed"}),
    mail(BASE | {"From": "\"Vale, Marta\" <marta@garden.example>"}), mail(BASE | {"From": "m.v@garden.example "}),
    mail(BASE | {"From": "J. P. Ümlaut <j@garden.example>"}), mail(BASE | {"From": ""}), mail(BASE | {"From": "<j@garden.example>"}),
    mail(BASE | {"From": "=?utf-8?q?Jos=C3=A9_V?= <j@garden.example>"}), mail(BASE | {"From": "\"\" <j@garden.example>"}),
    mail(BASE | {"Subject": "=?UTF-8?B?w6k=?= =?utf-8?q?_x_=3D?= and\r\n =?utf-8?q?more?= = ?"}),
    mail(BASE | {"Subject": "  folded\n\tlines \n  of it  "}), mail(BASE | {"SUBJECT": "\n first on the next line"}),
    mail(BASE | {"Date": "1 Mar 2025 06:07 -0330"}), mail(BASE | {"Date": "Tue, 30 Feb 2025 06:07:08 +0000"}),
    mail(BASE | {"Date": "Mon, 29 Feb 2044 23:59:59 -0000"}),
    mail(BASE) .replace(b"Subject", b"subject: first\nSubject"),
    b"Subject: x\n\n" + "y é \n".encode() * 5000,
]
OTHER = [
    None, b"", b"\n", b"no header\n\nx", mail(BASE | {"Content-Type": "multipart/mixed; boundary=a"}, "--a\n\nx\n--a--\n"),
    mail(BASE | {"Content-Type": "text/plain; charset=utf-8; name=\"a.txt\""}), mail(BASE | {"Content-Disposition": "inline"}),
    mail(BASE | {"Content-Type": "text/plain; charset=koi8-r"}, b"\xc1"), mail(BASE, b"\xff"),
    mail(BASE | {"Date": "Sat, 1 Mar 2025 06:07:08 EST"}), mail(BASE | {"Date": "soon"}),
    mail(BASE | {"From": "a@b.example, c@d.example"}), mail(BASE | {"From": "Team: a@b.example;"}), mail(BASE | {"From": "nobody"}),
    mail(BASE | {"Subject": "=?koi8-r?b?wQ==?="}), mail(BASE | {"Subject": "=?utf-8?b?w6?="}), mail(BASE | {"Subject": "=?utf-8?q?=FF?="}),
    mail(BASE | {"Content-Transfer-Encoding": "quoted-printable"}, "a = b"),
    mail(BASE | {"Content-Transfer-Encoding": "base64"}, "abc"), mail(BASE | {"Content-Transfer-Encoding": "x-uuencode"}),
    b"From me\nSubject: x\n\ny", b"Subject: x\rFrom: y\n\nz", mail(BASE | {"Content-Type": "application/pdf"}),
    mail(BASE | {"Content-Type": "text/plain; charset=us-ascii", "Content-Transfer-Encoding": "quoted-printable"}, "=C3=A9"),
]


def native(spark, mails):
    df = spark.createDataFrame([(i, m and bytearray(m)) for i, m in enumerate(mails)], "n long, raw binary")
    rows = {r.n: r for r in with_plain_parts(df, "raw").select("n", "_plain", "_parts.*").collect()}
    return [rows[i].asDict() for i in range(len(mails))]


def reader(raw):
    return {c: read_mail(raw)[c] for c in MAIL_PARTS.names}


def test_plain_forms_equal_the_mime_reader(spark):
    for raw, got in zip(PLAIN, native(spark, PLAIN), strict=True):
        assert got["_plain"], raw[:300]
        assert {c: got[c] for c in MAIL_PARTS.names} == reader(raw), raw[:300]


def test_other_forms_are_left_to_the_mime_reader(spark):
    for raw, got in zip(OTHER, native(spark, OTHER), strict=True):
        assert got["_plain"] is False, raw


def test_random_mail_equals_the_mime_reader(spark):
    rng = random.Random(11)
    pieces = ["a", "b c", "é", " ", "\t", "=", "=?utf-8?q?", "?=", "=3D", "=\n", "\r\n", "\n", "\"", "<", ">", "@", ",", ";", "x@y.z", "(c)",
              "=?utf-8?b?w6k=?=", ":", "\n ", "+0100", "2 Jan 2024 03:04:05 +0100", "text/plain", "charset=utf-8", "base64", "YQ==", "\\", "."]
    names = ["From", "Subject", "Date", "Message-Id", "Content-Type", "Content-Transfer-Encoding", "X-Y", "from", "MIME-Version"]
    mails = []
    for _ in range(1500):
        lines = [f"{rng.choice(names)}: " + "".join(rng.choices(pieces, k=rng.randint(0, 5))).replace("\r", "") for _ in range(rng.randint(1, 4))]
        base = dict(rng.sample(sorted(BASE.items()), rng.randint(0, 5)))
        mails.append(("\n".join(lines) + "\n").encode() + mail(base, "".join(rng.choices(pieces, k=rng.randint(0, 9)))))
    found = native(spark, mails)
    plain = [(raw, got) for raw, got in zip(mails, found, strict=True) if got["_plain"]]
    assert len(plain) > 150
    for raw, got in plain:
        assert {c: got[c] for c in MAIL_PARTS.names} == reader(raw), raw


def test_plain_mail_does_not_reach_python(spark, tmp_path):
    mails = [m for m in PLAIN + OTHER if m is not None]
    df = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(mails)], "n long, raw binary")


    class Stop(Exception):
        pass

    import mailframe.sources.corpus as corpus

    real = corpus._read_batches

    def watched(column):
        inner = real(column)

        def run(batches):
            def seen():
                for batch in batches:
                    with open(tmp_path / "opened", "a") as file:
                        file.writelines(f"{n}\n" for n in batch["n"])
                    yield batch
            yield from inner(seen())

        return run

    corpus._read_batches = watched
    try:
        rows = parse_mail(df).collect()
    finally:
        corpus._read_batches = real
    opened = sorted(int(x) for x in (tmp_path / "opened").read_text().split())
    assert len(rows) == len(mails)
    assert opened == list(range(len(PLAIN), len(mails)))
