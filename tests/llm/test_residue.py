"""Mails with residue and mails that only speak of it, and the mining against direct verdicts."""

import base64

import pytest

import wordings

from quillstream.llm import concepts as C
from quillstream.llm import mime
from quillstream.llm import residue as Z

CASES = [
    ("Invoice {{number}}", "Hello,\n\nplease see below.\n"),
    ("Hi", "Dear {{ first_name | default }},\n\nyour order is on its way.\n"),
    ("Hi", "Your statement for %%MONTH%% is ready, ${customer.name}.\n"),
    ("Hi", "Hello undefined,\n\nwe have your payment.\n"),
    ("Hi", "Guten Tag,\n\nIhre Rechnung [HIER NUMMER EINTRAGEN] ist am *|DATE|* fällig.\n"),
    ("[Branch City]: reminder", "Hello,\n\nplease see below.\n"),
    ("Invoice NaN", "Hello,\n\nplease see below.\n"),
    ("Hi", "Estimado/a [object Object]:\n\nsu factura vence hoy.\n"),
    ("Hi", "bla bla bla, here comes the real text later\n"),
    ("Hi", "Click to add text\n"),
    ("Hi", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.\n"),
    ("Hi", "asdf asdf qwer\njkl asdf asdf\n"),
    ("Hi", "xxxxxxxx xxxxxxxxxxxx\nxxxxx xxxxxx\n"),
    ("Hi", "TO BE COMPLETED\n"),
    ("Hi", "404 Not Found\nThe requested URL /a/b was not found on this\nserver.\n"),
    ("Hi", 'Traceback (most recent call last):\n  File "a.py", line 3, in f\nKeyError: \'x\'\n'),
    ("Hi", "*** Please enable JavaScript to\nview this message. ***\n"),
    ("Hi", "Veuillez activer JavaScript pour afficher ce contenu.\n"),
]
SPEECH = [
    ("Re: Invoice 12", "Hi Ann,\n\nI booked the invoice yesterday.\n"),
    ("[Depot] list", "Could you check the field `{{number}}` in column F of the template?\n"),
    ("Hi", "The portal gave a 404 twice this morning, Ann has restarted it.\n"),
    ("Hi", 'We got "503 Service Unavailable" from the bank\'s gateway at 14:20.\n'),
    ("Hi", "On the demo machine please enable JavaScript before the auditors come, I've put a note on the desk.\n"),
    ("Hi", "The designer still had lorem ipsum in the proof, so I sent it back.\n"),
    ("Hi", "See https://a.example/x%20y?q=%7Bid%7D and the sum of {1, 2, 3} at 50% of 30%.\n"),
    ("Hi", "Fine.\n\nOn Mon, 1 Jan 2024, Ann wrote:\n> Dear {{name}},\n> 404 Not Found\n"),
    ("Hi", "Fine.\n\n-----Original Message-----\nFrom: Ann\n\nPlease enable JavaScript to view this message.\n"),
    ("Undelivered mail", "Delivery to the following recipient failed permanently:\na@b.example\n550 5.1.1 mailbox unavailable\n"),
    ("[Note]: lists", "None of them came. The date is undefined so far.\n"),
    ("Hi", "[EXTERNAL] Take care with links.\n"),
]


def _mail(subject, body, how="8bit", kind="text/plain"):
    if how == "base64":
        body = base64.encodebytes(body.encode()).decode()
    return f'From: a@b.example\nSubject: {subject}\nMIME-Version: 1.0\nContent-Type: {kind}; charset="utf-8"\nContent-Transfer-Encoding: {how}\n\n{body}'


def _direct(text):
    """The kinds a mail shows by its words alone, and by what it says besides: each unit judged for itself."""
    rows = Z.mail_units(text)
    kinds = {u: C.candidate(u) for u, *_ in rows}
    others = (rows[0][3] if rows else 0) - sum({p: said for u, p, said, _ in rows if kinds[u]}.values())
    return {k for k in kinds.values() if k and (k in ("slot", "filler") or k != "void" and others < Z.AMID)}


@pytest.mark.parametrize("subject,body", CASES)
def test_cases(subject, body):
    assert _direct(_mail(subject, body)) and _direct(_mail(subject, body, "base64"))
    assert _direct(_mail(subject, body).replace("\n", "\r\n"))


@pytest.mark.parametrize("subject,body", SPEECH)
def test_speech(subject, body):
    assert not _direct(_mail(subject, body)) and not _direct(_mail(subject, body, "base64"))


@pytest.mark.parametrize(
    "line",
    [
        "Fatal error: Uncaught PDOException: could not find driver", "SQLSTATE[IM002] [unixODBC] ODBC driver not found", "IOException: I/O failure", "Error: bucket in eu-west-1 is gone", "Error: EU region is closed",
        "Service unavailable, please contact the service desk", "503 Service Unavailable, please register again", "Too many requests from your network today", "PHP Fatal error: Uncaught Error: I yesterday",
    ],
)
def test_words_of_program_output_are_no_speech(line):
    assert _direct(_mail("Hi", line + "\n")) == {"error"}


@pytest.mark.parametrize("line", ["Fehler 404, ich sehe ihn auch", "So I see: service unavailable, something went wrong, oops something went wrong", "Eu vi o erro interno do servidor", "Auf dem Rechner bitte JavaScript aktivieren, sonst klappt es am Montag nicht"])
def test_a_person_speaks(line):
    assert not _direct(_mail("Hi", line + "\n"))


@pytest.mark.parametrize("slot", ["[Insert a short summary of the outstanding balance and the date on which it is due here]", "{% if customer.balance > 0 and customer.country == 'DE' and customer.language == 'de' and due %}", "{{ customer.first_name | default: customer.company | default: customer.contact | capitalize | strip }}"])
def test_long_slots(slot):
    assert len(slot) > 84 and _direct(_mail("Hi", f"Dear all, {slot} is yours.\n")) == {"slot"}
    assert not _direct(_mail("Hi", "Elle a dit « " + "bonjour à tous " * 8 + "» hier soir.\n"))


@pytest.mark.parametrize("sign", ["{{ first_name }}", "[insert order total here]", "the requested URL", "please enable JavaScript", "Hello undefined"])
@pytest.mark.parametrize("before", range(56, 62))
def test_signs_over_the_cuts_of_long_sentences(sign, before):
    line = " ".join([*["the", "list", "of", "goods", "and"] * 12, "to"][:before] + [sign] + ["is", "in", "store"] * 25)
    assert _direct(_mail("Hi", line + "\n")) and not _direct(_mail("Hi", line.replace(sign, "ordinary") + "\n"))


@pytest.mark.parametrize("sign", ["{{first_name}}", "JavaScriptを有効"])
def test_signs_over_the_cuts_of_long_words(sign):
    for before in range(Z.WORD_LETTERS - len(sign) - 1, Z.WORD_LETTERS + 1):
        assert _direct(_mail("Hi", "文" * before + sign + "字" * 500 + "\n")), before


def test_cuts_are_no_ends_of_sentences():
    line = " ".join(["the", "list", "of", "goods", "and"] * 6 + ["error: x"] + ["is", "in", "store"] * 25)
    assert not _direct(_mail("Hi", line + "\n"))


def test_reading_parts():
    body = (
        "Subject: =?utf-8?B?w6k=?= =?utf-8?q?_x?=\nContent-Type: multipart/mixed; boundary=\"b\"\n\n--b\nContent-Type: multipart/alternative; boundary=c\n\n--c\nContent-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\none=20=C3=A9=\n two\n--c\n"
        "Content-Type: text/html\n\n<p>never &lt;x&gt;</p>\n--c--\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\n\n404 Not Found\n--b--\n"
    )
    assert mime.read(body) == ("é x", ["one é two", ""])
    page = "Subject: s\nContent-Type: text/html\n\n<style>x</style><p>Hello &lt;enter name&gt;,<br>bye</p><blockquote>Dear {{x}}</blockquote>"
    assert [x for x in mime.read(page)[1] if x.strip()] == ["Hello <enter name>,", "bye"]


@pytest.mark.parametrize("depth", [1, 9, 200])
def test_reading_nested_parts(depth):
    opened = "".join(f"Content-Type: multipart/mixed; boundary=b{n}\n\n--b{n}\n" for n in range(depth))
    assert "Dear {{name}}," in mime.read(f"Subject: s\n{opened}Content-Type: text/plain\n\nDear {{{{name}}}},\n" + "".join(f"--b{n}--\n" for n in reversed(range(depth))))[1]


@pytest.mark.parametrize("kind", ["multipart/mixed", 'multipart/alternative; boundary=""', "multipart/mixed; boundary=elsewhere"])
def test_reading_multiparts_without_boundary(kind):
    assert "Dear {{name}}," in mime.read(f"Subject: s\nContent-Type: {kind}\n\nDear {{{{name}}}},\n")[1]


@pytest.mark.parametrize("text", [None, "", " \n\t", "no headers at all", "Subject:", "\n\n\n", "Content-Type: multipart/mixed; boundary=\"x\"\n\n--x", "Content-Transfer-Encoding: base64\n\n!!!!"])
def test_reading_never_fails(text):
    subject, lines = mime.read(text)
    assert isinstance(subject, str) and isinstance(lines, list)


@pytest.fixture(scope="module")
def documents(spark):
    mails = [_mail(*c) for c in CASES + SPEECH]
    ordinary = [_mail("Week", f"Hi,\n\nthe list of {w} items for branch {n} is on page {n}. Please check voucher {n} before Friday.\n") for n in range(60) for w in ("price", "stock")]
    rows = list(enumerate([*mails, *ordinary, mails[0], None, "", " ", _mail("Hi", "word " * 60_000), _mail("Hi", "word " * 60_000 + "\n\nDear {{name}},")]))
    return spark.createDataFrame([(n, t, "clash") for n, t in rows], "doc_id long, text string, unit string")


def test_mining_equals_direct_verdicts(documents):
    got = {(r.doc_id, r.kind) for r in Z.residue(documents, "doc_id", "text").collect()}
    want = {(r.doc_id, v) for r in documents.collect() for v in _direct(r.text)}
    assert {i for i, _ in got} == {i for i, _ in want}
    assert got == want


def _mined(spark, documents, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        first, second = Z.templates(Z.unit_rows(documents.repartition(partitions), "doc_id", "text"))
        return {tuple(r) for r in first.collect()}, {tuple(r) for r in second.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_templates_do_not_depend_on_partitions(spark, documents):
    assert _mined(spark, documents, 1) == _mined(spark, documents, 7)


@pytest.mark.parametrize("salts", [1, 7])
def test_salted_leaves_give_the_same(documents, monkeypatch, salts):
    want = {tuple(r) for r in Z.residue(documents, "doc_id", "text").collect()}
    monkeypatch.setattr(Z, "SALTS", salts)
    assert {tuple(r) for r in Z.residue(documents, "doc_id", "text").collect()} == want


def test_wildcards_hide_nothing(spark):
    """Units that differ where the verdict lies share a template, and each is still judged for itself."""
    rows = [(n, _mail("Hi", f"Please {w} it all to see the page.\n")) for n, w in enumerate(["take", "give", "read", "enable javascript for", "send"])]
    rows += [(10 + n, _mail("Hi", f"Your text goes here{end}\n")) for n, end in enumerate([".", "", "!", "?"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in Z.residue(df, "doc_id", "text").collect()} == {i for i, t in rows if _direct(t)} >= {10, 11, 12, 13}


@pytest.mark.parametrize("salts", [1, 64])
def test_units_of_a_leaf_in_several_parts_are_judged(spark, monkeypatch, salts):
    """Words that decide a verdict never stand behind a wildcard, in whichever part they are mined."""
    rows = [(n, _mail("Hi", f"{t}\n")) for n, t in enumerate(["To be completed.", "To be confirmed.", "to be honest", "to be sure", "to be fair"])]
    monkeypatch.setattr(Z, "SALTS", salts)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in Z.residue(df, "doc_id", "text").collect()} == {i for i, t in rows if _direct(t)} == {0, 1}


TALK = "\n\nThe list of goods came on time. We booked it under the usual cost centre. Nothing else is open here.\n"


def test_a_template_that_stands_amid_talk_is_speech(spark):
    """The same sentence is a notice where its mails say nothing else, and speech where they do, even in the one short mail among them."""
    line = "Access to the page was denied for branch {}.\n"
    amid = [(n, _mail("Hi", line.format(n) + TALK)) for n in range(9)] + [(9, _mail("Hi", line.format(9)))]
    alone = [(n, _mail("Hi", line.format(n))) for n in range(9)] + [(9, _mail("Hi", line.format(9) + TALK))]
    found = [{r.doc_id for r in Z.residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()} for rows in (amid, alone)]
    assert _direct(amid[9][1]) == {"error"} and found == [set(), set(range(9))]


def test_a_void_counts_where_other_mails_leave_a_slot(spark):
    rows = [(0, _mail("Hi", "The goods for None leave on Friday.\n")), (1, _mail("Hi", "The goods for {{branch}} leave on Friday.\n")), (2, _mail("Hi", "The choice for None stays open so far.\n"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in Z.residue(df, "doc_id", "text").collect()} == {0, 1} and not _direct(rows[0][1])
    assert {r.doc_id for r in Z.residue(df.filter("doc_id <> 1"), "doc_id", "text").collect()} == set()


def test_signatures_and_rules_say_nothing():
    said = lambda body: Z.mail_units(_mail("Hi", body))[0][3]
    assert said("404 Not Found\n\n-- \nAnn Lee is the head of sales.\n") == said("404 Not Found\n\n*****\nThis mail is meant for its reader alone.\n") == 0
    assert said("We are closed for the whole week.\n\nRegards\nAnn") == 1


@pytest.mark.parametrize("half", [0, 1])
def test_wordings(half):
    """The second half was written down before the rules and wasn't looked at while they were made."""
    cases, found, wrong = 0, 0, 0
    for kind, line in wordings.half(half):
        case = kind not in ("speech", "ordinary")
        got = bool(_direct(_mail("Hi", line + "\n" + ("" if case else TALK))))
        cases, found, wrong = cases + case, found + (case and got), wrong + (not case and got)
    assert found >= 0.9 * cases and wrong <= 0.1 * found, (cases, found, wrong)


def test_a_leaf_of_many_templates_takes_linear_time():
    """A leaf whose units are all unlike one another: none is compared with all the others."""
    leaf = Z._Leaf()
    for n in range(20_000):
        leaf.place(f"the list {n}a {n}b {n}c {n}d {n}e {n}f", "")
    assert len(leaf.templates) == 20_000


def test_templates(documents):
    rows = Z.template_report(documents, "doc_id", "text").collect()
    assert any(Z.WILD in r.template and r.units > 1 for r in rows)
    assert {r.kind for r in rows} == {"ordinary", "slot", "filler", "error", "scripts"}


def test_empty(documents):
    assert Z.residue(documents.limit(0), "doc_id", "text").collect() == []
