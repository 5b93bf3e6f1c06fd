import email.message
import mailbox as std_mailbox

from pyspark.sql import functions as F

from siftwell.functions import patterns as P
from siftwell.operators import clean
from siftwell.sources import chat, labelled, mailbox, tagged

EXPORT = (
    "before the first header\n"
    "[1.2.2020, 3:04:05] A: x: y\n"
    "[1.2.2020, 3:04:06] has no name\n"
    "‏[2.2.2020, 13:04:05] Bo Z: שלום\n\nעולם\n\n\nסוף\n"
    f"[2.2.2020, 13:04:09] C: {P.SYSTEM_PHRASES[9]}\n"
    "[3.2.2020, 1:1:1] D: latin only\n"
)


def test_chat_export(spark, tmp_path):
    path = tmp_path / "chat.txt"
    path.write_text(EXPORT, encoding="utf-8")
    rows = chat.read_chat(spark, str(path)).orderBy("msg_no").collect()
    assert [(r.msg_no, r.sender, r.body) for r in rows] == [
        (0, "A", "x: y\n[1.2.2020, 3:04:06] has no name"),
        (1, "Bo Z", "שלום\n\nעולם\n\n\nסוף"),
        (2, "C", P.SYSTEM_PHRASES[9]),
        (3, "D", "latin only"),
    ]
    assert str(rows[0].sent_at) == "2020-02-01 03:04:05"
    whole = spark.read.text(str(path), wholetext=True).select(F.lit("p").alias("path"), F.col("value").alias("text"))
    same = chat.parse_whole_exports(whole).orderBy("msg_no").collect()
    assert [(r.msg_no, r.sender, r.body) for r in same] == [(r.msg_no, r.sender, r.body) for r in rows]


def test_first_stage(spark, tmp_path):
    path = tmp_path / "chat.txt"
    path.write_text(EXPORT, encoding="utf-8")
    rows = chat.first_stage(chat.read_chat_lines(spark, str(path))).orderBy("msg_no", "part_no").collect()
    assert [(r.msg_no, r.body) for r in rows] == [(1, "שלום"), (1, "עולם\n\n\nסוף")]


def test_huge_export_is_read_in_splits(spark, tmp_path):
    path = tmp_path / "chat.txt"
    path.write_text("".join(f"[1.1.2021, 1:1:1] S{i}: m{i}\nline {i}\n\n" for i in range(3000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = chat.read_chat_lines(spark, str(path))
        assert lines.select("block").distinct().count() > 5
        rows = chat.messages_from_lines(lines).orderBy("msg_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # only the blank line at the very end of the file is no line
    assert [(r.msg_no, r.sender, r.body.rstrip("\n")) for r in rows] == [(i, f"S{i}", f"m{i}\nline {i}") for i in range(3000)]


def test_mailbox(spark, tmp_path):
    box = std_mailbox.mbox(str(tmp_path / "in.mbox"))

    def add(subject, parts):
        m = email.message.EmailMessage()
        m["subject"] = subject
        m.set_content(parts[0][1], subtype=parts[0][0])
        for kind, text in parts[1:]:
            m.add_alternative(text, subtype=kind)
        box.add(m)

    add("שלום", [("plain", "one %42\n"), ("html", "<b>x</b>"), ("plain", "two %42\n")])
    add("plain %41", [("plain", "body\nFromage stays\n")])
    add("no text", [("html", "<b>x</b>")])
    box.flush()
    path = str(tmp_path / "in.mbox")
    with open(path, "ab") as file:  # 8-bit mail, with and without a header that says so
        for head, body in ((b"Content-Transfer-Encoding: 8bit\n", "שלום עולם".encode()), (b"", "naïve".encode()), (b"", "naïve".encode("latin-1"))):
            file.write(b"From me Thu Jan  1 00:00:00 2024\nSubject: raw" + str(len(body)).encode() + b"\n" + head + b"\n" + body + b"\n\n")
    parsed = mailbox.parse_mails(mailbox.read_mbox(spark, path), from_line=True)
    good = {r.subject: r.body.strip() for r in mailbox.mail_messages(parsed).collect()}
    assert good == {
        "שלום": "שלום MAILSUBJECTENDVAR  two B",
        "plain A": "plain A MAILSUBJECTENDVAR  body\nFromage stays",
        "raw17": "raw17 MAILSUBJECTENDVAR  שלום עולם",
        "raw6": "raw6 MAILSUBJECTENDVAR  naïve",
    }
    assert sorted(r.error for r in mailbox.mail_rejects(parsed).collect()) == ["UnicodeDecodeError", "no plain text"]


def test_ids_do_not_depend_on_splits(spark, tmp_path):
    for name in ("spam", "non_spam"):
        (tmp_path / "sms").mkdir(exist_ok=True)
        (tmp_path / "sms" / f"{name}.txt").write_text("\n".join(f"{name} line {i}" for i in range(2000)))
    found = []
    for size in ("128m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found.append({(r.msg_id, r.label, r.text) for r in labelled.read_labelled(spark, str(tmp_path / "sms" / "*.txt")).collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len({i for i, _, _ in found[0]}) == 4000


def test_labelled_text_and_sink(spark, tmp_path):
    for name, text in {"spam": " a \n\n \nb\n", "non_spam": "c\na\n"}.items():
        folder = tmp_path / "datasets" / "sms"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.txt").write_text(text, encoding="utf-8")
    rows = labelled.read_labelled(spark, str(tmp_path / "datasets/*/*.txt"))
    want = {("sms", 1, "a"), ("sms", 1, "b"), ("sms", 0, "c"), ("sms", 0, "a")}
    assert {(r.dataset, r.label, r.text) for r in rows.collect()} == want
    labelled.write_text(rows, str(tmp_path / "out"), files=2)
    labelled.write_text(rows, str(tmp_path / "out"))  # overwrites
    again = labelled.read_labelled(spark, str(tmp_path / "out"))
    assert sorted((r.dataset, r.label, r.text) for r in again.collect()) == sorted(want)


TAGGED = "a~NN~2~subj b~VB~0~ROOT c~NN~2~obj . d~VB~0~ROOT"


def test_tagged_text(frame):
    df = frame([(1, TAGGED), (2, "x~y~NN~0~r ~~~ bad~~0~r z~NN~1~r")], "msg_id bigint, text string")
    rows = tagged.parse_tagged(df).collect()
    assert [(r.msg_id, r.sent_no, r.tok_no, r.word, r.pos, r.head, r.rel) for r in rows] == [
        (1, 0, 1, "a", "NN", 2, "subj"), (1, 0, 2, "b", "VB", 0, "ROOT"), (1, 0, 3, "c", "NN", 2, "obj"),
        (1, 1, 1, "d", "VB", 0, "ROOT"), (2, 0, 1, "x~y", "NN", 0, "r"), (2, 1, 1, "z", "NN", 1, "r"),
    ]
    assert [r.tags for r in tagged.tag_sentences(df).collect()] == ["NN VB NN", "VB", "NN", "NN"]
    assert df.select(tagged.plain_from_tagged(F.col("text"))).first()[0] == "a b c . d"


def test_tree_stays_open_until_it_has_a_root(frame):
    df = frame([(1, "a~N~3~x . b~N~3~y c~V~0~r . d~V~0~r")], "msg_id bigint, text string")
    rows = tagged.parse_tagged(df, unit="tree").collect()
    assert [(r.sent_no, r.tok_no, r.word) for r in rows] == [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "d")]


def test_sentences_round_trip(frame):
    text = "subj MAILSUBJECTENDVAR  one. ENTERNEWLINEENDVAR  two"
    cut = tagged.cut_sentences(frame([(1, text)], "msg_id bigint, text string"))
    assert [r.ends_with for r in cut.orderBy("sent_no").collect()] == ["MAILSUBJECTENDVAR", "ENTERNEWLINEENDVAR", ""]
    assert tagged.join_sentences(cut).first().text == text


def test_splits(frame):
    df = frame([(1, "a\n\nb\n\n\nc")], "msg_id bigint, body string")
    assert [r.body for r in clean.split_on_blank_line(df).collect()] == ["a", "b\n\n\nc"]
    df = frame([(1, f"a\r\n{P.DASH_ROW}\r\nb\n{P.PLUS_ROW}\n{P.PLUS_ROW}\nc")], "msg_id bigint, text string")
    rows = clean.split_on_separator_rows(df).collect()
    assert [r.text for r in rows] == ["a", "b", "", "c"] and rows[0].n_plus_rows == 2
