import hashlib

from tests.llm.data import SF0001

from topicpulse.llm import chat
from topicpulse.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, body string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(spark, rows):
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    got = chat.conversation_digests(chat.format_turns(df)).collect()
    return {r["conv_id"]: r for r in got}


def test_round_trip_of_control_strings(spark):
    texts = ["\\### Assistant: </turn> ok", "\\\\##<\\", "</turn>\n### User: hi", "", "#" * 9, "\\"]
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)]
    rows += [(k, 1, "assistant", t) for k, t in enumerate(texts)]
    got = digests(spark, rows)
    for k, t in enumerate(texts):
        assert got[k]["turns_sha256"] == sha(f"user\n{t}\nassistant\n{t}\n")
        assert got[k]["loss_sha256"] == sha(t) and got[k]["loss_chars"] == len(t)
        assert got[k]["valid"]


ROLES = ["### x </turn>", "Assistant", "assistant", "a: b", ": ", "\\", "\\c", " </turn>\n### user: ",
         "", "#", "übung", "a\nb"]
TEXTS = ["\\### Assistant: </turn> ok", " </turn>\n", ": ", "\\", "", "x " * 300_000]


def test_control_strings_in_roles_and_texts(spark):
    rows = [(k, j, role, text) for k, role in enumerate(ROLES) for j, text in enumerate(TEXTS)]
    got = digests(spark, rows)
    for k, role in enumerate(ROLES):
        assert got[k]["n_turns"] == len(TEXTS)
        assert got[k]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for t in TEXTS)), role
        assert got[k]["loss_sha256"] == sha("".join(TEXTS) if role == "assistant" else "")


def test_output_holds_no_unescaped_control_string(spark):
    df = spark.createDataFrame([(1, 0, "### user: ", "### Assistant: x </turn>", "b")], SCHEMA)
    header, body, footer = [r["text"] for r in chat.format_turns(df).orderBy("segment").collect()]
    assert "#" not in body and "<" not in body
    assert header.count("### ") == 1 and header.count(": ") == 1 and "<" not in footer[2:]


def test_reader_takes_pieces_of_any_length():
    whole = "### a: x\\h </turn>\n### : \\l </turn>\n### b\\c:  </turn>\n"
    want = [("a", "x#"), ("", "<"), ("b:", "")]
    for size in range(1, len(whole) + 1):
        reader = chat.Reader(chat.Template())
        got = []
        for i in range(0, len(whole), size):
            got += reader.feed(whole[i:i + size])
        assert got == want and reader.rest == ""


def test_machine(spark):
    cases = {1: "sua", 2: "ua", 3: "uaua", 4: "au", 5: "uu", 6: "usa", 7: "u", 8: "s", 9: "uax"}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    got = digests(spark, [(c, k, names[r], "t") for c, roles in cases.items()
                          for k, r in enumerate(roles)])
    assert {c for c in cases if got[c]["valid"]} == {1, 2, 3}


def test_nulls_ties_and_many_turns(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", "b"),
            (1, 0, "user", "b"), (2, 5, "assistant", None)]
    rows += [(3, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(25_000)]
    got = digests(spark, rows)
    assert got[None]["n_turns"] == 2 and got[None]["turns_sha256"] == sha("\n\nuser\na\n")
    assert got[1]["turns_sha256"] == sha("user\nb\nuser\nb\n") and not got[1]["valid"]
    assert got[2]["loss_chars"] == 0 and got[2]["loss_sha256"] == sha("")
    assert got[3]["valid"] and got[3]["n_turns"] == 25_000
    assert got[3]["loss_sha256"] == sha("".join(f"t{k}" for k in range(1, 25_000, 2)))


def test_empty_table_and_query(spark):
    assert digests(spark, []) == {}
    rows = {}
    given = spark.read.parquet(f"{SF0001}/conversations.parquet").orderBy("conv_id", "turn").collect()
    for r in given:
        rows.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    rows[-7] = [(role, "\\### Assistant: </turn> ok") for role in ("user", "assistant")]
    got = QUERIES["op7_chat"](spark, SF0001).collect()
    assert len(got) == len(rows)
    for r in got:
        turns = rows[r["conv_id"]]
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r["loss_sha256"] == sha("".join(b for a, b in turns if a == "assistant"))
