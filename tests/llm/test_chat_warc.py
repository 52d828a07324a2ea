import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import chat, warc

TURNS = "conv_id long, turn long, role string, text string, key string, window int"


@given(st.text(alphabet="\\<>|[]/INSTsn_imend \n%0A25tar"))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    for given_text in (text, text + "<|im_end|>", "</s>" + text + "\\"):
        assert chat.unescape(chat.escape(given_text)) == given_text
        assert chat.unescape_role(chat.escape_role(given_text)) == given_text
        assert not any(c in chat.escape(given_text) for c in chat.CONTROLS)


def expected(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(v), h("".join(f"{r}\n{x}\n" for r, x in v)), sum(len(x) for r, x in v if r == "assistant"), h("".join(x for r, x in v if r == "assistant"))) for c, v in out.items()}


@pytest.mark.parametrize(("budget", "history"), [(40, 20), (2048, 256), (1, 0)])
def test_conversations_come_back(spark, budget, history):
    odd = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", odd), (-7, 1, "assistant", odd), (1, None, "user", None), (1, 0, None, "<|im_end|>\n<|im_start|>user\n"), (1, 1, "assistant", ""), (2, 0, "tool\n<s>", "x"), (2, 0, "tool\n<s>", "x"), (None, 0, "assistant", "nobody's"), (3, 0, "system", "be kind")]
    rows += [(3, n, ("user", "assistant")[n % 2], f"turn {n} " * (n % 7)) for n in range(1, 30)] + [(4, 0, "assistant", "long " * 3000), (4, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], TURNS)
    windows = chat.format_conversations(df, budget=budget, history=history).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest_windows(windows).collect()}
    assert got == expected(rows)
    for w in windows.collect():
        turns = chat.read_window(w.text)
        assert len(turns) == w.n_context + w.n_turns and (w.n_tokens <= budget or w.n_turns == 1)
        if w.conv_id == 3 and w.window:
            assert turns[0] == ("system", "be kind")
    windows.unpersist()
    assert chat.digest_windows(chat.format_conversations(df.where("false"))).count() == 0


def test_broken_windows_are_noticed():
    with pytest.raises(ValueError):
        chat.read_window("<|im_start|>user\nx<|im_end|>\nrest")


PAGES = "page_id long, url string, html string, hash string, copy int, record string"


def archive(spark, rows, least=0):
    return warc.pages_through_archives(spark.createDataFrame([(*r, "h", 9, "r") for r in rows], PAGES), least)


def test_pages_come_back(spark):
    rows = [(5, "http://a/x", "same\r\n\r\nWARC/1.1\r\n"), (2, "http://b\r\nX: y", "same\r\n\r\nWARC/1.1\r\n"), (9, None, None), (8, "u", ""), (7, "ü", "é" * 3000), (1, "z", "one"), (1, "y", "one"), (None, "n", "one"), (4, "q", "four"), (4, "q", "five")]
    got = archive(spark, rows).collect()
    assert len(got) == len(rows)
    first = {}
    for p, _, html in rows:
        if p is not None:
            first[html or ""] = min(p, first.get(html or "", p))
    for p, _, html in rows:
        body = (html or "").encode()
        mine = [r for r in got if r.page_id == p and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()]
        assert mine and all(r.payload_bytes == len(body) for r in mine)
        if p == first[html or ""]:
            assert [r.record_type for r in mine].count("response") == 1
        else:
            assert [(r.record_type, r.refers_to) for r in mine] == [("revisit", first[html or ""])]
    assert archive(spark, rows[:0]).count() == 0


def test_small_payloads_are_all_responses(spark):
    got = archive(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")], least=5).collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in got} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_transactions_are_nested(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_pages(df, path)
    rows = {r.metadata[0].fields["page-id"]: r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    assert rows["1"].capture.block.endswith(b"\r\n\r\nx") and rows["1"].request.target == "http://a"
    assert rows["2"].capture.refers_to == rows["1"].record_id and rows["2"].capture.block.endswith(b"\r\n\r\n")
