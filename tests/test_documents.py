import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.operators import chunking, citations, evaluation
from quillspan.operators.lifecycle import IndexState
from quillspan.plans import service
from quillspan.sources import corpus, files
from quillspan.streaming.ingest import file_stream, ingest


def test_sentences_pack_with_overlap():
    text = "Alpha one. Beta two. Gamma three. Delta four."
    spans = chunking.sentence_spans(text, 30, 12)
    assert [10 + a for a, _ in spans][:2] == [10, 21] and len(spans) == 3
    assert all(b - a <= 30 for a, b in spans)


def test_long_sentences_are_cut():
    assert chunking.sentence_spans("x" * 25, 10, 2) == [(0, 10), (10, 20), (20, 25)]
    assert len(chunking.sentence_spans("a b c d e f g h", 4, 0, "tokens")) == 2


def test_policy_is_checked():
    for bad in ({"overlap": 500}, {"target_size": 0}, {"strategy": "semantic"}, {"semantic_threshold": 1.0}):
        with pytest.raises(ValueError):
            chunking.ChunkingPolicy(**bad)


def test_code_follows_syntax():
    code = "import os\n\n\ndef a():\n    return 1\n\n\ndef b():\n    return 2\n"
    how, spans = chunking.code_spans(code, "python", 30)
    assert how == "syntax" and "".join(code[a:b] for a, b in spans) == code
    assert chunking.code_spans("def (", "python", 30)[0] == "windows-after-failure"
    assert chunking.code_language("x", None, "#!/usr/bin/env python\n") == "python"


def test_semantic_spans_break_where_the_topic_does(spark):
    policy = chunking.ChunkingPolicy(target_size=8, overlap=2, size_unit="tokens", strategy="semantic")
    text = "a a. a b. z z. z y."
    groups = spark.createDataFrame([("d", 1, text), ("e", 1, "a."), ("f", 1, "q. q.")], "document_id string, group_no long, text string")
    embed = lambda texts: [[float("a" in t), float("z" in t)] for t in texts]
    rows = chunking.semantic_boundaries(groups, embed).orderBy("document_id", "sent_no").collect()
    assert [(r.document_id, r.start, r.end, r.topic) for r in rows] == [("d", 0, 5, 1), ("d", 5, 10, 1), ("d", 10, 15, 2), ("d", 15, 19, 3), ("e", 0, 2, 1), ("f", 0, 3, 1), ("f", 3, 5, 2)]
    spans = chunking.semantic_spans(text, [(r.start, r.end, min(r.topic, 2)) for r in rows if r.document_id == "d"], policy)
    assert len(spans) == 2 and spans[1][0] < spans[0][1]
    blocks = [("d", 0, "paragraph", text, "a", None, None, None, None, None), ("d", 1, "code", "x = 1", "a.py", None, None, None, None, None)]
    got = chunking.chunk_documents(spark.createDataFrame(blocks, BLOCK), policy, embed).orderBy("ordinal").collect()
    assert {r.chunker for r in got} == {"semantic", "syntax"} and got[0].chunk_text.startswith("a a. a b.")
    with pytest.raises(Exception, match="one vector per chunk"):
        chunking.semantic_boundaries(groups, lambda texts: []).collect()


CODE = {
    "javascript": ["import x from 'y';\n", "// adds { two\nfunction add(a, b) {\n  const s = `}${a}`;\n\n  return a + b; /* } */\n}\n", "export const twice = (x) => {\n  return \"{\" + x;\n};\n"],
    "java": ["package a.b;\n", "/** A box. */\nclass Box {\n  char open = '{';\n\n  int size() { return 1; }\n}\n", "interface Shape {\n  double area();\n}\n"],
    "rust": ["use std::fmt;\n", "fn first<'a>(x: &'a str) -> &'a str {\n    let c = '}';\n    x\n}\n", "struct P {\n    x: i32,\n}\n", "impl P {\n    fn go(&self) {}\n}"],
}


@pytest.mark.parametrize("language", sorted(CODE))
def test_declarations_of_brace_languages(language):
    code = "".join(CODE[language])
    how, spans = chunking.code_spans(code, language, 1)
    starts = chunking.declaration_starts(code, language)
    assert how == "scopes" and [code[a:b] for a, b in zip(starts, [*starts[1:], len(code)], strict=True) if a < b] == CODE[language]
    assert "".join(code[a:b] for a, b in spans) == code
    how, spans = chunking.code_spans(code, language, 90)
    assert "".join(code[a:b] for a, b in spans) == code and all(b - a <= 90 or code[a:b] in CODE[language] for a, b in spans if b - a != 90)
    assert chunking.code_spans(code + "}", language, 90)[0] == "blank-lines"


def test_token_windows_keep_their_budget_and_place(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    text = "Budgets hold for naïve tokens too: 서울 is two words' worth. " * 9 + "x" * 300
    groups = spark.createDataFrame([("d", 1, text), ("e", 1, ""), ("f", 1, None), ("g", 1, "one two three")], "document_id string, group_no long, text string")
    rows = chunking.token_windows(groups, chunking.tokenizer_offsets(path), 16, 4).orderBy("document_id", "chunk_no").collect()
    own, tokens = [r for r in rows if r.document_id == "d"], Tokenizer.from_file(path).encode(text, add_special_tokens=False).offsets
    assert all(r.chunk_text == text[r.start : r.end] and r.n_tokens <= 16 for r in own) and {r.document_id for r in rows} == {"d", "g"}
    assert [(r.start, r.end) for r in own] == [(tokens[k][0], tokens[min(k + 16, len(tokens)) - 1][1]) for k in range(0, len(tokens) - 4, 12)]
    assert own[-1].end == len(text) and sum(r.n_tokens for r in own) == len(tokens) + 4 * (len(own) - 1)
    pieces = lambda texts: [t.upper().split() for t in texts]  # noqa: E731  gives no offsets
    assert [(r.start, r.end) for r in chunking.token_windows(groups.where("document_id = 'g'"), pieces, 2, 1).orderBy("chunk_no").collect()] == [(0, 7), (4, 13)]
    with pytest.raises(ValueError):
        chunking.token_windows(groups, pieces, 2, 2)


BLOCK = "document_id string, block_no int, kind string, text string, source_path string, language string, page int, section string, line_start int, char_start int"


def test_headings_open_groups_and_pages_part_them(spark):
    rows = [("d", 0, "heading", "Retrieval", "a", None, 1, "s", 1, None), ("d", 1, "paragraph", "Exact identifiers matter.", "a", None, 1, "s", 3, None), ("d", 2, "heading", "Next", "a", None, 2, None, None, None), ("d", 3, "paragraph", " ", "a", None, 2, None, None, None), ("d", 4, "code", "x = 1", "a.py", None, 2, None, None, None)]
    got = chunking.chunk_documents(spark.createDataFrame(rows, BLOCK), chunking.ChunkingPolicy()).orderBy("ordinal").collect()
    assert [r.chunk_text for r in got] == ["Retrieval\n\nExact identifiers matter.", "Next", "x = 1"]
    assert (got[0].line_start, got[0].line_end, got[0].char_start, got[0].n_locations, got[0].section) == (1, 3, None, 2, "s")
    assert [r.page for r in got] == [1, 2, 2]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "The March report contains an orange chart [doc-march]."), (2, "Volcanoes erupt daily [doc-march]. See [nope]")], "answer_id long, text string")
    evidence = spark.createDataFrame([(k, "doc-march", "The March report has an orange chart", "p", 3, "Project status") for k in (1, 2)], "answer_id long, chunk_id string, text string, source_path string, page int, section string")
    got = {(r.answer_id, r.pos): r for r in citations.check_citations(answers, evidence).collect()}
    assert got[1, 0].claim == "The March report contains an orange chart" and got[1, 0].status == "ok" and got[1, 0].page == 3
    assert "does not support" in got[2, 0].status and "not present" in got[2, 1].status
    assert citations.assemble_citations(answers.where("answer_id = 1"), evidence).count() == 1
    with pytest.raises(Exception, match="does not support"):
        citations.assemble_citations(answers, evidence).collect()


def test_adjacent_markers(spark):
    answers = spark.createDataFrame([(1, "One. Grew fast [a][b]")], "answer_id long, text string")
    assert [r.claim for r in citations.markers(answers).orderBy("pos").collect()] == ["Grew fast", "Grew fast"]


def test_answer_checks(spark):
    gold = spark.createDataFrame([(k, ["c"], ["orange chart"]) for k in (1, 2, 3)], "case_id long, relevant_chunk_ids array<string>, required_facts array<string>")
    answers = spark.createDataFrame([(1, "An orange chart", False), (2, "An orange chart", False), (3, "", True)], "case_id long, text string, abstained boolean")
    retrieved = spark.createDataFrame([(1, "c"), (3, "c")], "case_id long, chunk_id string")
    place = "source_path string, page int, section string"
    evidence = spark.createDataFrame([(k, "c", "the orange chart", "p", 3, None) for k in (1, 2)], f"case_id long, chunk_id string, text string, {place}")
    cited = spark.createDataFrame([(1, 0, "orange chart", "c", "p", 3, None), (2, 0, "orange chart", "c", "p", 4, None)], f"case_id long, pos int, claim string, chunk_id string, {place}")
    got = {r.case_id: r for r in evaluation.evaluate_answers(gold, answers, retrieved, evidence, cited).collect()}
    assert got[1][1:5] == (True, True, True, True) and got[1].notes == []
    assert got[2][1:5] == (False, True, True, False)
    assert got[3][1:5] == (True, None, None, None)


def source(spark, *rows):
    return spark.createDataFrame(list(rows), "source_path string, document_id string, checksum string, versions string, n_chunks int, n_vectors int, cancelled boolean")


def test_lifecycle(spark, tmp_path):
    state = IndexState(spark, str(tmp_path / "state"))
    act = lambda df: {r.source_path: r.action for r in df.collect()}
    assert act(state.apply(source(spark, ("a", "d1", "x", "1", 2, 2, False), ("b", "d2", "y", "1", 1, 0, False)))) == {"a": "added", "b": "added"}
    assert state.revision() == 2
    assert act(state.apply(source(spark, ("a", "d1", "x", "1", 2, 2, False)))) == {"a": "skipped"}
    assert state.revision() == 2
    got = state.apply(source(spark, ("a", "other", "z", "1", 3, 3, False), ("b", "d2", "y", "2", 1, 0, False))).collect()
    assert {(r.source_path, r.action, r.document_id) for r in got} == {("a", "updated", "d1"), ("b", "rebuilt", "d2")}
    failed = state.apply(source(spark, ("a", "d1", "bad", "1", 0, 0, False), ("b", "d2", "bad", "2", 2, 1, False), ("c", "d3", "q", "1", 1, 0, True))).collect()
    assert all(r.error for r in failed)
    assert {r.source_path: r.checksum for r in state.sources().collect()} == {"a": "z", "b": "y"}
    assert {r.source_path: r.status for r in state.attempts().collect()} == {"a": "failed", "b": "failed", "c": "failed"}
    assert act(state.prune(spark.createDataFrame([("a",)], "source_path string"))) == {"b": "deleted"}
    assert act(state.delete(spark.createDataFrame([("nope",)], "source_path string"))) == {"nope": "missing"}
    state.vacuum(age=0)
    assert [r.source_path for r in state.sources().collect()] == ["a"]


def test_files(spark):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:p/><w:p><w:t>Hello</w:t><w:t> there</w:t></w:p></w:document>')
    rows = spark.createDataFrame([("a.docx", bytearray(docx.getvalue())), ("bad.docx", bytearray(b"no"))], "path string, content binary")
    got = {r.source_path: r for r in files.paged_blocks(rows, "docx").collect()}
    assert got["a.docx"].text == "Hello there" and got["a.docx"].section == "Paragraph 2"
    assert "invalid" in got["bad.docx"].error
    text = spark.createDataFrame([("../x/a.py", "", bytearray("﻿ x = 1\ny ".encode()))], "path string, media_type string, content binary")
    doc = files.text_documents(text).first()
    assert (doc.source_path, doc.kind, doc.text, doc.line_end, doc.char_end) == ("x/a.py", "code", "x = 1\ny", 2, 7)


def test_json_lines(spark, tmp_path):
    good = tmp_path / "gold.jsonl"
    good.write_text('{"id":"q","query":"x","relevant_chunk_ids":["a"],"tags":[]}\n\n')
    assert corpus.read_gold(spark, str(good)).count() == 1
    good.write_text('{"id":"q","query":"x","relevant_chunk_ids":["a"]}\n\n{"id":"q","query":"x","relevant_chunk_ids":[]}\n{"id":\n')
    with pytest.raises(ValueError, match=r"gold\.jsonl:[34]: bad line"):
        corpus.read_gold(spark, str(good)).collect()
    with pytest.raises(Exception):
        corpus.read_chunks(spark, str(tmp_path / "none.jsonl")).collect()


def test_uploads_and_stream(spark, tmp_path):
    state = IndexState(spark, str(tmp_path / "state"))
    ups = spark.createDataFrame([("a.txt", "", base64.b64encode(b"hello").decode()), ("b.exe", "", base64.b64encode(b"x").decode()), ("c.txt", "", "!")], "relative_path string, media_type string, content_base64 string")
    done, skipped = service.add_uploads(state, ups)
    assert [r.action for r in done.collect()] == ["added"] and skipped.count() == 2
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "n.txt").write_text("new file")
    for _ in range(2):
        ingest(file_stream(spark, str(folder)), state, str(tmp_path / "cp")).awaitTermination()
    assert state.sources().count() == 2
    assert service.delete_source(state, spark, "a.txt").first().action == "deleted"


def encoded(path, content):
    return (path, "", base64.b64encode(content).decode())


UPLOAD = "relative_path string, media_type string, content_base64 string"


def test_uploads_are_read_chunked_and_found(spark, tmp_path):
    from datetime import date

    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:p><w:t>Glacier survey</w:t></w:p><w:p><w:t>Second part</w:t></w:p></w:document>')
    state = IndexState(spark, str(tmp_path / "state"))
    rows = [encoded("a.txt", b"Volcano notes. " * 200), encoded("b.docx", docx.getvalue()), encoded("blank.txt", b" \n "), encoded("broken.docx", b"no"), encoded("broken.pdf", b"no"), encoded("c.txt", b"caf\xff sea"), encoded("c2.py", b"x = 1\n"), encoded("c.txt", b"last caf\xff wins")]
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    done, skipped = service.add_uploads(state, spark.createDataFrame(rows, UPLOAD), embed=embed)
    got = {r.source_path: r for r in done.collect()}
    assert skipped.count() == 0 and {p for p, r in got.items() if r.error} == {"blank.txt", "broken.docx", "broken.pdf"}
    chunks = state.chunks().collect()
    by = {p: sorted((c.ordinal, c.text) for c in chunks if c.source_path == p) for p in {c.source_path for c in chunks}}
    assert set(by) == {"a.txt", "b.docx", "c.txt", "c2.py"} == {r.source_path for r in state.sources().collect()}
    assert len(by["a.txt"]) > 2 and [t for _, t in by["b.docx"]] == ["Glacier survey", "Second part"] and by["c.txt"][0][1] == "last caf� wins"
    assert {r.source_path: (r.n_chunks, r.n_vectors) for r in state.sources().collect()} == {p: (len(v), len(v)) for p, v in by.items()}
    assert {r.chunk_id: r.vector[0] for r in state.vectors().collect()} == {c.chunk_id: len(c.text) for c in chunks}
    assert {r.source_path: r.status for r in state.attempts().collect()}["broken.docx"] == "failed"
    asked = spark.createDataFrame([(1, "glacier")], "qid long, query string")
    assert [c.source_path for c in chunks if c.chunk_id == service.answer_search(state.chunks(), asked, date(2026, 1, 1)).first().chunk_id] == ["b.docx"]

    again = {r.source_path: r for r in service.add_uploads(state, spark.createDataFrame([rows[0], encoded("b.docx", b"broken now"), encoded("c.txt", b"new text")], UPLOAD), embed=embed)[0].collect()}
    assert {p: (r.action, r.n_chunks) for p, r in again.items()} == {"a.txt": ("skipped", len(by["a.txt"])), "b.docx": ("updated", 0), "c.txt": ("updated", 1)} and again["b.docx"].error
    texts = {(c.source_path, c.text) for c in state.chunks().collect()}
    assert ("b.docx", "Glacier survey") in texts and ("c.txt", "new text") in texts and len(texts - {("c.txt", "new text")}) == len({(c.source_path, c.text) for c in chunks}) - 1
    failed = service.add_uploads(state, spark.createDataFrame([encoded("d.txt", b"words")], UPLOAD), embed=lambda t: [])[0].first()
    assert "one vector per chunk" in failed.error
    service.delete_source(state, spark, "a.txt")
    assert state.chunks().where("source_path = 'a.txt'").count() == 0 == state.vectors().where(F.col("chunk_id").startswith(got["a.txt"].document_id)).count()


def test_streamed_files_are_admitted_and_chunked(spark, tmp_path):
    state, folder = IndexState(spark, str(tmp_path / "state")), tmp_path / "in"
    folder.mkdir()
    (folder / "n.txt").write_text("new file")
    (folder / "e.txt").write_text("  ")
    (folder / "p.exe").write_text("program")
    ingest(file_stream(spark, str(folder)), state, str(tmp_path / "cp"), root=f"file:{folder}").awaitTermination()
    assert [(r.source_path, r.text) for r in state.chunks().collect()] == [("n.txt", "new file")]
    assert {r.source_path: r.status for r in state.attempts().collect()} == {"n.txt": "ready", "e.txt": "failed", "p.exe": "failed"}


def test_cancelled_sources_are_not_committed(spark, tmp_path):
    state = IndexState(spark, str(tmp_path / "state"))
    service.skip_source(state, "b.txt")
    done, _ = service.add_uploads(state, spark.createDataFrame([encoded("a.txt", b"one"), encoded("b.txt", b"two")], UPLOAD))
    assert {r.source_path: r.error for r in done.collect()} == {"a.txt": None, "b.txt": "cancelled"}
    assert [r.source_path for r in state.source_paths().collect()] == ["a.txt"] and state.document_count() == 1
    assert state.get("a.txt").count() == 1 and state.latest_attempt("b.txt").first().status == "failed"
    revision, chunks = state.snapshot()
    assert revision == 1 and [c.text for c in chunks.collect()] == ["one"]
    assert [(r.term, r.tf) for r in state.lexical_index().collect()] == [("one", 1)]
    noted = service.skipped_ledger(None, spark.createDataFrame([("b", "cancelled"), ("b", "cancelled"), ("c", "empty file"), ("c", "empty file")], "source_path string, why string"))
    assert sorted(r.source_path for r in noted.collect()) == ["b", "c", "c"]


def test_answers_carry_plan_terms_and_source(spark):
    from datetime import date

    chunks = spark.createDataFrame([("a:0", "a.txt", "fetch retries of the client"), ("b:0", "b.txt", "nothing here")], "chunk_id string, source_path string, text string")
    got = service.answer_search(chunks, spark.createDataFrame([(1, "'client' fetch_Retries.py")], "qid long, query string"), date(2026, 1, 1)).first()
    assert (got.chunk_id, got.source_path, got.source, set(got.matched_terms)) == ("a:0", "a.txt", "bm25", {"fetch", "retries"} | ({"client"} & set(got.matched_terms)))
    assert list(got.exact_terms) == ["client", "fetch_Retries.py"] and len(got.query_variants) == 2 and service.health() == {"status": "ok"}
    for bad in ("  ", "x" * 501):
        with pytest.raises(Exception, match="a query needs"):
            service.answer_search(chunks, spark.createDataFrame([(1, bad)], "qid long, query string"), date(2026, 1, 1)).collect()
    with pytest.raises(ValueError, match="limit"):
        service.answer_search(chunks, spark.createDataFrame([(1, "x")], "qid long, query string"), date(2026, 1, 1), limit=51)


def test_chunks_are_found_again_in_their_source():
    assert chunking.realigned("One two. TWO three", ["one two. ", "two", "three"]) == [(0, 8), (9, 12), (13, 18)]
    with pytest.raises(ValueError):
        chunking.realigned("abc", ["x"])


def test_workers_get_the_package(spark):
    import zipfile as z

    from quillspan.session import ship

    assert "quillspan/functions/text.py" in z.ZipFile(ship(spark)).namelist()


def test_registered_parsers_are_asked_in_order(spark):
    from quillspan.plans.ingestion import default_parsers, normalize

    upper = lambda df: normalize(df.withColumnRenamed("path", "source_path")).withColumn("text", F.upper("text"))
    parsers = default_parsers().register("shout", lambda path, kind: path.endswith(".loud.txt"), upper, first=True)
    rows = spark.createDataFrame([("a.txt", "text/plain", bytearray(b"one")), ("b.loud.txt", "text/plain", bytearray(b"two")), ("c.bin", "application/x", bytearray(b"x"))], "source_path string, media_type string, content binary")
    got = {r.source_path: (r.text, r.error) for r in normalize(rows, parsers).collect()}
    assert got["a.txt"] == ("one", None) and got["b.loud.txt"] == ("TWO", None) and got["c.bin"][1]
