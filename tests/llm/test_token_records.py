import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import LONG, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyrank.llm import crc, token_records as records, tokens
from skyrank.llm.arrow import raw

BPE = public_tokenizers.path("byte_bpe_50k.json")
ROWS = ([(i, f"Document {i}:\n\n  some text  about x{i * 7919} <|endoftext|> and\tmore" + " 漢字" * (i % 5)) for i in range(200, 0, -1)]
        + [(500, None), (501, ""), (None, "no id"), (None, None), (7, "other text"), (7, "other text"), (502, LONG), (503, " "), (504, "   \n \n\n x")]
        + [(-3, f"hot {i % 3}") for i in range(90)])


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


def ids_of(bpe, text):
    return bpe.encode(text or "", add_special_tokens=False).ids + [0]


def test_files_hold_every_document_in_order(spark, tmp_path, bpe):
    path = str(tmp_path / "records")
    records.write(docs(spark, ROWS, extra=True), path, BPE, file_bytes=3_000)
    got = records.read(spark, path).orderBy("start").collect()
    assert len(got) == len(ROWS) and len(list((tmp_path / "records").glob("*.rec"))) > 3
    assert [r.doc_id for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    at, want = 0, {}
    for i, t in ROWS:
        want.setdefault(i, []).append(np.array(ids_of(bpe, t), "<u4").tobytes())
    have = {}
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
        have.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    mixed = records.shuffled(spark, path, 5).collect()
    key = lambda r: (r.start, r.doc_id, r.n_tokens, bytes(r.ids))
    assert sorted(map(key, mixed)) == list(map(key, got)) and [r.start for r in mixed] != [r.start for r in got]
    assert [key(r) for r in records.shuffled(spark, path, 5).collect()] == list(map(key, mixed))


def test_the_task_that_writes_files_also_encodes_their_texts(tmp_path, bpe, monkeypatch):
    monkeypatch.setattr(records.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0))
    writer = records._Writer({"path": str(tmp_path), "file_bytes": "3000", "width": "2", "tokenizer": BPE, "end_id": "0"})
    texts = [t for _, t in ROWS]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in ROWS[a:a + 50]], "text": texts[a:a + 50]},
                                          pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) for a in range(0, len(ROWS), 50)]
    done = writer.write(iter(batches))
    assert [f[1] for f in done.files] == list(range(len(done.files))) and sum(f[3] for f in done.files) == len(ROWS)
    writer.commit([done, writer.write(iter([]))])
    reader = records._Reader({"path": str(tmp_path)})
    got = [(d, n, ids) for p in reader.partitions() for b in reader.read(p) for d, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")))]
    assert got == [(i, len(ids_of(bpe, t)), np.array(ids_of(bpe, t), "<u4").tobytes()) for i, t in ROWS]


def test_a_record_can_be_read_by_the_published_framing(spark, tmp_path, bpe):
    path = str(tmp_path / "records")
    records.write(docs(spark, [(1, "one two"), (2, "")]), path, BPE)
    (file,) = (tmp_path / "records").glob("*.rec")
    raw, at, found = file.read_bytes(), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at:at + 8], "little")
        found.append(np.frombuffer(raw[at + 12:at + 12 + n], "<u2").tolist())
        at += n + 16
    assert found == [ids_of(bpe, "one two"), [0]]


def test_damage_is_noticed(spark, tmp_path):
    path = tmp_path / "records"
    records.write(docs(spark, [(1, "one two three")]), str(path), BPE)
    (file,) = path.glob("*.rec")
    data = bytearray(file.read_bytes())
    data[13] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        records.read(spark, str(path)).collect()


def test_an_empty_table_has_a_manifest(spark, tmp_path):
    path = str(tmp_path / "records")
    records.write(docs(spark, []), path, BPE)
    assert records.read(spark, path).count() == 0 and records.shuffled(spark, path, 1).count() == 0


def test_checksums():
    data = np.frombuffer(b"123456789" + bytes(range(256)) * 9, np.uint8)
    assert crc.crc32c(data, [0], [9])[0] == 0xE3069283

    def slow(b):
        s = 0xFFFFFFFF
        for x in b:
            s ^= x
            for _ in range(8):
                s = (s >> 1) ^ 0x82F63B78 if s & 1 else s >> 1
        return s ^ 0xFFFFFFFF

    cases = [(0, 0), (3, 1), (1, 2), (5, 3), (0, 4), (9, 511), (9, 512), (1, 513), (2, 2000)]
    got = crc.crc32c(data, *map(list, zip(*cases)))
    assert got.tolist() == [slow(data[a:a + n].tobytes()) for a, n in cases]
    assert crc.masked(np.array([0], np.uint32))[0] == 0xA282EAD8


def ids_by_text(memo, texts):
    ids, sizes = memo.encode(*raw(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


ODD = st.text(st.sampled_from(list(" \n\t\x0b\x1c\x1f\x85\xa0 　᠎​'sltdabAB19.,!-_<|>é漢𝄞▁\x00")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_ids_are_those_of_whole_texts(bpe, texts):
    memo = tokens.byte_bpe(BPE)
    assert ids_by_text(memo, texts) == [bpe.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_against_whole_text_encoding(spark, bpe):
    import pyarrow.parquet as pq
    from skyrank.llm.queries import op11_token_output
    folder = "/root/testdata/sf0.001"
    want, at = {}, 0
    for r in sorted(pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"]):
        ids = np.array(ids_of(bpe, r["text"]), "<u4")
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op11_token_output(spark, folder).collect()} == want
