import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from helpers import LONG, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyrank.llm import alignment, tokens
from skyrank.llm.arrow import raw

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = ([(i, f"Document {i % 40}: some  text\n\nabout x{i * 7919} <|endoftext|> and </s>\tmore" + " 漢字𝄞" * (i % 5)) for i in range(150)]
        + [(500, None), (501, ""), (None, "no id"), (None, None), (7, "same id"), (7, "same id"), (502, LONG[:100_000]), (503, " "), (504, "   \n \n\n x  "),
           (505, "a ▁ sign"), (506, "\x00 \x1c"), (507, "the the the the")])


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    return a, sentencepiece.SentencePieceProcessor(model_file=B), code


def pair_lists(models, text):
    """[(groups, links)] by walking both token lists, or None."""
    a, b, code = models
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spell_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
    spell_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
               for p in map(b.id_to_piece, ids_b)]
    if b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
        return None
    i = j = at_a = at_b = 0
    groups, links, now = [], [], ([], [])
    while i < len(ids_a):
        if not now[0]:
            now[0].append(ids_a[i])
            now[1].append(ids_b[j])
        links.append((ids_a[i], ids_b[j]))
        x, y = at_a + len(spell_a[i]), at_b + len(spell_b[j])
        if x <= y:
            i, at_a = i + 1, x
        if y <= x:
            j, at_b = j + 1, y
        if x == y:
            groups.append(now)
            now = ([], [])
        elif x < y:
            now[0].append(ids_a[i])
        else:
            now[1].append(ids_b[j])
    return ids_a, ids_b, groups, links


def expected(models, rows):
    found = [pair_lists(models, t) for _, t in rows]
    count = Counter(link for f in found if f for link in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), f in zip(rows, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2])
        out.append((i, len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(count[x] == best[x[1]] for x in f[3]), sum(count[x] for x in f[3]), text))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("fan_in,slice_chunks,chunk", [(256, 512, 4_000_000), (2, 2, 2000)])
def test_against_walking_both_lists(spark, models, fan_in, slice_chunks, chunk):
    done = alignment.align(docs(spark, ROWS, extra=True), A, B, fan_in=fan_in, slice_chunks=slice_chunks,
                           chunk_bytes=chunk, block=7 if chunk < 10_000 else 16_384)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in done.collect()), key=key)
    want = sorted(expected(models, ROWS), key=key)
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and got == want
    assert [r for r in got if r[0] == 505][0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_empty_table(spark):
    assert alignment.align(docs(spark, []), A, B).count() == 0


def test_merge_holds_only_what_overlaps():
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 5000, 800)) for _ in range(30)]
    blocks = sorted((r[i:i + 50] for r in runs for i in range(0, len(r), 50)), key=lambda b: b[0])
    merge, got, most = alignment.Merge(flush=500), [], 0
    for b in blocks:
        got += list(merge.add(b, np.full(len(b), 2)))
        most = max(most, merge.held)
    got.append(merge.before(None))
    pairs, counts = (np.concatenate(x) for x in zip(*got))
    want = Counter(np.concatenate(runs).tolist())
    assert dict(zip(pairs.tolist(), counts.tolist())) == {k: 2 * n for k, n in want.items()} and (np.diff(pairs) > 0).all()
    assert most < 4000


ODD = st.text(st.sampled_from(list(" \n\t\x1c 　'sltdabAB19.,!-_<|>é漢𝄞")), min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=6))
def test_pieces_are_those_of_whole_texts(models, texts):
    memo = tokens.pieces(B)
    ids, sizes = memo.encode(*raw(pa.array([" " + t for t in texts], pa.string())))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [models[1].encode(t) for t in texts]


def test_query_against_walking_both_lists(spark, models):
    import pyarrow.parquet as pq
    from skyrank.llm.queries import op12_tokenizer_alignment
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in expected(models, rows)]
    got = [tuple(r[c] for c in [*COLUMNS[:-1], "groups_sha256"]) for r in op12_tokenizer_alignment(spark, folder).collect()]
    assert sorted(got) == sorted(want)
