import glob
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from corvane.llm import kernels as K  # noqa: E402
from corvane.llm.tokens import Encoder, TokenFile, locate, op11_token_output, read_documents, write_tokens  # noqa: E402


@pytest.fixture(scope="module")
def spec():
    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


def plain(spec, text):
    t = tokenizers.Tokenizer.from_str(spec)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


PIECES = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", "　", "a", "don't", "'s", "I'LL", "größe", "ö", "é", "é", "世界", "12", "3.5", "...", "!", "<|endoftext|>", "x" * 60, "word", "Der", "\x00", "😀", " ", "_", "ﬁ"]


def encode(encoder, texts):
    out = []
    for _, n, data, offsets in K.string_chunks(pa.array(texts)):
        counts, ids = encoder.encode(data, offsets)
        ends = np.cumsum(counts)
        out += [ids[b - c : b].tolist() for b, c in zip(ends, counts, strict=True)]
    return out


def test_cut_pieces_encode_like_whole_texts(spec):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + [" ".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 40))) for _ in range(1500)] + ["", None, "a", "\n", " a b ", "a b\nc d"]
    encoder = Encoder(spec)
    assert encoder.cuts
    t = tokenizers.Tokenizer.from_str(spec)
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for _ in range(2):  # with an empty table and with a filled one
        assert encode(encoder, texts) == want


def test_table_of_pieces_is_bounded(spec, monkeypatch):
    monkeypatch.setattr("corvane.llm.tokens.KEPT", 50)
    encoder = Encoder(spec)
    rng = random.Random(2)
    for _ in range(20):
        texts = [" ".join(str(rng.randrange(1000)) for _ in range(12))]
        assert encode(encoder, texts) == [plain(spec, texts[0])]
        assert len(encoder.known) <= 50 + 12


def test_other_vocabularies_get_whole_texts():
    encoder = Encoder(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    t = encoder.tokenizer
    assert not encoder.cuts
    assert encode(encoder, ["Ein Haus, two  houses", None, "A b"]) == [t.encode(x, add_special_tokens=False).ids for x in ("Ein Haus, two  houses", "", "A b")]


def documents(spark, tmp_path, rows, **kw):
    folder = f"file://{tmp_path}/tokens"
    manifest = write_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, start string").repartition(3), folder, kw.pop("spec"), **kw)
    return folder, manifest


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("length, per_batch, file_tokens", [(16, 3, 1 << 26), (16, 3, 100), (1, 1, 1), (2048, 256, 1 << 26)])
def test_round_trip(spark, tmp_path, spec, length, per_batch, file_tokens):
    rng = random.Random(length)
    rows = [(i, " ".join(rng.choice(["one", "zwei", "три", "a\nb"]) for _ in range(rng.randrange(0, 30))), 1, "x") for i in rng.sample(range(1000), 60)]
    rows += [(2000, None, 1, "x"), (2001, "", 1, "x"), (None, "null id", 1, "x"), (2002, "long " * 500, 1, "x"), (2003, "same", 1, "x"), (2003, "same", 1, "x")]
    folder, manifest = documents(spark, tmp_path, rows, spec=spec, length=length, per_batch=per_batch, file_tokens=file_tokens)
    rows = ordered(rows)
    ids = [plain(spec, r[1]) + [0] for r in rows]
    starts = np.cumsum([0, *map(len, ids)])
    got = read_documents(manifest, folder).orderBy("start").collect()
    assert [tuple(g) for g in got] == [(r[0], int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(rows, starts, ids, strict=False)]

    # the sequences, masks off the filling, are the ids in order
    flat, total = [], 0
    files = manifest.orderBy("part", "number").collect()
    for m in files:
        f = TokenFile(folder, m["name"])
        assert f.n_sequences == m.n_sequences
        taken = [(a, np.array(b)) for a, b in map(f.sequence, range(f.n_sequences))]
        assert all(len(a) == len(b) == length and set(np.unique(b)) <= {0, 1} for a, b in taken)
        masks = np.concatenate([b for _, b in taken])
        assert masks.sum() == m.n_tokens and (np.diff(masks.astype(int)) <= 0).all() and len(masks) - m.n_tokens < length
        flat += np.concatenate([a for a, _ in taken])[masks == 1].tolist()
        with pytest.raises(IndexError):
            f.sequence(f.n_sequences)
        if m in (files[0], files[-1]):
            assert locate(manifest, total + f.n_sequences - 1) == (m["name"], f.n_sequences - 1)
        total += f.n_sequences
    assert flat == [i for x in ids for i in x]
    with pytest.raises(IndexError):
        locate(manifest, total)


def test_random_access_copies_nothing(spark, tmp_path, spec):
    folder, manifest = documents(spark, tmp_path, [(i, f"text {i} " * 40, 1, "x") for i in range(200)], spec=spec, length=32, per_batch=8)
    f = TokenFile(folder, manifest.first()["name"])
    before = pa.total_allocated_bytes()
    views = [f.sequence(k) for k in range(f.n_sequences)]
    assert pa.total_allocated_bytes() == before and all(not a.flags.owndata and not a.flags.writeable for a, _ in views)
    assert np.shares_memory(f.sequence(1)[0], views[1][0]) and f.sequence(1)[1].buffers()[1].address == f.sequence(0)[1].buffers()[1].address


def test_leftovers_of_lost_attempts_do_not_count(spark, tmp_path, spec):
    folder, manifest = documents(spark, tmp_path, [(i, f"text {i}", 1, "x") for i in range(20)], spec=spec)
    want = sorted(map(tuple, read_documents(manifest, folder).collect()))
    for p in glob.glob(f"{tmp_path}/tokens/*"):
        Path(p.replace("000000-", "000009-", 1) + ".lost.arrow").write_bytes(b"half a file")
    assert sorted(map(tuple, read_documents(manifest, folder).collect())) == want


def test_empty_table_and_other_ids(spark, tmp_path, spec):
    folder, manifest = documents(spark, tmp_path, [], spec=spec)
    assert manifest.count() == 0 and read_documents(manifest, folder).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "y z")], "name string, body string")
    manifest = write_tokens(named, folder, spec, id="name", text="body")
    assert [(r.id, r.start, r.n_tokens) for r in read_documents(manifest, folder, "string").orderBy("start").collect()] == [("a", 0, 3), ("b", 3, 2)]


def test_query_by_brute_force(spark, sf, spec):
    rows = ordered(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for i, text in rows:
        x = plain(spec, text) + [0]
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, op11_token_output(spark, sf).collect())) == want
