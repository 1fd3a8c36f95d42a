"""Token files and packing: round trips and brute force."""

import zlib

import numpy as np
import pytest

from quarry.llm import packing, token_files, tokens
from quarry.llm.queries import vocabulary

TEXTS = ["Hello world, hello  World!", None, "", "a   b c\n\n d", " lead", "trail ", "it's don't 've", "<|endoftext|> x", "日本 語 é́ Σας ΟΔΟΣ", "\n \n b", "x\t y   z",
         "word " * 30000, "0 1 00 10", "a 0 b", "tab\t\tnewline\r\n end", "Mixed.Case,Punct;here", "a b 　 c"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piecewise_ids_equal_whole_ids(name):
    enc = tokens.PieceEncoder(vocabulary(name))
    texts = [t or "" for t in TEXTS] + [a + b for a in (TEXTS[0], "x ", "\n", " ") for b in (" y", "\n", "  z", "\t")]
    assert enc.encode(texts) == enc.whole(texts)
    assert enc.encode(texts) == enc.whole(texts)  # from the cache


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_have_their_ids(name):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(vocabulary(name))  # nothing set
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|startoftext|> y<|endoftext|>", "<|endoftext|> <|endoftext|>\n z", "<|ENDOFTEXT|>", "<|endoftext |>", "no mark"]
    want = [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    enc = tokens.PieceEncoder(vocabulary(name))
    assert enc.encode(texts) == want == enc.whole(texts)
    assert [len(w) // 4 for w in want[:2]] == [3, 1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_control_characters_keep_their_ids(name):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(vocabulary(name))
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = ["ab\x1fcd", "a \x1c b", "\x1d", " \x1e\x1e ", *(a + c + b for c in [*map(chr, range(32)), *spaces] for a in ("a", "a ", "") for b in ("b", " b", c, ""))]
    enc = tokens.PieceEncoder(vocabulary(name))
    assert enc.encode(texts) == [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("width", [1, 5, 8, 16, 17, 23, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 4099, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8) and (token_files.unpack(data, len(ids), width) == ids).all()


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    uri = f"file://{tmp_path}/x.tkb"
    w = token_files.TokenFileWriter(uri, 17)
    parts = [rng.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 5, 4096, 300_000, 1, 8192, 0)]
    for i, p in enumerate(parts):
        w.add(None if i == 0 else i, p)
    w.close()
    f, flat = token_files.TokenFile(uri), np.concatenate(parts)
    assert f.n_ids == len(flat) and f.nulls.tolist() == [1, 0, 0, 0, 0, 0, 0]
    for a, b in [(0, 0), (0, 1), (4095, 4097), (5000, 299_999), (len(flat) - 1, len(flat)), (0, len(flat))]:
        assert (f.ids(a, b) == flat[a:b]).all()


def _docs(spark):
    rows = [(50 - i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(50, TEXTS[0], 1, 2), (None, "null id", 1, 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start int, n_docs int").repartition(3)


def test_token_files_equal_direct_encoding(spark):
    rows, docs = _docs(spark)
    path = vocabulary("word_bpe_49k.json")
    got = sorted(map(tuple, token_files.read_token_files(token_files.write_token_files(docs, path)).collect()), key=lambda r: r[1])
    enc = tokens.PieceEncoder(path)
    want, start = [], 0
    for doc, text in sorted(((a, b or "") for a, b, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = enc.whole([text])[0] + np.array([1], "<u4").tobytes()
        want.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == want
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), path)).count() == 0


def test_tree_is_first_fit():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 101, 300)
    where, offset = packing.first_fit_decreasing(sizes, 100)
    room, want = [100] * 300, np.zeros(300, int)
    for i in np.argsort(-sizes, kind="stable"):
        want[i] = next(k for k, r in enumerate(room) if r >= sizes[i])
        room[want[i]] -= sizes[i]
    assert (where == want).all()
    for b in set(where.tolist()):
        own = np.flatnonzero(where == b)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.cumsum(sizes[own]) - sizes[own]).all() and sizes[own].sum() <= 100


def test_packing_keeps_every_id_once(spark):
    rows, docs = _docs(spark)
    path = vocabulary("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, group_docs=7).toPandas()
    enc = tokens.PieceEncoder(path)
    want = {}
    for doc, text, *_ in rows:
        ids = enc.whole([text or ""])[0] + np.array([1], "<u4").tobytes()
        want.setdefault(doc, []).append(ids)
    for doc, texts in want.items():
        own = got[got.doc_id.isna() if doc is None else got.doc_id == doc].sort_values("start")
        assert own.length.sum() == sum(len(t) // 4 for t in texts)
        for _, r in own.iterrows():
            assert any(len(t) // 4 == r.doc_tokens and zlib.crc32(t[4 * int(r.start):4 * int(r.start + r.length)]) == r.ids_crc32 for t in texts)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 2048
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_packing_wastes_little(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "tok " * int(rng.integers(1, 3000))) for i in range(600)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.json")).toPandas()
    assert got.length.sum() / (got.sequence_id.nunique() * 2048) > 0.98


def test_plain_texts_are_cut_into_parts_at_once():
    """A text that can be cut into parts throughout leaves no piece of its own to remember; ids as of the whole text."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.llm.tokens import PieceEncoder

    r = random.Random(7)
    signs = ["a", "Zq", "über", "ÉÀ", "ß", "12", "3.5", ",", ".\n", "&&&", "\t", "\r\n", "#", "_", "x" * 40, "\x7f", "\x00"]
    plain = ["".join(r.choice(signs) + r.choice(["", " ", "", " "]) for _ in range(r.randrange(12))) for _ in range(400)] + ["", " ", " a", "a ", "1, 2 b", "a.\nB"]
    odd = ["it's", "a  b", "a\x1cb", "x \x1f y", "日本 語", "a b", "a<|endoftext|>b", "a<|startoftext|> b", "x \n", "é é", "×÷", None]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        enc = PieceEncoder(path)
        for text, ids in zip(plain + odd, enc.encode(plain + odd)):
            assert list(memoryview(ids).cast("I")) == whole.encode(text or "", add_special_tokens=False).ids, (name, text)
        enc = PieceEncoder(path)
        enc.encode(["one two, three. four", "Five\nsix"])
        assert not enc.cache.now and enc.parts
