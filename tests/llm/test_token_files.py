import zlib

import numpy as np
import pytest

from cachescope.llm import token_files
from cachescope.llm.queries import END_ID, tokenizer_path

from .helpers import EDGES, edges, empty

TRICKY = ["a.,b. it's don't I'M x.y, 3,4. é́. İstanbul ΣΣ. end.", "", "  ", "<|endoftext|> hi",
          "x\x1cy a.\x1cb", "K Kelvin. ẞ", "日本語、テキスト a, b", "\x01\x02 q", "word.́ x", "a <|startoftext|> b", "c<|ENDOFTEXT|>",
          "'s 're. a's, b 'll", "Straße, ÉCOLE!! École;; ªºµ x×y «é»", "tab\tnew\nline\x0bvt\x0cff\rcr", "a b c​d"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return lambda t: tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("plain", [False, True])
def test_encoder_equals_the_library(plain):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = plain
    library = lambda t: tok.encode(t, add_special_tokens=False).ids
    assert len(library("a <|startoftext|> b")) == (9 if plain else 3)
    enc = token_files.WordEncoder(tokenizer_path(), 2, limit=5, plain_specials=plain)
    for text in TRICKY + TRICKY:
        assert np.frombuffer(enc.encode([text])[0], "<u2").tolist() == library(text), text


def test_encoder_equals_the_library_on_documents(spark, library):
    import pyarrow.parquet as pq

    from ..conftest import SF_SMALL

    texts = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["text"]).column("text").to_pylist()
    enc = token_files.WordEncoder(tokenizer_path(), 2)
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == library(text)


def expected(rows, library):
    out, start = [], 0
    for key, text in rows:
        ids = np.array([*library(text or ""), END_ID], dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("width", [2, 4])
def test_round_trip(spark, library, scratch, width):
    got = token_files.tokens_round_trip(edges(spark), tokenizer_path(), END_ID, width, folder=f"{scratch}/t{width}")
    rows = sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])
    keys = [r[0] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))  # ascending, null first
    # rows that share an id come in any order of their texts: compare as they came
    texts = {}
    for k, t in EDGES:
        texts.setdefault(k, []).append(t)
    start = 0
    for key, at, n, crc in rows:
        fits = [t for t in texts[key] if expected([(key, t)], library)[0][2:] == (n, crc)]
        assert at == start and fits
        texts[key].remove(fits[0])
        start += n
    assert not any(texts.values())


def test_files_hold_the_documents(spark, library, scratch):
    folder = f"{scratch}/files"
    shards = token_files.write_tokens(edges(spark).where("doc_id = 9 or doc_id = 1"), folder, tokenizer_path(), END_ID)
    ids = np.concatenate([np.fromfile(f"{folder}/ids-{s:05d}.bin", "<u2") for s, *_ in shards])
    assert ids.tolist() == [*library("a\r\nb\n\nc"), END_ID, END_ID]
    ends = [np.fromfile(f"{folder}/offsets-{s:05d}.bin", "<u8").tolist() for s, *_ in shards]
    assert ends[0][0] == 0 and ends[-1][-1] == len(ids)


def test_empty_table(spark):
    assert token_files.tokens_round_trip(empty(spark), tokenizer_path(), END_ID).collect() == []
