import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpie.llm import media, packing
from kelpie.llm.queries import op5_media_columns, op6_packing, tokenizer


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "hello world", "a"), (2, None, "b"), (3, "", "c"), (4, "hello world", "d"), (None, "é" * 500, "e"), (6, "x y. " * 9000, "f"), (6, "again", "g")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def test_media_columns(docs):
    rows = media.media_columns(docs).collect()
    assert len(rows) == 7
    texts = {(r.doc_id, len((r.text or "").encode())): (r.text or "").encode() for r in docs.collect()}
    for r in rows:
        raw = texts[r.doc_id, r.n_bytes]
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = media.encode_pixmap(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    by = {}
    for r in rows:
        by.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(v) == 1 for v in by.values())


def test_html_sequences_stay_aligned(spark):
    html = "<p>one</p><figure><img src='sha256:aa' alt='x'><figcaption>cap <b>A</b></figcaption></figure>two<script>no</script><audio src='http://h/a.mp3'>"
    parts = media.parse_html(html)
    assert [(p["position"], p["kind"], p["text"], p["caption"]) for p in parts] == [(0, "text", "one", None), (1, "image", None, "cap A"), (2, "text", "two", None), (3, "audio", None, None)]
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    seqs = media.sequences(pages, "page_id", "html")
    known = spark.createDataFrame([("aa", 5)], "digest string, payload_bytes long")
    got = {(r.page_id, r.position): (r.caption, r.payload_bytes) for r in media.resolve(seqs, "page_id", known).collect()}
    assert got == {(1, 1): ("cap A", 5), (1, 3): (None, None)}


def test_pixmap_refuses_damage():
    with pytest.raises(ValueError):
        media.decode_pixmap(media.encode_pixmap(b" " * 192)[:-1])


def _check_pieces(pieces, ids_of, size=2048):
    used, docs = {}, {}
    for p in pieces:
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    padding = 0
    for seq in used.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    for (doc_id, n), ps in docs.items():
        ids = ids_of[doc_id, n]
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == n
    return padding


def test_packing_against_whole_texts(spark, docs, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for table in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = table.collect()
        ids = [e.ids + [1] for e in tok.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
        ids_of = {(r.doc_id, len(i)): i for r, i in zip(rows, ids)}
        pieces = packing.pack(table, tokenizer("word_bpe_49k.json"), window=50_000).collect()
        assert _check_pieces(pieces, ids_of) == 0
        assert sum(p.length for p in pieces) == sum(map(len, ids))
    assert op6_packing(spark, sf_dir).count() >= table.count()
    assert packing.pack(docs.limit(0), tokenizer("word_bpe_49k.json")).count() == 0
    assert media.media_columns(docs.limit(0)).count() == 0
    assert op5_media_columns(spark, sf_dir).count() == table.count()


def test_word_encoder_odd_texts():
    from tokenizers import Tokenizer

    texts = ["It's I'LL they're 'sfoo", "A,B;c..d 12 3x", "É́ é x y", "<|endoftext|>a <|startoftext|>", "Stupid$$$ a'' \x1f\x00 ẞ İ", " \t\n", "ﬁ Å ＡＢ"]
    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    ids, at = packing.WordEncoder(tokenizer("word_bpe_49k.json")).encode(pa.array(texts), 1)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids + [1], t


def test_balance_costs():
    lengths = np.array([2048, 1000, 900, 148, 2000, 96], np.int64)
    pieces = packing.balance(lengths, 2048, 2048.0)
    assert sum(p[2] for p in pieces) == lengths.sum()
    assert len({p[3] for p in pieces}) == len(packing.capacities(int(lengths.sum()), 2048))
